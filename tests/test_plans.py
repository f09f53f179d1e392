"""Two-level running values against plain windows, and the shape of the plans."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomlog.fixtures import fixture
from loomlog.operators import curation as cu
from loomlog.operators import redaction as rd
from loomlog.operators import routing as ro
from loomlog.operators.changelog import changelog
from loomlog.operators.library import compile_context, parse_articles, review_context
from loomlog.plans.key_filter import KeyFilter, KeyTable
from loomlog.plans.ordered import join_group_value, latest_per_key, previous_value, range_chunks, running_sum
from loomlog.registry import SCOPE_RULES


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows in one group."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.col("id").alias("pos"), (F.xxhash64("id") % 5).alias("v"), F.concat(F.lit("v"), (F.xxhash64("id") % 7).cast("string")).alias("s"))


@pytest.mark.parametrize("width", [1, 10, 100_000])
def test_running_sum(hot, width):
    w = Window.partitionBy("k").orderBy("pos")
    got = running_sum(hot.withColumn("want", F.sum("v").over(w)), ["k"], ["pos"], F.col("v"), "got", F.floor(F.col("pos") / width))
    assert got.count() == 3000 and got.filter("got <> want").count() == 0


@pytest.mark.parametrize("width", [1, 10, 100_000])
def test_previous_value(hot, width):
    w = Window.partitionBy("k").orderBy("pos")
    got = previous_value(hot.withColumn("want", F.lag("s").over(w)), ["k"], ["pos"], "s", "got", F.floor(F.col("pos") / width))
    assert got.count() == 3000 and got.filter("not (got <=> want)").count() == 0


def test_initial_value_and_group_join(spark, hot):
    start = spark.createDataFrame([("hot", "s0"), ("other", "x")], "k string, s string")
    got = previous_value(hot, ["k"], ["pos"], "s", "got", F.floor(F.col("pos") / 10), start)
    firsts = {r["k"]: r["got"] for r in got.filter("got is null or got in ('s0', 'x')").collect()}
    assert firsts.pop("hot") == "s0" and set(firsts.values()) == {None}
    joined = join_group_value(hot, start.withColumnRenamed("s", "w"), ["k"], F.floor(F.col("pos") / 10))
    assert joined.count() == hot.filter("k = 'hot'").count() and {r["w"] for r in joined.collect()} == {"s0"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_keeps_one_row_per_key_before_the_shuffle(hot):
    assert "WindowGroupLimit [k" in plan(latest_per_key(hot, ["k"], ["pos"])).replace("#", " ").replace("(", " ") or \
        plan(latest_per_key(hot, ["k"], ["pos"])).count("WindowGroupLimit") == 2


def test_scope_and_store_need_no_join_or_shuffle(spark, sf_dir):
    s = fixture(spark, sf_dir, "sessions").drop("conv_id")
    p = plan(ro.route_to_store(ro.resolve_scope(s, SCOPE_RULES), {"work": "w"}))
    assert "Join" not in p


@pytest.mark.parametrize("name", list(entry.queries()))
def test_no_cross_join(spark, sf_dir, name):
    p = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_predicate_reaches_the_partitions(spark, tmp_path):
    from datetime import date

    from loomlog.operators.compile_window import Cursor, pending_sessions
    from loomlog.sources.sinks import append_partitioned
    df = spark.createDataFrame([("b", date(2026, 4, d), "080000", f"s{d}") for d in range(1, 9)],
                               "brain string, log_date date, hhmmss string, session_id string")
    append_partitioned(df, str(tmp_path / "logs"), ["brain", "log_date"])
    logs = spark.read.parquet(str(tmp_path / "logs"))
    out = pending_sessions(logs, {"b": Cursor(date(2026, 4, 3))}, date(2026, 4, 6))
    assert "PartitionFilters: [" in plan(out) and "PartitionFilters: []" not in plan(out)
    assert sorted(r["session_id"] for r in out.collect()) == ["s4", "s5"]


def test_running_sum_in_text_order(spark):
    """A third of all rows in one group, in the order of a text: the group is cut into ranges."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
                                    F.md5(F.col("id").cast("string")).alias("item"), (F.xxhash64("id") % 9).alias("v"))
    want = rows.withColumn("want", F.sum("v").over(Window.partitionBy("k").orderBy("item")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = range_chunks(want, ["k", "item"])
        got = running_sum(ranged, ["k"], ["item"], F.col("v"), "got", F.col("_range"))
        assert got.count() == 3000 and got.filter("got <> want").count() == 0
        assert ranged.filter("k = 'hot'").select("_range").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_review_has_no_window_over_a_category(spark):
    articles = spark.createDataFrame([("work", f"library/patterns/a{i}.md", f"---\ntitle: T{i}\n---\nx") for i in range(50)], "brain string, path string, content string")
    p = plan(review_context(parse_articles(articles), "2026-06-20"))
    by_item = [line for line in p.splitlines() if "- Window [" in line and "item#" in line]
    assert by_item and all("_chunk#" in line for line in by_item)


def test_changelog_scans(spark):
    entries = spark.createDataFrame([("w", "compile", 1, 0, "create", "library/a.md", None)], "brain string, kind string, run_id long, seq int, action string, path string, note string")
    runs = spark.sql("SELECT 'w' AS brain, 'compile' AS kind, 1L AS run_id, DATE '2026-04-01' AS section_date, '10:00' AS hm, 's' AS summary")
    assert plan(changelog(entries, runs)).count("FileScan parquet") <= 4


def test_audit_generates_small_methods(spark, sf_dir):
    """The chain of rules is one value passed from step to step; no generated code holds all replacements."""
    p = rd.redaction_audit(spark.createDataFrame([("a", "b")], "text string, g string"), "text", ["g"])
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        assert p.count() == 0
        turns = fixture(spark, sf_dir, "turns")
        assert rd.redaction_audit(turns, "text", ["role"]).count() > 20
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.hugeMethodLimit")


def test_backlink_rows_grow_with_hits(spark):
    """Of 60,000 word runs of bodies only those that may be a title leave the rows that hold them."""
    titles = spark.createDataFrame([("w", f"title{i} of words number{i}", 1, "p") for i in range(40)], "brain string, title string, n_articles long, target_path string")
    keyed = cu._title_keys(titles)
    bodies = spark.range(20).select(F.lit("w").alias("brain"), F.concat(F.lit("a"), "id").alias("path"), F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.concat(F.lit("x"), F.col("id") * 1000 + i)),
        F.array(F.concat(F.lit("title"), "id"), F.lit("of"), F.lit("words"), F.concat(F.lit("number"), "id"))).alias("_w"))
    found = cu._runs_like(keyed, bodies)
    assert found.join(keyed, ["brain", "_key"]).count() == 20
    assert found.count() < 20 + 0.1 * 20_000  # 32 bits a key let about 3 in 100 pass


def test_key_filter_holds_every_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    for most in (22, 10):
        known = KeyFilter(keys, "k", 5000, most)
        rows = spark.range(20_000).select(F.col("id"), known.may_hold(F.xxhash64("id")).alias("held"))
        assert rows.filter("id < 5000 and not held").count() == 0
        passed = rows.filter("id >= 5000 and held").count()
        assert passed < 1500 if most == 22 else passed > 0


def test_key_filter_of_many_keys(spark):
    """A filter grows with its keys: of a million, hardly any key passes that is not among them."""
    keys = spark.range(1_000_000).select(F.xxhash64("id").alias("k"))
    held = KeyFilter(keys, "k", 1_000_000).may_hold(F.col("k"))
    found = keys.agg(F.count_if(held).alias("n")).first()["n"]
    wrong = spark.range(1_000_000, 1_200_000).select(F.xxhash64("id").alias("k")).agg(F.count_if(held).alias("n")).first()["n"]
    assert found == 1_000_000 and wrong < 200_000 * 0.05


@pytest.mark.parametrize("n", [0, 20, 5000, 200_000])
def test_key_table_parts_rows_and_is_in_no_plan(spark, n):
    """All keys and few others are among those that may be held; the rest of the rows, and no others, are not."""
    known = KeyTable(spark.range(n).select(F.xxhash64("id").alias("k")), "k", n)
    rows = spark.range(n + 20_000)
    held, rest = known.may_hold(rows, F.xxhash64("id")), known.holds_not(rows, F.xxhash64("id"))
    found = held.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") < n).alias("keys")).first()
    assert found["keys"] == n and found["n"] - n <= 1500 and found["n"] + rest.count() == n + 20_000
    assert held.join(rest, "id").count() == 0
    for df in (held, rest):
        assert "BroadcastNestedLoopJoin" in plan(df) and len(df._jdf.queryExecution().toString()) < 10_000


def test_key_table_and_key_filter_hold_the_same(spark):
    keys, rows = spark.range(3000).select(F.xxhash64("id").alias("k")), spark.range(30_000)
    for most in (26, 12):
        literal = rows.filter(KeyFilter(keys, "k", 3000, most).may_hold(F.xxhash64("id")))
        written = KeyTable(keys, "k", 3000, most).may_hold(rows, F.xxhash64("id"))
        assert sorted(r["id"] for r in written.collect()) == sorted(r["id"] for r in literal.collect())


def test_compile_context_moves_no_texts(spark):
    """Whatever Spark knows of sizes, the texts of a library are not sent to one task to meet its count."""
    article = ("work", "library/patterns/a.md", "---\ntitle: A\nttl: 2w\nupdated: 2026-01-01\n---\nbody")
    catalog = parse_articles(spark.createDataFrame([article], "brain string, path string, content string"))
    sessions = spark.createDataFrame([("work", "s1", 1, "hi")], "brain string, session_file string, seq long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = compile_context(catalog, sessions)
        assert out.count() == 4 - 1
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert not [line for line in plan.splitlines() if "SortMergeJoin [brain" in line and "LeftOuter" not in line]
