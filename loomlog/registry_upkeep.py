"""Queries that write stored tables, change them, and read them back; next to their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.fixtures import spark_sql
from loomlog.operators import copies
from loomlog.operators import edits as ed
from loomlog.operators import library as lb
from loomlog.plans import documents, upkeep
from loomlog.registry import (CHANGELOG_SQL, CONFIG, CTES, INDEX_SQL, _fx, _log_entries, _per_log, _routed, _stream_events, _text, duck_redact,
                              register)
from loomlog.session import fresh_folder, saved
from loomlog.sources.sinks import append_partitioned
from loomlog.streaming import in_order, streams

CTES["nolog"] = "SELECT session_id FROM {scoped} WHERE scope = 'nolog'"
CTES["article_sources"] = r"""
SELECT brain, path, unnest(list_filter(list_transform(string_split(regexp_extract(content, 'sources: \[(.*)\]', 1), ','), lambda s: trim(s)), lambda s: s <> '')) AS session_id FROM {articles}"""


@register("purge_stored", """
SELECT kind, place, key, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT 'log' AS kind, concat(r.store, '/', CAST(CAST(t.ts AS DATE) AS VARCHAR)) AS place, session_id AS key FROM {turns} t JOIN {routed} r USING (session_id)
  UNION ALL SELECT 'staged', CAST(CAST(ts AS DATE) AS VARCHAR), session_id FROM {hook_events}
  UNION ALL SELECT 'snapshot', concat(store, '/', CAST(log_date AS VARCHAR)), session_id FROM {snapshots}
  UNION ALL SELECT 'mark', '', session_id FROM {sessions}) q WHERE key NOT IN (SELECT session_id FROM {nolog}) GROUP BY 1, 2, 3
UNION ALL SELECT 'version', brain, path, CAST(count(*) AS BIGINT) FROM {articles} a WHERE NOT EXISTS (
  SELECT 1 FROM {article_sources} s JOIN {nolog} USING (session_id) WHERE s.brain = a.brain AND s.path = a.path) GROUP BY 2, 3""")
def _purge_stored(spark, d):
    """Everything stored, purged twice, read back; the second purge finds nothing."""
    home = fresh_folder(spark, "purged")
    day = F.to_date("ts").alias("log_date")
    logs = _fx(spark, d, "turns").join(_routed(spark, d).select("session_id", "store"), "session_id").select("store", day, "session_id", "line_no", "text")
    append_partitioned(logs, f"{home}/logs", ["store", "log_date"])
    append_partitioned(_fx(spark, d, "hook_events").select(day, "session_id", "prompt"), f"{home}/staged", ["log_date"])
    append_partitioned(_fx(spark, d, "snapshots"), f"{home}/snapshots", ["store", "log_date"])
    _fx(spark, d, "sessions").select("session_id").write.parquet(f"{home}/marks")
    versions = _fx(spark, d, "articles").select("brain", "path", F.lit(0).cast("bigint").alias("run_id"), F.lit(0).alias("seq"), F.lit("create").alias("action"), "content")
    append_partitioned(versions, f"{home}/versions", ["brain"])
    tables = {f"{home}/logs": ["store", "log_date"], f"{home}/staged": ["log_date"], f"{home}/snapshots": ["store", "log_date"], f"{home}/marks": []}
    done = [upkeep.purge_stored(spark, home, _routed(spark, d), tables, f"purge-{n}", f"{home}/versions") for n in range(2)]
    if done[1]:
        raise ValueError("the second purge found something")

    def rows(kind, place, key="session_id"):
        return spark.read.parquet(f"{home}/{kind}").select(F.lit(kind.rstrip("s")).alias("kind"), place.alias("place"), F.col(key).alias("key"))

    store_day = F.concat_ws("/", "store", F.col("log_date").cast("string"))
    found = [rows("logs", store_day), rows("staged", F.col("log_date").cast("string")), rows("snapshots", store_day), rows("marks", F.lit("")),
             rows("versions", F.col("brain"), "path")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("kind", "place", "key").agg(F.count(F.lit(1)).alias("n_rows"))


CTES["staged_days"] = """
SELECT s.session_id, s.log_date, s.n_rows, r.store, NOT r.scope IN ('unset', 'nolog') AND NOT EXISTS (
  SELECT 1 FROM {filed} f WHERE f.session_id = s.session_id AND f.log_date = s.log_date AND f.store = r.store) AS moves
FROM (SELECT session_id, CAST(ts AS DATE) AS log_date, count(*) AS n_rows FROM {turns} GROUP BY 1, 2) s JOIN {routed} r USING (session_id)"""


@register("migrate_stored", """
SELECT store, CAST(log_date AS VARCHAR) AS log_date, session_id, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM (
  SELECT store, log_date, session_id, count(*) AS n_rows FROM {filed} GROUP BY 1, 2, 3
  UNION ALL SELECT CASE WHEN moves THEN store ELSE 'staged' END, log_date, session_id, n_rows FROM {staged_days}) q GROUP BY 1, 2, 3""")
def _migrate_stored(spark, d):
    """Staged logs moved twice into stores that hold some of them; both read back."""
    home = fresh_folder(spark, "migrated")
    staged = _fx(spark, d, "turns").select("session_id", F.to_date("ts").alias("log_date"), "line_no", F.length("text").alias("n"))
    append_partitioned(staged, f"{home}/staged", ["log_date"])
    append_partitioned(_fx(spark, d, "filed"), f"{home}/logs", ["store", "log_date"])
    done = [upkeep.migrate_stored(spark, home, _routed(spark, d), [(f"{home}/staged", f"{home}/logs")], f"move-{n}") for n in range(2)]
    if done[1]:
        raise ValueError("the second run moved something")
    left = spark.read.parquet(f"{home}/staged").withColumn("store", F.lit("staged"))
    return _per_log(spark.read.parquet(f"{home}/logs").unionByName(left))


@register("commit_run", """
SELECT 'versions' AS kind, brain AS key, CAST(count(*) AS BIGINT) AS n_rows FROM {versions} GROUP BY 2
UNION ALL SELECT 'cursor', brain, CAST(count(DISTINCT run_id) AS BIGINT) FROM {versions} GROUP BY 2
UNION ALL SELECT 'errors', brain, CAST(count(*) AS BIGINT) FROM {versions} WHERE action = 'delete' GROUP BY 2""")
def _commit_run(spark, d):
    """The runs of the history committed one after the other, each tried again; all tables read back."""
    home, versions = fresh_folder(spark, "runs"), _fx(spark, d, "versions")
    for run in [r.run_id for r in versions.select("run_id").distinct().orderBy("run_id").collect()]:
        own = versions.filter(F.col("run_id") == run)
        parts = {f"{home}/versions": (own, ["brain"]), f"{home}/cursor": (own.select("brain", "run_id").distinct(), []),
                 f"{home}/errors": (own.filter("action = 'delete'").select("brain", "path"), [])}
        tried = [upkeep.commit_run(spark, home, f"run-{run}", parts) for _ in range(2)]
        if tried != [True, False]:
            raise ValueError(f"run {run} was committed {sum(tried)} times")
    out = None
    for kind in ("versions", "cursor", "errors"):
        rows = spark.read.parquet(f"{home}/{kind}").select(F.lit(kind).alias("kind"), F.col("brain").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n_rows"))


# ---- documents by increments ----

CTES["current"] = """
SELECT brain, path, content FROM (SELECT *, row_number() OVER (PARTITION BY brain, path ORDER BY run_id DESC, seq DESC) AS rn FROM {versions}) q
WHERE rn = 1 AND action <> 'delete'"""
CTES["current_cat"] = CTES["cat"].replace("{articles}", "{current}")


def _kept_up(spark, d):
    """Home of the documents after three increments of the history and of the log, each tried again."""
    home, versions = fresh_folder(spark, "documents"), _fx(spark, d, "versions")
    entries, runs = saved(_log_entries(spark, d), "log-entries"), _fx(spark, d, "runs")
    steps = [r.run_id for r in versions.select("run_id").distinct().orderBy("run_id").collect()]
    low, high = runs.agg(F.min("run_id"), F.max("run_id")).first()
    for n, step in enumerate(steps):
        catalog = lb.parse_articles(ed.latest_version(versions.filter(F.col("run_id") <= step)))
        edited = versions.filter(F.col("run_id") == step).select("brain", "path")
        share = F.least(F.floor((F.col("run_id") - low) * len(steps) / (high - low + 1)), F.lit(len(steps) - 1))
        seen, new = runs.filter(share <= n), runs.filter(share == n)
        tried = [documents.refresh_documents(spark, home, f"step-{n}", catalog, edited, entries, seen, new) for _ in range(2)]
        if tried != [True, False]:
            raise ValueError(f"step {n} was made {sum(tried)} times")
    return home


@register("index_kept_up", INDEX_SQL.replace("{cat}", "{current_cat}"))
def _index_kept_up(spark, d):
    """The index after every run of the history, from its fragments."""
    return documents.index_document(spark, _kept_up(spark, d), "2026-06-20 00:00:00")


@register("changelog_kept_up", CHANGELOG_SQL)
def _changelog_kept_up(spark, d):
    """The changelog after every part of the log, from its fragments."""
    return _text(documents.changelog_document(spark, _kept_up(spark, d)), "section_date")


# ---- streams in the order of event time ----

# The transcripts of the fixtures were written two years after their hook events.
SHIFT_DAYS = 821
HOUR = 3_600_000_000

CTES["turn_events"] = f"""
SELECT session_id, ts - INTERVAL '{SHIFT_DAYS}' DAY AS ts, 0 AS rank, line_no AS pos, CASE role WHEN 'user' THEN 'open' ELSE 'said' END AS kind, text, CAST(NULL AS VARCHAR) AS store, CAST(NULL AS VARCHAR) AS scope
FROM {{turns}} WHERE NOT is_sidechain AND ((role = 'user' AND trim(text) <> '') OR (role = 'assistant' AND text <> ''))
UNION ALL SELECT session_id, ts, 1, event_id, 'stop', NULL, CASE scope WHEN 'work' THEN 'store_work' WHEN 'private' THEN 'store_private' ELSE 'unclassified' END, scope
FROM {{event_scopes}} WHERE mode = 'stop'"""
CTES["turn_parts"] = """
SELECT *, sum(CASE WHEN kind = 'said' THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts, rank, pos ROWS UNBOUNDED PRECEDING)
  - CASE WHEN kind = 'said' THEN 0 ELSE 1 END AS part FROM {turn_events}"""


def _stream_turns(spark, d):
    """The `turns` fixture over a streaming table, with the time of the hook events."""
    streams.stream_table(spark, f"{d}/conversations.parquet").createOrReplaceTempView("streamed_conversations")
    return (spark.sql(spark_sql("turns", lambda ref: f"streamed_{ref}")).withColumnRenamed("role", "entry_type")
            .withColumn("is_real_user", F.trim("text") != "").withColumn("ts", F.expr(f"ts - INTERVAL '{SHIFT_DAYS}' DAY")))


@register("stream_log_stops", f"""
SELECT q.session_id, e.pos AS event_id, e.store, e.scope, CAST(CAST(e.ts AS DATE) AS VARCHAR) AS log_date, q.pos AS line_no, {duck_redact("q.text")} AS text
FROM {{turn_parts}} q JOIN {{turn_parts}} e ON e.session_id = q.session_id AND e.part = q.part AND e.kind = 'stop'
WHERE q.kind = 'said' AND e.scope <> 'nolog'""")
def _stream_log_stops(spark, d):
    """Transcripts and stops as one stream, run twice; the second run has nothing new."""
    home, state = fresh_folder(spark, "stops"), fresh_folder(spark, "stops-state")
    job = in_order.stopped_turns(home, 24 * HOUR)
    for _ in range(2):
        events = _stream_events(streams.stream_table(spark, f"{d}/events.parquet"))
        job.run(in_order.turn_rows(_stream_turns(spark, d)).unionByName(in_order.stop_rows(events, CONFIG)), state)
    job.finish(spark)
    return _text(spark.read.parquet(f"{home}/turns").select("session_id", "event_id", "store", "scope", "log_date", "line_no", "text"), "log_date")


# Most sessions stay: one error in 97 opts out, the others tell nothing.
CTES["scope_changes"] = """
SELECT session_id, event_id, ts, was, scope, CASE scope WHEN 'nolog' THEN 'purge' ELSE 'migrate' END AS action
FROM (SELECT *, lag(scope) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS was FROM (
  SELECT session_id, event_id, ts, CASE WHEN event_type <> 'error' OR event_id % 97 = 0 THEN scope WHEN user_id % 3 = 0 THEN 'both' ELSE 'unset' END AS scope FROM {event_scopes}) e) q
WHERE scope <> was AND (scope = 'nolog' OR was = 'unset')"""


@register("scopes_applied", """
SELECT CASE WHEN n.session_id IS NULL THEN 'staged' ELSE n.store END AS store, CAST(CAST(t.ts AS DATE) AS VARCHAR) AS log_date, t.session_id, CAST(count(*) AS BIGINT) AS n_rows
FROM {turns} t LEFT JOIN (
  SELECT session_id, bool_or(action = 'purge') AS gone, CASE arg_max(scope, (ts, event_id)) WHEN 'work' THEN 'store_work' WHEN 'private' THEN 'store_private' ELSE 'unclassified' END AS store
  FROM {scope_changes} GROUP BY 1) n USING (session_id) WHERE gone IS NULL OR NOT gone GROUP BY 1, 2, 3""")
def _scopes_applied(spark, d):
    """Staged logs follow the scopes that a stream of events tells; purges and moves read back."""
    home = fresh_folder(spark, "scopes")
    staged = _fx(spark, d, "turns").select("session_id", F.to_date("ts").alias("log_date"), "line_no")
    append_partitioned(staged, f"{home}/staged", ["log_date"])
    job = in_order.scope_history(home, HOUR)
    events = _stream_events(streams.stream_table(spark, f"{d}/events.parquet"))
    title = F.when(~F.startswith("raw_title", F.lit("[nolog]")) | (F.col("event_id") % 97 == 0), F.col("raw_title"))
    job.run(in_order.scope_rows(events.withColumn("raw_title", title), CONFIG), f"{home}/state")
    job.finish(spark)
    for n in range(2):
        in_order.apply_scopes(spark, home, f"{home}/logs", f"{home}/staged", f"apply-{n}")
    schema = "session_id string, log_date date, line_no long, store string"
    left = spark.read.schema(schema).parquet(f"{home}/staged").withColumn("store", F.lit("staged"))
    moved = in_order.stored(spark, f"{home}/logs", schema)
    return _per_log(left if moved is None else left.unionByName(moved))


@register("dead_letters", """
SELECT 'error' AS kind, value AS text, CAST(count(*) AS BIGINT) AS n FROM {hook_lines} WHERE value = '{{bad' GROUP BY 2
UNION ALL SELECT 'prompt', regexp_extract(value, '"prompt":"([^"]*)"', 1), CAST(count(*) AS BIGINT) FROM {hook_lines} WHERE contains(value, '"mode":"prompt"') GROUP BY 2
UNION ALL SELECT 'lines', '', CAST(count(*) AS BIGINT) FROM {hook_lines}""")
def _dead_letters(spark, d):
    """A stream of payload lines, some of them broken: prompts, error rows and counts read back."""
    home = fresh_folder(spark, "payloads")
    _fx(spark, d, "hook_lines").select("value").write.text(f"{home}/in")
    for _ in range(2):
        lines = spark.readStream.text(f"{home}/in").withColumn("ts", F.lit("2026-06-01 00:00:00").cast("timestamp"))
        in_order.log_payloads(lines, CONFIG, home, f"{home}/state")
    bad = spark.read.parquet(f"{home}/errors").groupBy(F.lit("error").alias("kind"), F.col("message").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    good = spark.read.parquet(f"{home}/prompts").groupBy(F.lit("prompt").alias("kind"), F.col("prompt").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    counts = spark.read.parquet(f"{home}/batches").select(F.lit("lines").alias("kind"), F.lit("").alias("text"), F.col("n_lines").alias("n"))
    return bad.unionByName(good).unionByName(counts)


# ---- daily copies ----

@register("snapshots_once", """
SELECT session_id, store, CAST(log_date AS VARCHAR) AS log_date, line_no, line, row_number() OVER (PARTITION BY session_id, store, log_date ORDER BY line_no) AS position FROM (
  SELECT t.session_id, r.store, DATE '2026-04-01' + CAST(d AS INT) AS log_date, line_no, raw AS line
  FROM {transcript_lines} t JOIN {routed} r USING (session_id), (SELECT unnest([0, 1, 2, 3]) AS d) q WHERE line_no < 2 * d + 2 AND r.scope <> 'nolog') z""")
def _snapshots_once(spark, d):
    """Copies of four days, each two lines longer, written day by day and once more; all read back."""
    home = fresh_folder(spark, "copies")
    routed = _routed(spark, d).filter("scope <> 'nolog'").select("session_id", "store")
    lines = _fx(spark, d, "transcript_lines").select("session_id", "line_no", F.col("raw").alias("line")).join(routed, "session_id")
    for n in (0, 1, 2, 3, 3):
        day = F.date_add(F.lit("2026-04-01").cast("date"), n)
        copies.write_copies(lines.filter(F.col("line_no") < 2 * n + 2).withColumn("log_date", day), home, f"day-{n}", chunk_width=3)
    back = copies.read_copies(spark, home)
    # Line numbers of these transcripts are dense from 0.
    return _text(back.select("session_id", "store", "log_date", (F.col("position") - 1).alias("line_no"), "line", "position"), "log_date")
