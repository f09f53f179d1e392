import bz2
import gzip
import random
import zlib
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlog import registry
from loomlog.functions import front_matter as fm
from loomlog.operators import changelog as ch
from loomlog.operators import curation as cu
from loomlog.operators import edits as ed
from loomlog.operators import library as lb
from loomlog.operators import promote as pr
from loomlog.operators.compile_window import Cursor
from loomlog.plans.jobs import (apply_responses, compile_inputs, compile_library, promote, response_edits, response_errors,
                                review_inputs)
from loomlog.sources import readers, sinks


def parse(spark, text, kind="compile"):
    df = spark.createDataFrame([(1, "w", kind, 1, text)], "run_id long, brain string, kind string, attempt int, text string")
    p = ed.with_blocks(df)
    edits = [(r["seq"], r["action"], r["path"], r["reason"], r["content"]) for r in ed.parse_edits(p, ["run_id", "brain"]).orderBy("seq").collect()]
    row = p.first()
    return edits, row["summary"], row["status"]


BLOCK = "@@@EDIT\naction: create\npath: library/a.md\nreason: a: b\n@@@BODY\n# T\n\nx  \n\n@@@END\n"


def test_blocks(spark):
    edits, summary, status = parse(spark, "noise\n" + BLOCK + "@@@SUMMARY\n one \n@@@END\n@@@SUMMARY\ntwo\nlines\n")
    assert edits == [(0, "create", "library/a.md", "a: b", "# T\n\nx\n")] and summary == "two\nlines" and status == "parsed"


@pytest.mark.parametrize("text,want", [
    (BLOCK.replace("\n", "\r\n"), [(0, "create", "library/a.md", "a: b", "# T\n\nx\n")]),
    ("@@@EDIT\naction: skip\naction: create\n@@@BODY\na\n@@@EDIT\n@@@BODY\nb", [(0, "create", "", "", "a\n@@@EDIT\n@@@BODY\nb\n")]),
    ("@@@EDIT  \naction: skip\n@@@END", [(0, "skip", "", "", None)]),
    ("@@@EDIT\naction: skip", [(0, "skip", "", "", None)]),
    ("@@@EDIT\n@@@END\n@@@EDIT\n : x\naction : update\n@@@BODY\n@@@END", [(0, "", "", "", None), (1, "update", "", "", "\n")]),
    (" @@@EDIT\n@@@END\n@@@SUPERVISE\n@@@END", []),
    ("@@@EDIT\nno colon\npath: a b\n@@@BODY\nA\u2028B\x85C\n@@@END", [(0, "", "a b", "", "A\nB\nC\n")]),
])
def test_block_edges(spark, text, want):
    edits, _, status = parse(spark, text)
    assert edits == want and status == ("parsed" if want else "unparseable")


WORDS = ["text", "a: b", "# T", "@@", "@@@ENDS", " @@@END", "", "x  y"]


def test_parsing_undoes_writing(spark):
    """Any list of edits, written as blocks with noise between them, is read back as it was."""
    rng = random.Random(7)

    def edit(n):
        body = [rng.choice(WORDS) for _ in range(rng.randint(1, 6))] + ["end"] if rng.random() < 0.7 else None
        return (n, rng.choice(["create", "update", "skip"]), rng.choice(["library/a.md", "p q", ""]), rng.choice(["r", "r: s: t", ""]), body)

    def block(e):
        head = [f"{k}: {v}" for k, v in zip(("action", "path", "reason"), e[1:4])]
        rng.shuffle(head)
        return ["@@@EDIT" + rng.choice(["", " ", "\t"]), *head, *(["@@@BODY", *e[4]] if e[4] else []), "@@@END"]

    cases = []
    for i in range(300):
        edits, lines = [edit(n) for n in range(rng.randint(0, 4))], []
        for e in edits:
            lines += [rng.choice(["", "talk", "@@@", "action: x"]) for _ in range(rng.randint(0, 2))] + block(e)
        summary = rng.choice(["", "all well", "two\n\nlines"])
        lines += ["@@@SUMMARY", summary, "@@@END"] if summary else []
        cases.append(("\n".join(lines), [(*e[:4], "\n".join(e[4]) + "\n" if e[4] else None) for e in edits], summary))
    df = spark.createDataFrame([(i, "w", "compile", 1, t) for i, (t, _, _) in enumerate(cases)],
                               "run_id long, brain string, kind string, attempt int, text string")
    parsed = ed.with_blocks(df)
    found = {i: [] for i in range(len(cases))}
    for r in ed.parse_edits(parsed, ["run_id", "brain"]).orderBy("run_id", "seq").collect():
        found[r["run_id"]].append((r["seq"], r["action"], r["path"], r["reason"], r["content"]))
    summaries = {r["run_id"]: r["summary"] for r in parsed.collect()}
    for i, (text, edits, summary) in enumerate(cases):
        assert found[i] == edits, text
        assert summaries[i] == summary, text


def test_summary_only(spark):
    text = "@@@SUMMARY\nall fine\n@@@END"
    assert parse(spark, text)[2] == "unparseable"
    edits, _, status = parse(spark, text, "supervise")
    assert status == "implicit_skip" and edits == [(0, "skip", "", "implicit skip (summary-only response): all fine", None)]


def test_retry(spark):
    rows = [(1, 1, "none"), (1, 2, BLOCK), (2, 1, "x"), (2, 2, "y"), (2, 3, BLOCK), (3, 1, BLOCK), (3, 2, "z")]
    p = ed.with_blocks(spark.createDataFrame([(a, "w", "compile", b, t) for a, b, t in rows],
                                             "run_id long, brain string, kind string, attempt int, text string"))
    assert {(r["run_id"], r["attempt"]) for r in ed.retry_choice(p).collect()} == {(1, 2), (3, 1)}
    assert [r["run_id"] for r in ed.failed_runs(p).collect()] == [2]
    assert {(r["run_id"], r["attempt"]) for r in ed.retry_choice(p, attempts=None).collect()} == {(1, 2), (2, 3), (3, 1)}
    assert ed.failed_runs(p, attempts=None).count() == 0 and {r["run_id"] for r in ed.failed_runs(p, attempts=1).collect()} == {1, 2}
    errors = ed.parse_errors(p, ["run_id", "attempt"]).collect()
    assert len(errors) == 4 and all(r["stage"] == "parse" for r in errors)
    whole = ed.parse_errors(ed.with_blocks(spark.createDataFrame([(1, "w", "compile", 1, "z" * 9000)], "run_id long, brain string, kind string, attempt int, text string")), ["run_id"])
    assert len(whole.first()["message"]) > 9000


EDITS = "brain string, kind string, run_id long, seq int, action string, path string, reason string, content string"


def test_validity(spark):
    rows = [("compile", "skip", "anything", None, "ok"), ("compile", "create", "x.md", "c", "outside_root"),
            ("compile", "create", "library/../x.md", "c", "outside_root"), ("compile", "update", "library/index.md", "c", "outside_root"),
            ("compile", "update", "library/a/index.md", "c", "ok"), ("compile", "merge", "library/a.md", " ", "empty_content"),
            ("compile", "merge", "library/a.md", "c", "unknown_action"), ("compile", "delete", "library/a.md", "c", "unknown_action"),
            ("supervise", "merge", "library/a.md", " ", "unknown_action"), ("supervise", "delete", "library/a.md", None, "ok"),
            ("supervise", "rewrite", "library/a.md", None, "empty_content"), ("supervise", "update", "library/a.md", "c", "unknown_action"),
            ("compile", "create", "library/a..b.md", "c", "ok")]
    df = spark.createDataFrame([("w", k, 1, i, a, p, None, c) for i, (k, a, p, c, _) in enumerate(rows)], EDITS)
    got = [r["verdict"] for r in ed.classify_edits(df).orderBy("seq").collect()]
    assert got == [r[-1] for r in rows]
    assert ed.rejected_edits(df).count() == sum(r[-1] != "ok" for r in rows)


def test_order_and_history(spark, tmp_path):
    rows = [(1, 0, "supervise", "delete", "library/a.md", None), (1, 1, "supervise", "delete", "library/a.md", None),
            (2, 0, "compile", "update", "library/a.md", "new"), (2, 1, "compile", "create", "library/a.md", "newer"),
            (3, 0, "supervise", "rewrite", "library/b.md", "b"), (3, 1, "supervise", "delete", "library/c.md", None)]
    edits = spark.createDataFrame([("w", k, r, s, a, p, None, c) for r, s, k, a, p, c in rows], EDITS)
    lib = spark.createDataFrame([("w", "library/a.md", -1, 0, "create", "old"), ("w", "library/c.md", -1, 0, "create", "c")],
                                "brain string, path string, run_id long, seq int, action string, content string")
    got = {(r["run_id"], r["seq"]): r["effective"] for r in ed.edit_target_state(edits, lib).collect()}
    assert got == {(1, 0): "delete", (1, 1): "ignored", (2, 0): "create", (2, 1): "update", (3, 0): "rewrite", (3, 1): "delete"}
    root = str(tmp_path / "versions")
    sinks.write_versions(ed.append_versions(lib, edits), root)
    history = spark.read.parquet(root).select(*lib.columns)
    assert history.count() == 7
    assert ed.append_versions(history, edits).count() == 7
    now = {r["path"]: r["content"] for r in compile_library(history, edits).collect()}
    assert now == {"library/a.md": "newer", "library/b.md": "b"}


def test_render_and_parse_round_trip(spark):
    edits, _, _ = parse(spark, BLOCK)
    _, action, path, reason, content = edits[0]
    again = f"@@@EDIT\naction: {action}\npath: {path}\nreason: {reason}\n@@@BODY\n{content}@@@END\n"
    assert parse(spark, again)[0] == edits


def art(brain="work", path="library/patterns/a.md", fmt="", body="text"):
    return (brain, path, f"---\n{fmt}\n---\n{body}\n")


def catalog(spark, *arts, **kw):
    return lb.parse_articles(spark.createDataFrame(list(arts), "brain string, path string, content string"), **kw)


@pytest.mark.parametrize("line,default,strict", [
    ("share: true", True, True), ("share: Yes", True, True), ("share: 1", True, True), ("share: true   # note", True, False),
    ("share: false # true", False, False), (" share : YES", True, True), ("shared: true", False, False),
    ("share: no\nshare: true", False, False), ("share", False, False), ("share: true#x", False, False)])
def test_share(spark, line, default, strict):
    c = spark.createDataFrame([(f"---\n{line}\n---\nb\n",)], "c string").select(fm.front_matter(F.col("c")).alias("b"))
    row = c.select(fm.share_flag(F.col("b")).alias("d"), fm.share_flag(F.col("b"), True).alias("s")).first()
    assert (row["d"], row["s"]) == (default, strict)


def test_front_matter_edges(spark):
    c = catalog(spark, art(fmt="title: A\nttl:\nupdated: 2026-01-31\nsources: [a, , b ]"),
                art(path="library/x.md", fmt="", body="title: not this"), art(path="library/d/e/f.md", fmt="title: x y\nttl: 1mo"))
    rows = {r["path"]: r for r in c.collect()}
    a = rows["library/patterns/a.md"]
    assert a["ttl"] is None and a["sources"] == ["a", "b"] and a["updated"] == date(2026, 1, 31) and a["category"] == "patterns"
    x = rows["library/x.md"]
    assert x["title"] is None and x["category"] == "uncategorized" and x["stem"] == "x" and x["sources"] == []
    assert rows["library/d/e/f.md"]["title"] == "x y" and rows["library/d/e/f.md"]["expires"] is None
    old = catalog(spark, art(fmt="ttl:\nupdated: 2026-01-31"), compat=True).first()
    assert old["ttl"] == "updated: 2026-01-31"
    crlf = catalog(spark, ("work", "library/a.md", "---\r\ntitle: A\r\n---\r\nb\r\n")).first()
    assert crlf["title"] == "A"


@pytest.mark.parametrize("ttl,want", [("2w", date(2026, 2, 14)), ("1mo", date(2026, 2, 28)), ("3mo", date(2026, 4, 30)),
                                      ("1y", date(2027, 1, 31)), ("1y  # note", date(2027, 1, 31)), ("stable", None), ("soon", None)])
def test_expiry(spark, ttl, want):
    assert catalog(spark, art(fmt=f"ttl: {ttl}\nupdated: 2026-01-31")).first()["expires"] == want


def test_index_document(spark, tmp_path):
    c = catalog(spark, art(fmt="title: B\nttl: 1y # x\nupdated: 2026-01-01", path="library/p/b.md"), art(path="library/p/a.md"),
                art(path="library/z.md", fmt="title: Z"))
    brains = spark.createDataFrame([("work",), ("both",)], "brain string")
    lines = lb.library_index(c, "2026-01-02 03:04:05", brains=brains)
    path = str(tmp_path / "index")
    sinks.write_document(lines.filter("brain = 'work'"), lb.INDEX_ORDER, path)
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).orderBy("_metadata.file_path").collect())
    assert text.endswith("updated:2026-01-01\n\n## uncategorized\n\n- [Z](z.md) — ttl:?, updated:?\n\n")
    flat = [s for s in text.split("\n") if s]
    assert flat[0].startswith("# Library") and "_Article count: 3_" in flat
    assert flat[-5:] == ["## p", "- [a](p/a.md) — ttl:?, updated:?", "- [B](p/b.md) — ttl:1y # x, updated:2026-01-01",
                         "## uncategorized", "- [Z](z.md) — ttl:?, updated:?"]
    assert "no articles yet" in lines.filter("brain = 'both'").first()["line"]
    first = lb.library_index(c, "x", first_token=True).filter("stem = 'b'").first()["line"]
    assert first.endswith("ttl:1y, updated:2026-01-01")


def test_read_articles(spark, tmp_path):
    for name in ("index.md", "CHANGELOG.md", "a b.md", "x/index.md", "x/n.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("---\r\ntitle: T\r\n---\r\n")
    rows = readers.read_articles(spark, str(tmp_path), "work").collect()
    assert sorted(r["path"] for r in rows) == ["library/a b.md", "library/x/index.md"]
    assert rows[0]["content"] == "---\ntitle: T\n---\n"
    assert readers.read_articles(spark, f"file://{tmp_path}/", "work").count() == 2
    with pytest.raises(Exception, match="not below"):
        readers.read_articles(spark, f"{tmp_path}/[x]", "work").collect()


@pytest.mark.parametrize("glob", ["*", "*.md", "{a,p*}.[mgb]*"])
def test_tasks_list_and_read_the_files_that_spark_would(spark, tmp_path, glob):
    """Whatever the names and bytes; and nothing that the driver holds names a file."""
    names = ["a.md", "b c+d%2F.md", "d/e/f/g.md", "d/index.md", "d/_x.md", "d/.y.md", "q.md/z.md", "t.txt", "n\nl.md", "[z]/w.md", "index.md", "_h.md",
             "_k=v.md", "_metadata.md", "x._COPYING_", "_d/in.md", "_d=1/in.md", ".d/in.md", "_metadata/in.md", "r/_common_metadata"]
    texts = {**{n: n.encode() for n in names}, "empty.md": b"", "cr.md": b"a\r\nb\rc", "bad.md": b"\xff\xfe\x80 ok", "bom.md": b"\xef\xbb\xbfok", "nul.md": b"a\0b",
             "p.gz": gzip.compress(b"hello"), "p.bz2": bz2.compress(b"hey"), "p.deflate": zlib.compress(b"ho"), "e.gz": gzip.compress(b"")}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    (tmp_path / "ld").symlink_to(tmp_path / "d")
    (tmp_path / "la.md").symlink_to(tmp_path / "a.md")
    (tmp_path / "broken.md").symlink_to(tmp_path / "nowhere")
    value = F.hex(F.col("value").cast("binary"))
    theirs = readers._spark_files(spark, str(tmp_path), glob).select(F.regexp_replace("file", "^file:(//)?", ""), value).collect()
    ours = readers._local_files(spark, f"{tmp_path}/", glob).select("file", value).collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, theirs)) and len(ours) >= 3
    articles = readers.read_articles(spark, str(tmp_path), "work", glob=glob)
    assert articles.inputFiles() == [] and "a.md" not in articles._jdf.queryExecution().toString()
    (tmp_path / "n\nl.md").unlink()  # an error, as it was
    assert articles.count() == len([f for f in theirs if f[0] not in (f"{tmp_path}/index.md", f"{tmp_path}/n\nl.md")])


@pytest.mark.parametrize("codec", ["lz4", "snappy", "gzip", "bzip2", "deflate"])
def test_packed_files_are_unpacked_as_by_spark(spark, tmp_path, codec):
    """Of many blocks, of one, of runs, empty."""
    for name, n, text in (("big", 20_000, F.sha2(F.col("id").cast("string"), 256)), ("small", 1, F.lit("h\u00e9 hey hey hey hey")), ("runs", 3000, F.lit("a" * 700)), ("none", 1, F.lit(""))):
        spark.range(n).coalesce(1).select(text.alias("v")).write.option("compression", codec).text(f"{tmp_path}/{name}")
    (tmp_path / "a.zst").write_bytes(pa.Codec("zstd").compress(b"hello", asbytes=True))
    key = [F.substring_index("file", "/", -2), F.length("value"), F.md5(F.col("value").cast("binary"))]
    ours, theirs = readers._local_files(spark, f"{tmp_path}/", "*").select(*key).collect(), readers._spark_files(spark, str(tmp_path), "*").select(*key).collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, theirs)) and len(ours) >= 5


def test_no_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_articles(spark, f"{tmp_path}/none", "work")


def test_text_files_as_a_partitioned_text_table(spark, tmp_path):
    """The same folders, lines and order as Spark's writer, one file a group, whatever the values hold."""
    days = ["2026-04-01", None, "a/b:c=d%e", "q'\"#?*\\{[]}^ +\t\x7f"]
    rows = spark.createDataFrame([(d, f"n{k % 3}", k, None if k % 7 == 6 else f"line {k}\r") for k in range(60) for d in days],
                                 "day string, name string, at int, line string")
    plain = rows.repartition("day", "name").sortWithinPartitions("day", "name", "at").select("day", "name", "line")
    plain.write.partitionBy("day", "name").text(f"{tmp_path}/spark")
    sinks.write_text_files(rows, f"file:{tmp_path}/own", ["day", "name"], "line", ["at"])

    def files(at, pattern):
        return sorted((str(f.parent.relative_to(at)), f.read_bytes()) for f in at.rglob(pattern))
    assert files(tmp_path / "own", "part-*") == files(tmp_path / "spark", "part-*")
    assert len(files(tmp_path / "own", "part-*")) == len([f for f in (tmp_path / "own").rglob("*") if f.is_file()]) == 12
    sinks.write_text_files(spark.createDataFrame([("", "x"), (None, "y")], "k string, line string"), f"{tmp_path}/none", ["k"], "line", ["line"])
    assert files(tmp_path / "none", "*.txt") == [("k=__HIVE_DEFAULT_PARTITION__", b"x\ny\n")]


@pytest.mark.parametrize("query, one", [("read_articles", "path=*"), ("read_session_logs", "day=*/name=*"), ("read_transcripts", "session_id=*")])
def test_many_files_are_written_without_checksum_files(spark, tmp_path, monkeypatch, query, one):
    """Each costs Hadoop's local file system a process, as do the folder and the file."""
    monkeypatch.setattr(registry, "fresh_folder", lambda spark, name: f"{tmp_path}/{name}")
    spark.createDataFrame([(k, f"text {k}", "en", "s", 6) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(k // 3, k % 3, "user", f"text {k}") for k in range(90)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/in/conversations.parquet")
    found = registry.QUERIES[query](spark, f"{tmp_path}/in").count()
    made = [f for f in tmp_path.glob("[!i]*/**/*") if f.is_file()]
    assert len(made) == len({f.parent for f in made}) >= 30 and all(f.match(f"{one}/*") and f.suffix == ".txt" for f in made)
    assert found >= 30


def test_read_session_logs(spark, tmp_path):
    day = tmp_path / "2026-04-01"
    day.mkdir()
    (day / "080000_my title_s1.md").write_text("# head\n\nline\n")
    (day / "080000_my title_s1.jsonl").write_text("{}\n")
    rows = readers.read_session_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["# head", "", "line"]
    assert rows[0]["session_id"] == "s1" and rows[0]["hhmmss"] == "080000" and rows[0]["log_date"] == date(2026, 4, 1)


def test_contexts(spark):
    small = catalog(spark, art(brain="a"), *[art(brain="b", path=f"library/{i}.md") for i in range(3)])
    logs = spark.createDataFrame([(b, "f.md", 0, "log") for b in ("a", "b", "none")], "brain string, session_file string, seq long, text string")
    ctx = {(r["brain"], r["section"], r["item"]): r["text"] for r in lb.compile_context(small, logs, cap=2).collect()}
    assert ctx[("a", 2, "library/patterns/a.md")].startswith("### library/patterns/a.md\n\n---")
    assert ctx[("b", 2, "")].startswith("(This library has 3 articles")
    assert ctx[("none", 1, "")] == ctx[("none", 2, "")] == "(the library is empty)"
    kept = {(r["brain"], r["item"]): r["inlined"] for r in lb.compile_context(small, logs, cap=2).filter("section = 2 and item <> ''").collect()}
    assert len(kept) == 4 and [b for (b, _), i in kept.items() if i] == ["a"]
    review = lb.review_context(small, "2026-01-01")
    assert review.filter("brain = 'b'").count() == 7
    parts = lb.review_context(small, "2026-01-01", logs.select("brain"), budget=1)
    assert sorted(r["chunk"] for r in parts.filter("brain = 'b' and section = 2").collect())[0] == 0
    assert parts.filter("brain = 'b' and section = 2").select("chunk").distinct().count() == 3
    assert parts.filter("brain = 'none'").first()["text"].endswith("(the library is empty)")
    assert review.filter("tokens <> floor(length(text) / 4)").count() == 0


def test_promotion(spark):
    arts = spark.createDataFrame([art("work", "library/p/a.md", "share: true", "from work"), art("both", "library/p/a.md", "share: true", "from both"),
                                  art("work", "library/p/b.md", "share: true"), art("work", "library/p/c.md", "share: no"),
                                  art("private", "library/p/d.md", "share: true")], "brain string, path string, content string")
    flagged = pr.union_sources(lb.parse_articles(arts))
    assert {(r["rel"], r["brain"]) for r in flagged.collect()} == {("p/a.md", "both"), ("p/b.md", "work")}
    shared = spark.createDataFrame([("p/a.md", "old", "me"), ("p/c.md", "x", "me"), ("p/z.md", "y", "you")],
                                   "rel string, content string, contributor string")
    diff = {r["rel"]: r["action"] for r in pr.promote_diff(flagged, shared, "me").collect()}
    assert diff == {"p/a.md": "copy", "p/b.md": "copy", "p/c.md": "delete", "p/z.md": "keep"}
    alone = shared.drop("contributor")
    assert {r["rel"] for r in pr.shared_minus_flagged(alone, flagged).collect()} == {"p/c.md", "p/z.md"}
    after = promote(arts, alone)
    again = pr.promote_diff(flagged, after)
    assert {r["action"] for r in again.collect()} == {"same"}
    with pytest.raises(ValueError, match="contributor"):
        pr.promote_diff(flagged, alone, "me")
    for who in ("me", "me", "you", "you"):
        shared = pr.apply_promotion(flagged, shared, who)
    assert {(r["rel"], r["contributor"]) for r in shared.collect()} == {("p/a.md", "me"), ("p/b.md", "me")}
    counts = pr.promote_counts(pr.promote_diff(flagged, alone)).first()
    assert counts["line"] == "promote: 2 added/updated, 2 removed"


def test_changelog(spark):
    entries = spark.createDataFrame([("w", "compile", 1, 0, "create", "library/a.md", None), ("w", "compile", 1, 1, "skip", None, "thin"),
                                     ("w", "supervise", 3, 0, "skip", None, "coherent lib"), ("w", "supervise", 4, 0, "delete", "library/b.md", None)],
                                    "brain string, kind string, run_id long, seq int, action string, path string, note string")
    runs = spark.createDataFrame([("w", "compile", 1, date(2026, 1, 1), "03:00", "sum"), ("w", "compile", 2, date(2026, 1, 2), "03:00", ""),
                                  ("w", "supervise", 3, date(2026, 1, 2), "04:00", "seen"), ("w", "supervise", 4, date(2026, 1, 2), "05:00", "cut")],
                                 "brain string, kind string, run_id long, section_date date, hm string, summary string")
    out = ch.changelog(entries, runs).orderBy(*ch.changelog_sort())
    text = "\n".join(r["line"] for r in out.collect())
    head, _, rest = text.partition("_\n\n")
    assert head.startswith("# Library changelog\n\n_") and rest.split("\n") == [
        "## 2026-01-02", "", "- `03:00` — _no sessions in range; compile ran no-op._", "- `04:00` — _supervisor pass_: coherent lib",
        "- `05:00` — **supervisor delete** `b.md`", "  - supervisor summary: cut", "",
        "## 2026-01-01", "", "- `03:00` — **create** `a.md`", "- `03:00` — _skip_: thin", "  - session summary: sum", ""]


def test_moves_and_invariants(spark):
    edits = spark.createDataFrame([("w", "supervise", 1, 0, "delete", "library/a/x.md", None, None), ("w", "supervise", 1, 1, "create", "library/b/x.md", None, "c"),
                                   ("w", "supervise", 2, 0, "create", "library/c/x.md", None, "c")], EDITS)
    assert [(r["from_path"], r["to_path"]) for r in ed.move_pairs(edits).collect()] == [("library/a/x.md", "library/b/x.md")]


def test_backlinks_links_and_provenance(spark):
    c = catalog(spark, art(path="library/a.md", fmt="title: Retry storms in queues\nsources: [s1, s9]", body="See [[b]] and [[gone]]."),
                art(path="library/b.md", fmt="title: Billing\nrelated: [a]\nsources: [s1]", body="Retry storms in queues hurt."),
                art(path="library/c.md", fmt="title: Other", body="About retry  storms, in queues; and billing."))
    edges = {(r["path"], r["target"]): r["target_path"] for r in cu.link_graph(c).collect()}
    assert edges == {("library/a.md", "b"): "library/b.md", ("library/a.md", "gone"): None, ("library/b.md", "a"): "library/a.md"}
    missing = {(r["path"], r["title"]) for r in cu.missing_backlinks(c).collect()}
    assert missing == {("library/c.md", "retry storms in queues"), ("library/c.md", "billing")}
    sessions = spark.createDataFrame([("s1", "/x/src/Billing/"), ("s2", "/y")], "session_id string, cwd string")
    prov = {r["session_id"]: (r["n_articles"], r["state"]) for r in cu.article_provenance(c, sessions).collect()}
    assert prov == {"s1": (2, "used"), "s2": (0, "unused"), "s9": (1, "orphan")}
    assert [(r["project"], r["n_articles"]) for r in cu.project_clusters(c, sessions, least=2).collect()] == [("billing", 2)]


def test_titles_with_a_common_beginning_have_keys_of_their_own(spark):
    titles = spark.createDataFrame([("w", f"how to fix case {i}") for i in range(40)] + [("w", "how to"), ("w", "fix")], "brain string, title string")
    keyed = cu._title_keys(titles)
    assert keyed.count() == 42 and keyed.select("_key").distinct().count() == 42
    c = catalog(spark, *[art(path=f"library/{i}.md", fmt=f"title: How to fix case {i}", body=f"how to fix case {(i + 1) % 30} today") for i in range(30)])
    got = {(r["path"], r["title"]) for r in cu.missing_backlinks(c).collect()}
    assert got == {(f"library/{i}.md", f"how to fix case {(i + 1) % 30}") for i in range(30)}


def test_response_edits(spark):
    df = spark.createDataFrame([(1, "w", "compile", 1, "bad"), (1, "w", "compile", 2, BLOCK)],
                               "run_id long, brain string, kind string, attempt int, text string")
    assert [(r["run_id"], r["path"]) for r in response_edits(df).collect()] == [(1, "library/a.md")]


def test_whole_compile(spark):
    """Closed sessions to prompt sections; responses to history, twice; errors kept apart."""
    arts = spark.createDataFrame([art(path="library/old.md", fmt="title: Old")], "brain string, path string, content string")
    lines = spark.createDataFrame([("work", date(2026, 4, d), "080000", f"s{d}", f"080000_s{d}.md", n, f"l{n}") for d in (1, 2, 3) for n in (0, 1)],
                                  "brain string, log_date date, hhmmss string, session_id string, file_name string, line_no long, line string")
    got = compile_inputs(lines, arts, {"work": Cursor(date(2026, 4, 1))}, date(2026, 4, 3))
    assert [(r["session_file"], r["text"]) for r in got.filter("section = 3").orderBy("item").collect()] == [("080000_s2.md", "l0"), ("080000_s2.md", "l1")]
    assert got.filter("section < 3").count() == 2
    assert review_inputs(arts, "2026-04-03").count() == 3
    responses = spark.createDataFrame([(5, "work", "compile", 1, BLOCK + BLOCK.replace("library/a.md", "library/old.md") + BLOCK.replace("library/a.md", "x.md")),
                                       (6, "work", "compile", 1, "nothing")], "run_id long, brain string, kind string, attempt int, text string")
    versions = arts.selectExpr("brain", "path", "-1L as run_id", "0 as seq", "'create' as action", "content")
    once = apply_responses(versions, responses)
    assert {(r["path"], r["action"]) for r in once.filter("run_id = 5").collect()} == {("library/a.md", "create"), ("library/old.md", "update")}
    assert apply_responses(once, responses).count() == once.count() == 3
    assert sorted((r["run_id"], r["stage"]) for r in response_errors(responses).collect()) == [(5, "apply"), (6, "parse")]
