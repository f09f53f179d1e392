from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loomlog.functions import titles as tt
from loomlog.operators import routing as ro
from loomlog.operators import sessions as se
from loomlog.operators.compile_window import (Cursor, advance_cursor, calendar_gaps, closed_day_cutoff, parse_cursor,
                                              pending_sessions)
from loomlog.sources import sinks
from loomlog.sources.config import RoutingConfig, load_routing_config


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("title,want", [
    (' "a: b" ', "a- b"), ("'x'", "x"), ("<>:?*", "session"), ("", "session"), (None, None), ("..a  b..", "a b"),
    ("a\\b|c", "a-b-c"), ("a\u00a0\u00a0b", "a b"), (" \t\u2003", "session")])
def test_sanitize(spark, title, want):
    assert one(spark, tt.sanitize_title, title) == want


@pytest.mark.parametrize("title,scope,clean", [
    ("[work] Plan", "work", "Plan"), ("  [WORK]", "work", None), ("[Private]x", "private", "x"), ("[nolog] y", "nolog", "y"),
    ("work [work]", None, "work [work]"), (None, None, None), ("  ", None, None), ("[both]  [work] z", "both", "[work] z")])
def test_prefix(spark, title, scope, clean):
    assert one(spark, tt.prefix_scope, title) == scope
    assert one(spark, tt.clean_title, title) == clean


@pytest.mark.parametrize("name,hhmmss,session", [
    ("080910_my_title_s-1.md", "080910", "s-1"), ("080910_s-1.jsonl", "080910", "s-1"), ("x_s-1.md", None, "s-1")])
def test_log_names(spark, name, hhmmss, session):
    assert one(spark, tt.log_name_time, name) == hhmmss
    assert one(spark, tt.log_name_session, name) == session


def test_log_file_name(spark):
    df = spark.createDataFrame([("080910", "a: b", "s"), ("080910", None, "s"), ("080910", "", "s")], "h string, t string, s string")
    got = [r[0] for r in df.select(tt.log_file_name(F.col("h"), F.col("t"), F.col("s"))).collect()]
    assert got == ["080910_a- b_s", "080910_s", "080910_s"]


def test_rules(spark):
    rules = (("", "work"), ("source/x", None), ("source", "both"))
    rows = [("C:\\source\\x", "unset"), ("/a/source/y", "both"), ("/Source", "private"), (None, "private")]
    df = spark.createDataFrame([(c,) for c, _ in rows], "cwd string")
    got = [r[0] for r in df.select(ro.first_rule(F.col("cwd"), rules, "private")).collect()]
    assert got == [w for _, w in rows]


CONFIG = """
default_scope = "unset"
log_tool_calls = "minimal"
[[rule]]
match = "source/private"
scope = "private"
[[rule]]
match = "x"
[brains]
private = "/p"
both = ""
"""


def test_config(spark, tmp_path):
    path = tmp_path / "c.toml"
    path.write_text(CONFIG)
    c = load_routing_config(str(path))
    assert c.rules == (("source/private", "private"), ("x", "unset")) and c.stores == {"private": "/p"}
    assert c.log_tool_calls == "minimal" and c.auto_sync
    assert c.rules_df(spark).count() == 2 and c.stores_df(spark).first()["store"] == "/p"
    path.write_text("not = [toml")
    assert load_routing_config(str(path)) == RoutingConfig() == load_routing_config(str(tmp_path / "none"))


def test_purge_and_migrate(spark):
    d = date(2026, 4, 1)
    rows = spark.createDataFrame([("work", d, "a"), ("work", d, "b"), ("unclassified", d, "a")],
                                 "store string, log_date date, session_id string")
    sessions = spark.createDataFrame([("a", "nolog", "unclassified"), ("b", "work", "work"), ("c", "work", "work"), ("u", "unset", "unclassified")],
                                     "session_id string, scope string, store string")
    left = ro.purge_nolog(rows, sessions)
    assert [(r["store"], r["session_id"]) for r in left.collect()] == [("work", "b")]
    assert ro.purge_nolog(left, sessions).count() == 1
    assert {r["store"] for r in ro.purge_partitions(rows, sessions).collect()} == {"work", "unclassified"}
    marks = spark.createDataFrame([("a",), ("b",)], "session_id string")
    assert [r[0] for r in ro.cleared_marks(marks, sessions).collect()] == ["b"]
    staged = spark.createDataFrame([(s, d) for s in "abcuz"], "session_id string, log_date date")
    state = {r["session_id"]: r["state"] for r in ro.migrate_unclassified(staged, sessions, rows).collect()}
    assert state == {"a": "waiting", "b": "clash", "c": "moved", "u": "waiting", "z": "waiting"}


def test_window_and_cursor(spark, tmp_path):
    logs = spark.createDataFrame(
        [("w", date(2026, 4, d), f"0{h}0000", s, f"0{h}0000_new name_{s}.md") for d, h, s in
         [(1, 8, "a"), (1, 9, "b"), (1, 9, "c"), (2, 7, "d"), (4, 7, "e"), (5, 7, "f")]],
        "brain string, log_date date, hhmmss string, session_id string, file_name string")
    today = date(2026, 4, 5)

    def pend(cursor, **kw):
        return sorted(r["session_id"] for r in pending_sessions(logs, {"w": cursor}, today, **kw).collect())
    assert pend(Cursor(date(2026, 4, 1))) == ["d", "e"]
    # The session was renamed since the cursor was written; its key still counts.
    mid = parse_cursor("2026-04-01\n090000_old name_b.md\n")
    assert pend(mid) == ["c", "d", "e"]
    assert pend(mid, day=date(2026, 4, 1)) == ["a", "b", "c"]
    assert pend(Cursor(date(2026, 4, 4))) == []
    assert closed_day_cutoff(logs, today).count() == 5
    p = pending_sessions(logs, {"w": mid}, today)
    assert [r["log_date"] for r in calendar_gaps(p, {"w": mid}, today).collect()] == [date(2026, 4, 3)]
    root = str(tmp_path / "cursor")
    assert sinks.read_cursor(spark, root).count() == 0
    sinks.write_cursor(advance_cursor(p.filter("session_id = 'c'"), "2026-04-05 01:00:00"), root)
    sinks.write_cursor(advance_cursor(p, "2026-04-05 02:00:00"), root)
    row = sinks.read_cursor(spark, root).collect()
    assert len(row) == 1 and row[0]["cursor_session"].endswith("_e.md")
    assert pend(Cursor(row[0]["cursor_date"], row[0]["cursor_session"])) == []


def test_narrative(spark):
    turns = spark.createDataFrame([("s", 0, "user", datetime(2026, 4, 1, 8, 0, 0), "hi"), ("s", 1, "assistant", datetime(2026, 4, 1, 8, 0, 5), "ok"),
                                   ("s", 2, "system", datetime(2026, 4, 1, 8, 0, 6), "no")], "session_id string, line_no long, role string, ts timestamp, text string")
    sessions = spark.createDataFrame([("s", "work", "w", None)], "session_id string, scope string, store string, title string")
    text = "".join(r["text"] for r in se.session_narrative(turns, sessions).orderBy("line_no").collect())
    assert text == ("# Claude session: s\n\n_session_id: s_  \n_scope: work_  \n_Started: 2026-04-01 08:00:00_\n\n"
                    "\n## [08:00:00] User\n\nhi\n\n### [08:00:05] Claude\n\nok\n\n---\n\n")


def test_errors_are_whole_and_shown_cut(spark):
    df = spark.createDataFrame([("k", "x" * 900)], "k string, m string")
    row = sinks.errors(df, F.lit("2026-01-01").cast("timestamp"), "stage", F.col("k"), F.col("m")).first()
    assert len(row["shown"]) == 500 and row["message"] == "x" * 900 and row["stage"] == "stage"


def test_current_scopes(spark):
    df = spark.createDataFrame([("s", 1, "unset"), ("s", 2, "work")], "session_id string, ts long, scope string")
    assert se.current_scopes(df).first()["scope"] == "work"
