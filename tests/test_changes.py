"""Changes that are cut off after any step end right, and touch no other file."""

import os
import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from loomlog.plans import upkeep
from loomlog.sources import changes
from loomlog.sources.sinks import append_partitioned

LOGS = "store string, log_date date, session_id string, line_no long"
DAYS = [date(2026, 4, d) for d in (1, 2, 3)]


class Crash(Exception):
    pass


def crash_after(monkeypatch, n):
    """The driver is lost at step n: after n deletions, moves and records."""
    left = [n]

    def counted(step):
        def run(*args):
            if left[0] == 0:
                raise Crash
            left[0] -= 1
            return step(*args)
        return run

    for name in ("_delete", "_move", "_write"):
        monkeypatch.setattr(changes, name, counted(getattr(changes, name)))


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def content(spark, root):
    return sorted(tuple(map(str, r)) for r in spark.read.parquet(root).select("store", "log_date", "session_id", "line_no").collect()) if files(root) else []


@pytest.fixture()
def logs(spark, tmp_path):
    rows = [("work", day, s, n) for day in DAYS for s in ("a", "b", "c") for n in range(3) if not (s == "a" and day == DAYS[2])]
    append_partitioned(spark.createDataFrame(rows, LOGS), str(tmp_path / "logs"), ["store", "log_date"])
    append_partitioned(spark.createDataFrame([("x", DAYS[1], "a", 9)], LOGS), str(tmp_path / "logs"), ["store", "log_date"])
    spark.createDataFrame([("a",), ("b",)], "session_id string").coalesce(1).write.parquet(str(tmp_path / "marks"))
    return str(tmp_path)


def sessions(spark, **scopes):
    return spark.createDataFrame([(s, scope, scope) for s, scope in scopes.items()], "session_id string, scope string, store string")


def purge(spark, home, name="p"):
    return upkeep.purge_stored(spark, home, sessions(spark, a="nolog", b="work"), {f"{home}/logs": ["store", "log_date"], f"{home}/marks": []}, name)


def test_purge(spark, logs):
    before, old = files(f"{logs}/logs"), content(spark, f"{logs}/logs")
    assert purge(spark, logs) and not purge(spark, logs, "again")
    after = files(f"{logs}/logs")
    assert content(spark, f"{logs}/logs") == [r for r in old if r[2] != "a"]
    kept = {f for f in before if "log_date=2026-04-03" in f}
    assert kept and kept <= after and len(after - before) > 0
    assert not os.path.exists(f"{logs}/logs/store=x")  # nothing is left of it
    assert [r[0] for r in spark.read.parquet(f"{logs}/marks").collect()] == ["b"]


@pytest.mark.parametrize("n", range(0, 14))
def test_purge_cut_off(spark, logs, monkeypatch, n):
    old = content(spark, f"{logs}/logs")
    with monkeypatch.context() as m:
        crash_after(m, n)
        try:
            purge(spark, logs)
        except Crash:
            pass
    if n == 0:  # not committed: nothing shows
        assert content(spark, f"{logs}/logs") == old
    purge(spark, logs, "p" if n == 0 else "next")
    assert content(spark, f"{logs}/logs") == [r for r in old if r[2] != "a"]
    assert not files(f"{logs}/{changes.FOLDER}") and not purge(spark, logs, "last")


def test_rows_added_meanwhile_stay(spark, logs):
    changes.settle(spark, logs)
    change = changes.Change(spark, logs, "c")
    change.remove(f"{logs}/logs", spark.createDataFrame([("a",)], "session_id string"), ["session_id"], ["store", "log_date"])
    append_partitioned(spark.createDataFrame([("work", DAYS[0], "new", 1)], LOGS), f"{logs}/logs", ["store", "log_date"])
    change.run()
    got = content(spark, f"{logs}/logs")
    assert ("work", "2026-04-01", "new", "1") in got and not [r for r in got if r[2] == "a"] and len(got) == 9 + 6 + 1 + 3 - 3 + 3


def test_two_writers_on_the_same_files(spark, logs):
    gone = spark.createDataFrame([("a",)], "session_id string")
    one, two = (changes.Change(spark, logs, n) for n in ("one", "two"))
    for c in (one, two):
        c.remove(f"{logs}/logs", gone, ["session_id"], ["store", "log_date"])
    one.run()
    with pytest.raises(RuntimeError, match="another writer"):
        two.run()
    with pytest.raises(ValueError, match="committed"):
        changes.Change(spark, logs, "one")


@pytest.mark.parametrize("n", [None, 0, 1, 2, 3, 5, 8])
def test_migrate(spark, tmp_path, monkeypatch, n):
    home = str(tmp_path)
    staged = [(day, s, i) for day in DAYS[:2] for s in ("a", "b", "c", "d") for i in range(2)]
    append_partitioned(spark.createDataFrame(staged, "log_date date, session_id string, line_no long"), f"{home}/staged", ["log_date"])
    append_partitioned(spark.createDataFrame([("work", DAYS[0], "a", 7)], LOGS), f"{home}/logs", ["store", "log_date"])
    known = sessions(spark, a="work", b="private", c="unset", d="nolog")
    pair = [(f"{home}/staged", f"{home}/logs")]
    if n is not None:
        with monkeypatch.context() as m:
            crash_after(m, n)
            try:
                upkeep.migrate_stored(spark, home, known, pair, "m")
            except Crash:
                pass
    assert upkeep.migrate_stored(spark, home, known, pair, "m" if n in (None, 0) else "m2") == (n in (None, 0))
    got = content(spark, f"{home}/logs")
    assert got == sorted([("work", "2026-04-01", "a", "7"), *[("work", "2026-04-02", "a", str(i)) for i in range(2)],
                          *[("private", str(day), "b", str(i)) for day in DAYS[:2] for i in range(2)]])
    left = sorted((str(r.log_date), r.session_id) for r in spark.read.parquet(f"{home}/staged").distinct().collect())
    assert left == sorted([("2026-04-01", "a")] * 2 + [(str(day), s) for day in DAYS[:2] for s in "cd" for _ in range(2)])


def test_versions_of_a_purged_session(spark, tmp_path):
    home = str(tmp_path)
    def text(sources):
        return f"---\ntitle: T\nsources: [{sources}]\n---\nx"
    versions = [("work", "library/a.md", 1, 0, text("s1")), ("work", "library/a.md", 2, 0, text("s1, s2")), ("both", "library/b.md", 1, 0, text("s3"))]
    append_partitioned(spark.createDataFrame(versions, "brain string, path string, run_id long, seq int, content string"), f"{home}/versions", ["brain"])
    before = files(f"{home}/versions/brain=both")
    assert upkeep.purge_stored(spark, home, sessions(spark, s2="nolog"), {f"{home}/none": []}, "p", f"{home}/versions")
    assert sorted((r.path, r.run_id) for r in spark.read.parquet(f"{home}/versions").collect()) == [("library/a.md", 1), ("library/b.md", 1)]
    assert files(f"{home}/versions/brain=both") == before


@pytest.mark.parametrize("n", range(0, 6))
def test_run_shows_as_a_whole(spark, tmp_path, monkeypatch, n):
    """After a crash readers who settle see all tables of the run or none."""
    home = str(tmp_path)
    def parts():
        rows = spark.range(6).select((F.col("id") % 2).alias("brain"), "id")
        return {f"{home}/versions": (rows, ["brain"]), f"{home}/log": (rows.coalesce(1), []), f"{home}/cursor": (spark.range(1), [])}
    with monkeypatch.context() as m:
        crash_after(m, n)
        try:
            upkeep.commit_run(spark, home, "run-1", parts())
        except Crash:
            pass
    changes.settle(spark, home)
    seen = [bool(files(f"{home}/{t}")) for t in ("versions", "log", "cursor")]
    assert seen == [n > 0] * 3
    assert upkeep.commit_run(spark, home, "run-1", parts()) == (n == 0)
    assert [spark.read.parquet(f"{home}/{t}").count() for t in ("versions", "log", "cursor")] == [6, 6, 1]


def test_files_are_moved_at_the_same_time(spark, tmp_path, monkeypatch):
    """A change of many files does not wait for one after the other."""
    home, both, move = str(tmp_path), threading.Barrier(2, timeout=30), changes._move
    change = changes.Change(spark, home, "c")
    change.add(spark.range(2).select("id", F.col("id").alias("part")), f"{home}/t", ["part"])

    def met(spark, file, to):
        if file.endswith(".parquet"):
            both.wait()
        move(spark, file, to)

    monkeypatch.setattr(changes, "_move", met)
    change.run()
    assert spark.read.parquet(f"{home}/t").count() == 2
