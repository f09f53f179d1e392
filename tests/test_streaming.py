from datetime import datetime

import pytest

import __spark_entry__ as entry
from loomlog.fixtures import fixture
from loomlog.registry import CONFIG, _stream_events
from loomlog.sources import readers
from loomlog.streaming import streams


def test_stream_equals_batch(spark, sf_dir):
    batch = streams.log_turns(fixture(spark, sf_dir, "hook_events"), CONFIG)
    folder = streams.run_once(streams.log_turns(_stream_events(streams.stream_table(spark, f"{sf_dir}/events.parquet")), CONFIG),
                              spark, "t", ["store", "log_date"])
    cols = ["event_id", "store", "scope", "prompt"]
    back = spark.read.parquet(folder).select(*cols)
    assert back.exceptAll(batch.select(*cols)).count() == 0 and back.count() == batch.count()


def test_hook_lines(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text('{"session_id":"s","cwd":"/x","prompt":"p","mode":"prompt"}\n{bad\n[1]\n{"mode":"stop"}\n')
    rows = readers.read_hook_events(spark, str(src)).collect()
    assert [(r["session_id"], r["cwd"], r["prompt"], r["mode"]) for r in rows] == [("s", "/x", "p", "prompt"), ("unknown", "", "", "stop")]
    folder = streams.run_once(readers.read_hook_events(spark, str(src), streaming=True), spark, "hooks")
    assert spark.read.parquet(folder).count() == 2


@pytest.fixture()
def log_table(spark, tmp_path):
    def add(*rows):
        spark.createDataFrame(list(rows), "store string, log_date string, session_id string").write.mode("append").parquet(str(tmp_path / "logs"))
    return str(tmp_path / "logs"), str(tmp_path / "done"), add


@pytest.mark.parametrize("keep_state", [False, True])
def test_incremental_compile(spark, log_table, tmp_path, keep_state):
    source, done, add = log_table
    state = str(tmp_path / "state") if keep_state else None
    add(("w", "2026-04-01", "a"), ("w", "2026-04-01", "b"))
    for _ in range(2):
        streams.compile_new_sessions(spark, source, done, state)
    assert spark.read.parquet(done).count() == 2
    add(("w", "2026-04-01", "b"), ("w", "2026-04-02", "b"))
    streams.compile_new_sessions(spark, source, done, state)
    # The day is a partition folder, which a reader without a schema takes for a date.
    assert sorted((str(r["log_date"]), r["session_id"]) for r in spark.read.parquet(done).collect()) == [
        ("2026-04-01", "a"), ("2026-04-01", "b"), ("2026-04-02", "b")]


def test_closed_days_and_marks(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [("s", datetime(2026, 4, 1, 9), "w"), ("s", datetime(2026, 4, 1, 10), "w"), ("t", datetime(2026, 4, 5), "w")]
    spark.createDataFrame(rows, "session_id string, ts timestamp, store string").coalesce(1).write.parquet(src)
    closed = streams.run_once(streams.closed_days(streams.stream_table(spark, src)), spark, "closed")
    assert [(str(r["log_date"]), r["n_events"]) for r in spark.read.parquet(closed).collect()] == [("2026-04-01", 2)]
    marks = streams.run_once(streams.first_events_within(streams.stream_table(spark, src)), spark, "marks")
    assert sorted(r["session_id"] for r in spark.read.parquet(marks).collect()) == ["s", "t"]


def test_state_store_setting_stays_in_its_own_session(spark, sf_dir):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    entry.queries()["reclassify_stream"](spark, sf_dir)
    assert spark.conf.get(key) == before
