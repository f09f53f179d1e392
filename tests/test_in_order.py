"""Ordered streams: the same rows however they are cut into batches, restarted, or cut off."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import StreamingQueryException

from loomlog.sources import changes
from loomlog.sources.config import RoutingConfig
from loomlog.sources.sinks import append_partitioned, stored
from loomlog.streaming import in_order

SECOND = 1_000_000


def turn_events(seed, n=160):
    rnd, rows = random.Random(seed), []
    for s in ("a", "b", "c", "hot", "hot", "hot"):
        for _ in range(n // 6):
            kind = rnd.choice(["open", "said", "said", "said", "stop"])
            scope = rnd.choice(["work", "work", "nolog"]) if kind == "stop" else None
            rows.append((s, rnd.randrange(400) * SECOND, int(kind == "stop"), len(rows), kind, f"t{len(rows)}" if kind == "said" else None,
                         "w" if kind == "stop" else None, scope))
    return sorted(rows, key=lambda r: (r[1], r[2], r[3]))


def plain_turns(rows):
    out, said = [], defaultdict(list)
    for s, at, _, pos, kind, text, _, scope in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        if kind == "said":
            said[s].append((pos, text))
            continue
        if kind == "stop" and scope != "nolog":
            out += [(s, pos, n, t) for n, t in said[s]]
        said[s] = []
    return sorted(out)


def feed(spark, job, batches, first=0):
    for n, rows in enumerate(batches, first):
        job.work(spark, spark.createDataFrame(rows, job.schema), f"b-{n}")


def logged(spark, home):
    rows = stored(spark, f"{home}/turns")
    return [] if rows is None else sorted((r.session_id, r.event_id, r.line_no, r.text) for r in rows.collect())


def cut(rows, n, seed, disorder):
    """Rows in n batches, each up to `disorder` places from where it belongs."""
    rnd = random.Random(seed)
    moved = [r for _, r in sorted(((i + rnd.randrange(disorder + 1), r) for i, r in enumerate(rows)), key=lambda x: x[0])]
    size = -(-len(moved) // n)
    return [moved[i : i + size] for i in range(0, len(moved), size)]


@pytest.mark.parametrize("n, disorder", [(1, 0), (4, 0), (7, 12)])
def test_turns_do_not_depend_on_batches(spark, tmp_path, n, disorder):
    rows, home = turn_events(n), str(tmp_path)
    job = in_order.stopped_turns(home, 200 * SECOND, chunk=20 * SECOND)
    parts = cut(rows, n, n, disorder)
    feed(spark, job, parts)
    feed(spark, job, parts[-1:], len(parts) - 1)  # the last batch comes again after a restart
    assert n < 3 or 0 < len(logged(spark, home)) < len(plain_turns(rows))
    job.finish(spark)
    assert logged(spark, home) == plain_turns(rows) and stored(spark, f"{home}/errors") is None


@pytest.mark.parametrize("n", [0, 1, 2, 4, 7])
def test_cut_off_batch(spark, tmp_path, monkeypatch, n):
    """The driver is lost within the second of three batches."""
    rows, home = turn_events(9, 60), str(tmp_path)
    job = in_order.stopped_turns(home, 50 * SECOND)
    parts = cut(rows, 3, 1, 0)
    feed(spark, job, parts[:1])
    left = [n]

    def failing(step):
        def run(*args):
            left[0] -= 1
            if left[0] < 0:
                raise InterruptedError
            return step(*args)
        return run

    with monkeypatch.context() as m:
        for name in ("_delete", "_move", "_write"):
            m.setattr(changes, name, failing(getattr(changes, name)))
        with pytest.raises(InterruptedError):
            feed(spark, job, parts[1:2], 1)
    feed(spark, job, parts[1:], 1)
    job.finish(spark)
    assert logged(spark, home) == plain_turns(rows)


def test_late_rows_become_errors(spark, tmp_path):
    home = str(tmp_path)
    job = in_order.stopped_turns(home, 10 * SECOND)
    feed(spark, job, [[("s", 100 * SECOND, 0, 1, "said", "x", None, None)], [("s", 50 * SECOND, 0, 0, "said", "late", None, None), ("s", 101 * SECOND, 1, 2, "stop", None, "w", "work")]])
    job.finish(spark)
    assert logged(spark, home) == [("s", 2, 1, "x")]
    error = spark.read.parquet(f"{home}/errors").first()
    assert error["key"] == "s" and '"text":"late"' in error["message"]


@pytest.mark.parametrize("n, disorder", [(1, 0), (5, 8)])
def test_scopes_and_what_follows(spark, tmp_path, n, disorder):
    rnd, home = random.Random(n), str(tmp_path)
    rows = [(rnd.choice("abcdef"), i * SECOND, i, rnd.choice(["unset", "unset", "work", "private", "nolog"] if i % 7 == 0 else ["unset", "work"]), "st", False) for i in range(70)]
    logs = spark.createDataFrame([(s, f"2026-04-0{d}") for s in "abcdefg" for d in (1, 2)], "session_id string, day string").select("session_id", F.to_date("day").alias("log_date"))
    append_partitioned(logs, f"{home}/staged", ["log_date"])
    job = in_order.scope_history(home, 20 * SECOND, chunk=5 * SECOND)
    for i, part in enumerate(cut(rows, n, n, disorder)):
        job.work(spark, spark.createDataFrame(part, job.schema), f"b-{i}")
        in_order.apply_scopes(spark, home, f"{home}/logs", f"{home}/staged", f"a-{i}")
    job.finish(spark)
    in_order.apply_scopes(spark, home, f"{home}/logs", f"{home}/staged", "a-end")

    was, expected, last, gone = {}, [], {}, set()
    for s, _, i, scope, _, _ in rows:
        if s in was and was[s] != scope and (scope == "nolog" or was[s] == "unset"):
            expected.append((s, i, was[s], scope, "purge" if scope == "nolog" else "migrate"))
            last[s] = scope
            gone |= {s} if scope == "nolog" else set()
        was[s] = scope
    got = sorted((r.session_id, r.event_id, r.was, r.scope, r.action) for r in spark.read.parquet(f"{home}/changes").collect())
    assert got == sorted(expected)
    moved = stored(spark, f"{home}/logs")
    assert {r.session_id for r in moved.collect()} == set(last) - gone if moved is not None else not set(last) - gone
    assert {r.session_id for r in spark.read.schema("session_id string, log_date date").parquet(f"{home}/staged").collect()} == set("abcdefg") - set(last)


def test_bad_payloads_do_not_end_the_stream(spark, tmp_path):
    home, source = str(tmp_path / "home"), tmp_path / "in"
    source.mkdir()
    long = "no json " * 500
    config = RoutingConfig(rules=(("infra", "work"),), stores={"work": "w"})

    def run():
        lines = spark.readStream.text(str(source)).withColumn("ts", F.current_timestamp())
        in_order.log_payloads(lines, config, home, f"{home}/state")

    (source / "a.txt").write_text('{"session_id":"s","cwd":"/infra","prompt":"p","mode":"prompt"}\n' + long + "\n[1]\n")
    run()
    (source / "b.txt").write_text('{"session_id":"t","cwd":"/x","prompt":"q","mode":"prompt"}\n{bad\n')
    run()
    run()
    assert sorted((r.session_id, r.prompt, r.store) for r in spark.read.parquet(f"{home}/prompts").collect()) == [("s", "p", "w"), ("t", "q", "unclassified")]
    errors = {r.message: r.shown for r in spark.read.parquet(f"{home}/errors").collect()}
    assert set(errors) == {long, "[1]", "{bad"} and len(errors[long]) == 500
    assert sorted((r.batch, r.n_lines, r.n_bad) for r in spark.read.parquet(f"{home}/batches").collect()) == [(0, 3, 2), (1, 2, 1)]


def test_stream_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that fails before its commit is worked again by the same checkpoint."""
    home, source = str(tmp_path / "home"), str(tmp_path / "in")
    rows = turn_events(3, 60)
    job = in_order.stopped_turns(home, 0)
    spark.createDataFrame(rows, job.schema).coalesce(1).write.parquet(source)

    def run():
        job.run(spark.readStream.schema(job.schema).parquet(source), str(tmp_path / "state"))

    with monkeypatch.context() as m:
        m.setattr(changes.Change, "commit", lambda self: (_ for _ in ()).throw(InterruptedError("lost")))
        with pytest.raises(StreamingQueryException):
            run()
    run()
    run()
    job.finish(spark)
    assert logged(spark, home) == plain_turns(rows)
