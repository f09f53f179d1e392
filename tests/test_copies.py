"""Copies read back as they were; what they share is stored once."""

import random
from datetime import date, timedelta

import pytest

from loomlog.operators import copies as cp
from loomlog.plans import upkeep
from loomlog.sources import changes

SCHEMA = "session_id string, store string, log_date date, line_no long, line string"


def rows_of(session, texts, day, store="work", step=1):
    return [(session, store, date(2026, 4, 1) + timedelta(day), 5 + i * step, t) for i, t in enumerate(texts)]


def back(spark, home):
    out = {}
    for r in cp.read_copies(spark, home).collect():
        out.setdefault((r.session_id, r.store, r.log_date), {})[r.position] = r.line
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_ten_days_cost_their_new_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cp, "EVERY", 8)
    rnd, home = random.Random(1), str(tmp_path)
    texts = [rnd.choice(["same", "", f"line {i} é"]) for i in range(600)]
    expected, cost = {}, []
    for day in range(10):
        own = texts[: 330 + 30 * day]
        rows = rows_of("s", own, day, step=3) + rows_of("t", own[:40], day)
        assert cp.write_copies(spark.createDataFrame(rows, SCHEMA), home, f"d{day}", chunk_width=50)
        expected |= {("s", "work", date(2026, 4, 1) + timedelta(day)): own, ("t", "work", date(2026, 4, 1) + timedelta(day)): own[:40]}
        cost.append(spark.read.parquet(f"{home}/lines").count())
    assert back(spark, home) == expected
    # The first day stores its lines (equal pieces once); each other day its new ones and the piece it went on from.
    assert cost[0] <= 370 and all(b - a <= 30 + 100 for a, b in zip(cost, cost[1:])) and cost[-1] < 1500 < sum(map(len, expected.values())) / 3
    assert not cp.write_copies(spark.createDataFrame(rows_of("s", ["other"], 0), SCHEMA), home, "d0")
    cp.write_copies(spark.createDataFrame(rows_of("s", ["other"], 0), SCHEMA), home, "again")
    assert back(spark, home) == expected


def test_pieces_have_a_bound(spark):
    numbered = cp.cut(spark.createDataFrame(rows_of("s", ["same"] * 9000, 0), SCHEMA), chunk_width=1000)
    assert max(r.n_lines for r in cp.pieces_of(numbered).collect()) <= cp.MOST


def test_copies_are_purged(spark, tmp_path):
    home = str(tmp_path)
    cp.write_copies(spark.createDataFrame(rows_of("s", ["a"], 0) + rows_of("t", ["a"], 0), SCHEMA), home, "d")
    gone = spark.createDataFrame([("s", "nolog")], "session_id string, scope string")
    assert upkeep.purge_stored(spark, home, gone, {f"{home}/pieces": ["store", "log_date"], f"{home}/lines": []}, "p")
    assert list(back(spark, home)) == [("t", "work", date(2026, 4, 1))]
    assert {r.session_id for r in spark.read.parquet(f"{home}/lines").collect()} == {"t"}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_cut_off(spark, tmp_path, monkeypatch, n):
    home, left = str(tmp_path), [n]
    rows = spark.createDataFrame(rows_of("s", ["a", "b"], 0), SCHEMA)
    with monkeypatch.context() as m:
        for name in ("_move", "_write"):
            def step(*args, f=getattr(changes, name)):
                left[0] -= 1
                if left[0] < 0:
                    raise InterruptedError
                return f(*args)
            m.setattr(changes, name, step)
        with pytest.raises(InterruptedError):
            cp.write_copies(rows, home, "d")
    cp.write_copies(rows, home, "d")
    assert back(spark, home) == {("s", "work", date(2026, 4, 1)): ["a", "b"]}
