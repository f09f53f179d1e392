"""The machine against a plain walk, formatted text against the marks, whole round trips."""

import random

import pytest
from pyspark.sql import functions as F

from loomlog.llm import chat_format as cf
from loomlog.session import fresh_folder

SCHEMA = "conv_id long, turn long, role string, text string, at long, _hash string, segments int"


def formatted(spark, rows, template=cf.DEFAULT):
    path = fresh_folder(spark, "chats")
    cf.write_chats(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), path, template)
    return path, cf.read_chats(spark, path, template)


def test_round_trip_and_loss(spark):
    rnd = random.Random(3)
    bits = [*cf.DEFAULT.all_marks(), "\\", "\\\\", "<", "/s>", "[", "\n", "é", "𝒳", " ", "x", "<\\/s>", "\\</s>"]
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "tool", "", "[SAYS]"]), "".join(rnd.choices(bits, k=rnd.randrange(9))))
            for c in range(30) for t in range(rnd.randrange(1, 7))]
    path, turns = formatted(spark, rows)
    got = turns.orderBy("conv_id", "at").collect()
    assert [(r.conv_id, r.role, r.text) for r in got] == [(c, r, x) for c, _, r, x in rows]
    for r in got:
        assert r.learned == (r.text if r.role == "assistant" else "")
        assert sum(r.formatted.count(m) for m in cf.DEFAULT.all_marks()) == (2 if r.role in cf.DEFAULT.marks else 3)
    whole = {r.conv_id: r for r in cf.documents(spark.read.parquet(path)).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in got if r.conv_id == c]
        assert whole[c].text == "".join(r.formatted for r in own)
        spans = [whole[c].text[s.start : s.end] for s in whole[c].loss]
        assert len(spans) == sum(r.role == "assistant" for r in own)
        assert "".join(spans).replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == "".join(r.learned for r in own)


def test_nulls_ties_and_empty(spark):
    rows = [(None, 1, "user", "a"), (None, None, "assistant", None), (1, 2, None, "x"), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, None, "system", "")]
    _, turns = formatted(spark, rows)
    got = [(r.conv_id, r.role, r.text) for r in turns.orderBy("conv_id", "at").collect()]
    assert got == [(None, "assistant", ""), (None, "user", "a"), (1, "system", ""), (1, "", "x"), (1, "user", "b"), (1, "user", "b")]
    found = {r.conv_id: (r.n_turns, r.valid, r.bad_turn) for r in cf.validated(turns).collect()}
    assert found == {None: (2, False, 1), 1: (4, False, 2)}
    _, none = formatted(spark, [])
    assert none.count() == cf.validated(none).count() == 0


def test_long_text(spark):
    text = "[/INST]\\" * 200_000
    _, turns = formatted(spark, [(1, 0, "user", text), (1, 1, "assistant", text)])
    assert turns.filter(F.col("text") != text).count() == 0 and turns.filter("learned <> ''").count() == 1


def test_machine_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(cf, "BLOCK_BITS", 2)
    rnd = random.Random(5)
    template = cf.Template(moves={**cf.DEFAULT.moves, ("asked", "tool"): "used", ("used", "assistant"): "asked", ("told", "system"): "told"},
                           ends=("answered", "told"))
    chats, expected = [], {}
    for c in range(60):
        state, bad = "start", None
        for t in range(rnd.randrange(1, 120 if c < 20 else 5)):
            open_moves = [r for (s, r) in template.moves if s == state]
            role = rnd.choice(open_moves) if open_moves and rnd.random() < 0.97 else rnd.choice(["user", "assistant", "system", "tool", ""])
            chats.append((c, t, role))
            state = template.moves.get((state, role)) if state else None
            if state is None and bad is None:
                bad = t + 1
        expected[c] = (t + 1, state in template.ends, bad)
    turns = spark.createDataFrame(chats, "conv_id long, at long, role string").withColumn("at", F.col("at") * 3 + F.col("conv_id"))
    assert {r.conv_id: (r.n_turns, r.valid, r.bad_turn) for r in cf.validated(turns, template).collect()} == expected


@pytest.mark.parametrize("marks", [{"user": ("<a>", "<a>")}, {"user": ("ab", "ba")}, {"user": ("[U]", "x[U]y")}, {"user": ("\\u", "[/U]")}])
def test_marks_that_could_mislead(marks):
    with pytest.raises(ValueError):
        cf.Template(marks=marks)


def test_other_template(spark):
    template = cf.Template(marks={"user": ("<|u|>", "<|/u|>"), "assistant": ("<|a|>", "<|/a|>")}, other=("<|r|>", "<|t|>", "<|/r|>"), learn=())
    _, turns = formatted(spark, [(1, 0, "system", "<|u|>"), (1, 1, "user", "<|t|>\\")], template)
    got = turns.orderBy("at").collect()
    assert [r.formatted for r in got] == ["<|r|>system<|t|><\\|u|><|/r|>", "<|u|><\\|t|>\\\\<|/u|>"]
    assert [r.text for r in got] == ["<|u|>", "<|t|>\\"] and {r.learned for r in got} == {""}
