"""Segments against brute force; fitting and scoring on a small corpus."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomlog.llm import toxicity as tx


def brute(scores):
    """Maximal segments: take the best one, then do the same on both sides of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2]):
                best = (i, j + 1, total)
    if best is None:
        return []
    s, e, _ = best
    return [*brute(scores[:s]), best, *((a + e, b + e, v) for a, b, v in brute(scores[e:]))]


def test_segments():
    rng = random.Random(2)
    for _ in range(150):
        scores = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() / 64 for _ in range(rng.randint(0, 40))]
        found = tx.segments(np.array(scores, dtype=float))
        assert [(a, b, round(v, 6)) for a, b, v in found] == [(a, b, round(v, 6)) for a, b, v in brute(scores)]


def test_scores(spark):
    rng = random.Random(4)
    calm, bad = [f"w{i}" for i in range(300)], ["vile", "awful", "nasty"]
    rows = []
    for i in range(400):
        words = rng.choices(calm, k=rng.randint(5, 120))
        if i % 4 == 0:
            words[2:2] = rng.choices(bad, k=4)
        rows.append((i, " ".join(words).capitalize() + ".", int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (900, "", "x"), (901, "calm vile, NASTY. awful", "x"), (901, "w1 " * 5000, "x")],
                                 "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = tx.fit(docs, labels, F.col("doc_id") % 3 != 1)
    assert {w for w, s in model.words.items() if s > 0} == set(bad)
    found = tx.toxicity(docs, model).collect()
    by = {(r.doc_id, len(r.passages)): r.score for r in found}
    truth = {i: y for i, _, y in rows}
    held = [(r.score, truth[r.doc_id]) for r in found if r.doc_id in truth and r.doc_id % 3 == 1]
    assert min(s for s, y in held if y) > 0.7 > 0.3 > max(s for s, y in held if not y)
    assert len(found) == 404 and max(s for (d, n), s in by.items() if d in (None, 900)) < 0.3
    passage = next(r for r in found if r.doc_id == 901 and r.score > 0.7).passages[0]
    assert (passage["first"], passage["end"]) == (1, 4)
    again = tx.fit(docs, labels, F.col("doc_id") % 3 != 1)
    assert again.words == model.words and np.allclose(again.weights, model.weights)


def test_without_examples(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert [r.score for r in tx.toxicity(docs, model).collect()] == [0.0]
    assert tx.toxicity(docs.limit(0), model).count() == 0
