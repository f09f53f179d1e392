"""The additive model on data with known shape; features and scores of odd texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import quality as ql
from loomlog.llm.common import labelled_sample


def test_tables_learn_shape_and_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 4))
    truth = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    model = ql.fit_arrays(x[:4000], truth[:4000])
    assert (0, 1) in model.pairs
    assert ((model.scores(x[4000:]) > 0.5) == truth[4000:]).mean() > 0.95
    bump = (np.abs(x[:, 2] - 0.5) < 0.2).astype(float)
    model = ql.fit_arrays(x[:4000], bump[:4000], pairs=0)
    assert ((model.scores(x[4000:]) > 0.5) == bump[4000:]).mean() > 0.95


def test_bins_add_up():
    rng = np.random.default_rng(1)
    x, y = rng.random((500, 3)), rng.integers(0, 2, 500).astype(float)
    model = ql.fit_arrays(x, y, rounds=5, pair_rounds=3, pairs=2)
    at = model.bins(x)
    for i in range(20):
        z = model.base + sum(model.tables[f][at[i, f]] for f in range(3)) + sum(g[at[i, a], at[i, b]] for (a, b), g in zip(model.pairs, model.grids))
        assert abs(model.scores(x[i : i + 1])[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_features():
    assert ql.features("") == ql.features(" \n ") == [0.0] * len(ql.FEATURES)
    found = dict(zip(ql.FEATURES, ql.features("Ab 12 !!\nAb 12 !!\n|"), strict=True))
    assert found["words"] == np.log1p(7) and found["exclaims"] == 4 / 19 and found["bars"] == 1 / 19 and found["upper"] == 2 / 19
    assert found["repeated_lines"] == 16 / 19 and found["distinct"] == 4 / 7 and found["lone_marks"] == 3 / 7


def test_documents(spark):
    good = [(i, f"Some plain words, number {i}. They go on and on.", 1) for i in range(60)]
    poor = [(i, "BUY!! NOW!! | " * (i % 5 + 3), 0) for i in range(60, 120)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in good + poor] + [(None, None, "y"), (500, "", "y"), (501, "word " * 50_000, "y")], "doc_id long, text string, x string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + poor] + [(None, 0), (3, None)], "doc_id long, quality int")
    model = ql.fit(docs, labels, F.col("doc_id") % 5 != 0)
    scores = {r.doc_id: r.score for r in ql.quality(docs, model).collect()}
    assert len(scores) == 123 and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[i] >= 0.3) == bool(y) for i, _, y in good + poor)
    left = ql.drop_poor(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, s in scores.items() if s >= 0.3}
    assert ql.quality(docs.limit(0), model).count() == 0
    empty = ql.fit(docs, labels.limit(0), F.lit(True))
    assert min(r.score for r in ql.quality(docs, empty).collect()) > 0.99


@pytest.mark.parametrize("text_of_row", ["same", "other"])
def test_sample_is_bounded_by_rows(spark, text_of_row):
    """One labelled id on thousands of rows does not fill the driver."""
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") if text_of_row == "other" else F.lit("x")).alias("text"),
                                    F.lit(1).alias("same"), F.lit(2).alias("label"))
    docs = docs.unionByName(spark.createDataFrame([(1, "a", 0, 0), (2, None, 0, 0), (None, "b", 0, 0)], "doc_id long, text string, same int, label int"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (1, 0), (2, None), (None, 1), (3, 1)], "doc_id long, quality int")
    found = labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert len(found) == (10 if text_of_row == "other" else 2) and {r.doc_id for r in found} <= {1, 7}
    assert all(r.label == (r.doc_id == 7) for r in found)
    assert labelled_sample(docs.limit(0), labels, "quality", F.lit(True), 10).count() == 0
