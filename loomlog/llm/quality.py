"""Quality by a generalised additive model with pairwise interactions.

A text becomes a few shape features (lengths, shares of kinds of characters and words, repetition).
Each feature is cut into bins at quantiles of the sample. Shallow trees are boosted in turn, one feature
after the other at a low rate, each a step function over the bins, so what one feature learns is one
lookup table. Then the pairs whose trees lower the loss most get tables over two features, learned the
same way. A score is the sum of the tables' entries at the text's bins, through a logistic curve.

The model is fitted on at most `SAMPLE` labelled rows; its size is fixed by the numbers of features,
bins and pairs. Texts are scored whole.

Nulls: a null text is the empty text, whose features are zero; null labels and ids are no examples;
without examples of both classes every score is the share of good examples (1 without any). Null ids
and repeated rows are scored like others. An empty table gives no rows. Columns other than the id and
the text are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.llm.common import bucket_of, filtered, labelled_sample, pick, table, texts

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 120, 60, 10, 0.1
#: Examples that a leaf needs.
LEAF = 10

FEATURES = ["chars", "words", "lines", "word_length", "upper", "digits", "spaces", "dots", "commas", "exclaims", "bars", "marks", "other_ascii",
            "wide", "distinct", "top_word", "short_words", "long_words", "lone_marks", "repeated_lines", "top_line", "word_spread"]

_CLASSES = np.zeros((256, 10))
for _name, _members in enumerate([range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), b".", b",", b"!", b"|", b"#$%&*~^", b"", range(128, 256)]):
    for _b in _members:
        _CLASSES[_b, _name] = 1
_CLASSES[33:127, 8] = (_CLASSES[33:127].sum(axis=1) == 0) & ~np.isin(np.arange(33, 127), np.arange(97, 123))


def features(text: str) -> list[float]:
    """Shape of a whole text, in the order of FEATURES."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    shares = np.bincount(raw, minlength=256) @ _CLASSES / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x]
    often, n = Counter(words), len(words)
    of_lines = Counter(lines)
    repeated = sum(len(x) * c for x, c in of_lines.items() if c > 1)
    top_line = max(len(x) * c for x, c in of_lines.items())
    lone = sum(c for w, c in often.items() if not w[0].isalnum() and not w[-1].isalnum())
    return [math.log1p(len(text)), math.log1p(n), math.log1p(len(lines)), float(sizes.mean()), *shares.tolist(),
            len(often) / n, max(often.values()) / n, float((sizes <= 3).mean()), float((sizes >= 12).mean()), lone / n,
            repeated / len(text), top_line / len(text), float(sizes.std())]


def feature_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and x, the features of `text`."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(text) for text in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", x array<double>")


@dataclass
class Model:
    """Bin edges per feature, a table per feature, and tables of pairs."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if self.tables and len(x):
            at = self.bins(x)
            for f, values in enumerate(self.tables):
                z += values[at[:, f]]
            for (f, g), values in zip(self.pairs, self.grids, strict=True):
                z += values[at[:, f], at[:, g]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, start: int, end: int) -> tuple[float, int]:
    """Best cut of bins start..end in two, and what it gains."""
    cg, ch, cn = np.cumsum(g[start:end])[:-1], np.cumsum(h[start:end])[:-1], np.cumsum(n[start:end])[:-1]
    if not len(cg):
        return 0.0, 0
    tg, th, tn = g[start:end].sum(), h[start:end].sum(), n[start:end].sum()
    gain = np.where((cn >= LEAF) & (tn - cn >= LEAF), _gain(cg, ch) + _gain(tg - cg, th - ch) - _gain(tg, th), 0)
    best = int(np.argmax(gain))
    return float(gain[best]), start + best + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step function over the bins with at most `leaves` steps, each a Newton step."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_split(g, h, n, a, b), a, b) for a, b in parts]
        gain, cut, a, b = max(cuts)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree over a grid that cuts each feature once: its gain and its four leaves."""
    def corner(v: np.ndarray) -> list[np.ndarray]:
        c = v.cumsum(0).cumsum(1)
        a, right, low, total = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, right - a, low - a, total - right - low + a]

    gs, hs, ns = corner(g), corner(h), corner(n)
    enough = np.minimum.reduce(ns) >= LEAF
    gain = np.where(enough, sum(_gain(a, b) for a, b in zip(gs, hs)) - _gain(g.sum(), h.sum()), 0)
    out = np.zeros(g.shape)
    if not gain.size or gain.max() <= 0:
        return 0.0, out
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaves = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(gs, hs)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaves
    return float(gain.max()), out


def fit_arrays(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS,
               pairs: int = PAIRS, rate: float = RATE) -> Model:
    """Boost the tables on examples in memory."""
    share = float(np.mean(y)) if len(y) else 1.0
    if len(y) == 0 or share in (0.0, 1.0):
        return Model(math.log((share + 1e-9) / (1 - share + 1e-9)))
    model = Model(math.log(share / (1 - share)))
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    at = model.bins(x)
    widths = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(w) for w in widths]
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, w in enumerate(widths):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[:, f], g, w), np.bincount(at[:, f], h, w), np.bincount(at[:, f], minlength=w))
            model.tables[f] += step
            z += step[at[:, f]]

    def grid(f: int, k: int) -> tuple[float, np.ndarray]:
        cell, shape = at[:, f] * widths[k] + at[:, k], (widths[f], widths[k])
        return _quadrants(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (*slopes(), np.ones(len(y)))))

    ranked = sorted(((grid(f, k)[0], f, k) for f, k in itertools.combinations(range(len(widths)), 2)), reverse=True)
    model.pairs = [(f, k) for gain, f, k in ranked[:pairs] if gain > 0]
    model.grids = [np.zeros((widths[f], widths[k])) for f, k in model.pairs]
    for _ in range(pair_rounds):
        for i, (f, k) in enumerate(model.pairs):
            step = rate * grid(f, k)[1]
            model.grids[i] += step
            z += step[at[:, f], at[:, k]]
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
        sample: int = SAMPLE, **options) -> Model:
    """Learn from a bounded sample of labelled rows; their features come to the driver."""
    examples = labelled_sample(docs, labels, label, learn, sample, id_col, text_col).filter("label in (0, 1)")
    rows = feature_rows(examples.select("doc_id", "label", "text"), ["doc_id", "label"]).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.x))
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_arrays(x, np.array([r.label for r in rows], dtype=float), **options)


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(text) for text in texts(batch, "text")]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(x))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


#: Rows with a lower score are rejected.
LEAST = 0.3


def drop_poor(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """`docs` without the rows whose score is below `least`, in one pass, with all their columns. Rows are decided one by
    one, so repeated ids and rows, null ids and null texts (scored as empty) need no further rule."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(batch: pa.RecordBatch) -> np.ndarray:
        x = np.array([features(text) for text in texts(batch, text_col)]).reshape(batch.num_rows, len(FEATURES))
        return shared.value.scores(x) >= least

    return filtered(docs, good)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
