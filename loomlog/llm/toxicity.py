"""Toxic passages by maximum-scoring segments over word log-odds.

A word's score is its log-odds between toxic and other labelled documents under an informative
Dirichlet prior (prior counts in proportion to the word's share of all of them), if it is significant;
all other words share the small negative log-odds of not being significant. Counts are of documents,
so one text that repeats a word proves little. A linear scan finds every maximal segment of a text.
Karlin-Altschul statistics of the scores under the clean class (lambda from the score distribution, K
from the best segments of clean texts) say how far a segment exceeds what chance gives in a text of
that length; the significant segments are aggregated and calibrated to a probability.

The model is fitted on at most `SAMPLE` labelled rows; everything that is fitted has a size that the
sample bounds. Texts are scored whole.

Nulls: a null text is the empty text and has no segment; null labels and ids are no examples; without
examples of both classes every score is the share of toxic examples (0 without any). Null ids and
repeated rows are scored like others. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomlog.llm.common import bucket_of, labelled_sample, logistic, pick, table, texts

#: Labelled rows to learn from, at most.
SAMPLE = 50_000
#: Weight of the prior in documents, and least significance of a word's log-odds.
PRIOR, SIGNIFICANT = 50.0, 3.0
EULER = 0.5772156649
MEMORY = 400_000
_EDGE = re.compile(r"[\W_]+")


def word_of(run: str) -> str:
    """A run between white space as a word: lower case, letters and digits only."""
    return _EDGE.sub("", run.lower())


@dataclass
class Model:
    """Scores of significant words, the score of all others, lambda, K and the calibration."""

    words: dict[str, float]
    other: float = -0.01
    scale: float = 1.0
    log_k: float = 0.0
    weights: list[float] = field(default_factory=list)
    base: float = 0.0


class _Scores(dict):
    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, run: str) -> float:
        word = word_of(run)
        score = self.model.words.get(word, self.model.other) if word else 0.0
        if len(run) < 64:
            if len(self) >= MEMORY:
                self.clear()
            self[run] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by the linear-time scan of Ruzzo and Tompa.

    Each candidate keeps the sum before it and up to its end. A new one is joined with the nearest
    earlier candidate that starts lower if that ends lower too.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []
    # For each candidate, the nearest earlier one whose sum before it is lower.
    lower: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:], lower[j:]
        found.append((start, end, left, right))
        lower.append(j)
    return [(s, e, r - l) for s, e, l, r in found]


def evidence(text: str, known: _Scores) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words and the maximal segments of a text."""
    runs = text.split()
    scores = np.fromiter(map(known.__getitem__, runs), np.float64, len(runs))
    return len(runs), segments(scores)


def features(n: int, found: list[tuple[int, int, float]], model: Model) -> list[float]:
    """Best segment above chance, sum over all segments above chance, their whole score, and how many
    exceed it."""
    if not found:
        return [0.0, 0.0, 0.0, 0.0]
    scores = np.array([s for _, _, s in found])
    above = model.scale * scores - model.log_k - math.log(max(n, 1))
    good = np.maximum(above, 0)
    return [float(np.log1p(good.max())), float(np.log1p(good.sum())), float(np.log1p(scores.sum())), float(np.log1p((above > 0).sum()))]


def probability(x: list[float], model: Model) -> float:
    if not model.weights:
        return model.base
    z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of each class that hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, labels = [], []
            for text, label in zip(texts(batch, "text"), batch.column("label").to_pylist(), strict=True):
                own = {word_of(w) for w in set(text.split())} - {""}
                words += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32())], names=["word", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "word string, label int")
    return rows.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
        sample: int = SAMPLE, prior: float = PRIOR, significant: float = SIGNIFICANT) -> Model:
    """Learn scores and calibration from a bounded sample of labelled rows."""
    examples = labelled_sample(docs, labels, label, learn, sample, id_col, text_col).filter("label in (0, 1)")
    sizes = {r.label: r["count"] for r in examples.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, base=toxic / max(toxic + clean, 1))
    a = F.lit(prior) * (F.col("toxic") + F.col("clean")) / (toxic + clean)
    odds = (F.log((F.col("toxic") + a) / (toxic + prior - F.col("toxic") - a)) - F.log((F.col("clean") + a) / (clean + prior - F.col("clean") - a)))
    z = odds / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    found = word_counts(examples).select("word", "toxic", "clean", odds.alias("odds"), z.alias("z")).filter(F.abs("z") >= significant).collect()
    model = Model({r.word: r.odds for r in found})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Words per class that are significant and not: what the others' score and the clean score distribution need.
    held = examples.select("text", "label").mapInArrow(_tally(shared), "label int, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")).collect()
    count = {0: {}, 1: {}}
    for r in held:
        count[r.label][r.word] = r.n
    total = {c: max(sum(count[c].values()), 1) for c in count}
    plain = {c: (count[c].get(None, 0) + 1) / (total[c] + 2) for c in count}
    model.other = min(math.log(plain[1] / plain[0]), -1e-3)
    share = [((count[0].get(w, 0) + 0.5) / total[0], s) for w, s in model.words.items()] + [(plain[0], model.other)]
    model.scale = _scale(share)
    rows = _described(examples, model, ["label"]).collect()
    calm = [r for r in rows if r.label == 0 and r.best > 0]
    if calm:
        model.log_k = float(np.mean([model.scale * r.best - math.log(max(r.n, 1)) for r in calm])) - EULER
    rows = _described(examples, model, ["label"]).collect()
    model.weights = logistic(np.array([r.x for r in rows]), np.array([r.label for r in rows], dtype=float)).tolist()
    return model


def _scale(share: list[tuple[float, float]]) -> float:
    """The positive lambda at which the mean of exp(lambda * score) is 1."""
    p, s = np.array(share).T
    p = p / p.sum()
    if not (s > 0).any() or p @ s >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while p @ np.exp(high * s) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if p @ np.exp(middle * s) < 1 else (low, middle)
    return low


def _tally(shared):
    """Per task: how often each significant word, and how often any other (null), occurs per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = shared.value.words, {}
        for batch in batches:
            for text, label in zip(texts(batch, "text"), batch.column("label").to_pylist(), strict=True):
                for found in text.split():
                    word = word_of(found)
                    if word:
                        key = (label, word if word in words else None)
                        n[key] = n.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())],
                                         names=["label", "word", "n"])

    return run


def _described(rows: DataFrame, model: Model, keep: list[str], with_segments: bool = False) -> DataFrame:
    """`keep` columns, n, best, x, score[, passages] of each row; passages are the segments above chance as
    (first word, end, score)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = dict(rows.dtypes)
    more = ", passages array<struct<first:int,end:int,score:double>>" if with_segments else ""
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n long, best double, x array<double>, score double" + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Scores(model)
        for batch in batches:
            sizes, best, xs, scores, passages = [], [], [], [], []
            for text in texts(batch, "text"):
                n, found = evidence(text, known)
                x = features(n, found, model)
                sizes.append(n)
                best.append(max((s for _, _, s in found), default=0.0))
                xs.append(x)
                scores.append(probability(x, model))
                if with_segments:
                    bar = model.log_k + math.log(max(n, 1))
                    passages.append([{"first": s, "end": e, "score": v} for s, e, v in found if model.scale * v > bar])
            columns = [*(batch.column(k) for k in keep), pa.array(sizes, pa.int64()), pa.array(best, pa.float64()),
                       pa.array(xs, pa.list_(pa.float64())), pa.array(scores, pa.float64())]
            if with_segments:
                columns.append(pa.array(passages, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n", "best", "x", "score", *(["passages"] if with_segments else [])])

    return rows.select(*keep, "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, passages) of every row."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return _described(rows, model, ["doc_id"], with_segments=True).select("doc_id", "score", "passages")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
                         F.size("passages").alias("n_passages"))
