"""Helpers that several operators of this package share."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomlog.session import saved

#: The white space of the contracts: space and the characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a table's other columns, whatever they are called, stay out."""
    return df.select(*[df[name] for name in names])


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def bucket_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def shipped_tokenizer(spark: SparkSession, path: str):
    """Broadcast of a tokenizer's JSON (a few MB, fixed by the vocabulary): executors need not
    have the file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    return spark.sparkContext.broadcast(text)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def filtered(df: DataFrame, good: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows that `good` marks, with all their columns, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(good(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have; names differ by more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_per_row_key(df: DataFrame, kept: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of `df` whose `key` is in `kept`, the first of each key, without the key. Each map task
    holds back all but one row of a key, so equal rows do not meet in one task."""
    first = free_name(df, "first")
    numbered = df.withColumn(first, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.filter(F.col(first) == 1).join(kept, key, "left_semi").drop(first, key)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled rows, those of the smallest hashes of ids that `learn`
    allows, written once. Rows that repeat an id with the same text count once, those with other texts each.
    Only ids and hashes are broadcast: their number is bounded by `most`. Rows without an id or a label are
    no examples; of several labels of an id the largest counts."""
    known = (pick(labels, id_col, label).toDF("doc_id", "label").filter(learn & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", text_of("text"))
    found = (rows.join(F.broadcast(known), "doc_id").withColumn("same", F.xxhash64("text"))
             .groupBy("doc_id", "label", "same").agg(F.min("text").alias("text")))
    found = saved(found, "labelled")
    kept = found.select("doc_id", "same").orderBy(F.xxhash64("doc_id"), "doc_id", "same").limit(most)
    return found.join(F.broadcast(kept), ["doc_id", "same"], "left_semi").select("doc_id", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
