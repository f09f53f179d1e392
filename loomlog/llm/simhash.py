"""SimHash fingerprints and near-duplicate classes by multi-index hashing.

Two fingerprints of 64 bits that differ in at most 3 bits differ in at most one bit in one of their
halves. So a table holds every fingerprint under both halves, each fingerprint looks up the Hamming
ball of radius 1 around its own halves, and full distances are verified. Copies share a fingerprint,
which is looked up once. A half under which many fingerprints lie is told apart by quarters of the
other half and then by eighths, with balls of radius 1 again; after that at most 256 fingerprints
share a key. This finds the same links at any bucket size.

Nulls: a null text has no words and fingerprint zero; zero links like any other fingerprint. A null
id keeps its row; it never is a component's id unless all ids of the component are null. Repeated
rows stay. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomlog.llm.common import free_name, one_per_row_key, pick, table, texts
from loomlog.llm.components import components
from loomlog.session import saved

WORDS, SEED, DISTANCE = 3, 42, 3
#: Shingles that are held as hashes at a time.
STEP = 1 << 16
#: A key with more fingerprints is split further.
HOT = 256
#: Shift and width of the segments, from the halves down to eighths.
LEVELS = (32, 16, 8)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text as a signed 64-bit integer, in bounded memory for the
    hashes. White space and lower case are those of ASCII."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, size = b" ".join(found), min(words, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(found) - size + 1
    counts, h = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        to = min(at + STEP, n)
        pieces = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist())
        hashes = np.array([h(joined[s:e], seed) for s, e in pieces], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, words, seed) for text in texts(batch, "text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found, pa.int64())})

    return (pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, "doc_id long, fp long"))


def _segments(value: Column, width: int) -> list[Column]:
    """The two segments of `width` bits of a value of twice that width."""
    mask = F.lit((1 << width) - 1).cast("long")
    return [value.bitwiseAND(mask), F.shiftrightunsigned(value, width).bitwiseAND(mask)]


def _ball(value: Column, width: int, up: bool = False) -> Column:
    """The value and all that differ in one bit; `up`: only those that set a bit. The level of the
    halves needs no others, as every pair meets there from one side."""
    bits = F.sequence(F.lit(0), F.lit(width - 1))
    flips = F.transform(bits, lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i).bitwiseXOR(value))
    return F.concat(F.array(value), F.filter(flips, lambda v: v > value) if up else flips)


def _keyed(df: DataFrame, key: str, of: str, rest: str, width: int, ball: bool, up: bool = False) -> DataFrame:
    """One row per key: the segment's place and value in `key`, the other segment in `rest`."""
    low, high = _segments(F.col(of), width)

    def row(place: int, own: Column, other: Column) -> Column:
        values = _ball(own, width, up) if ball else F.array(own)
        return F.transform(values, lambda v: F.struct((v * 2 + place).alias("key"), other.alias("rest")))

    rows = [row(0, low, high), row(1, high, low)]
    return (df.withColumn("_k", F.explode(F.concat(*rows))).withColumn(rest, F.col("_k.rest")).withColumn(key, F.col("_k.key"))
            .drop("_k"))


def _verified(asked: DataFrame, held: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Fingerprints under equal keys that differ in 1 to `distance` bits, the smaller one first."""
    pairs = asked.select(*keys, F.col("fp").alias("x")).join(held.select(*keys, F.col("fp").alias("y")), keys)
    near = pairs.filter(F.expr("x <> y") & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(fps: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Every pair (a, b), a < b, of distinct fingerprints in `fps` (column fp) that differ in at most
    `distance` bits (3 at most)."""
    if distance > 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    held = _keyed(fps.select("fp").distinct(), "k0", "fp", "rest", LEVELS[0], ball=False)
    asked = _keyed(fps.select("fp").distinct(), "k0", "fp", "rest", LEVELS[0], ball=True, up=True)
    keys, found = ["k0"], []
    for level, width in enumerate(LEVELS):
        crowded = held.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(*keys)
        if width == LEVELS[-1] or crowded.isEmpty():
            found.append(_verified(asked, held, keys, distance))
            break
        crowded = saved(crowded, "crowded")
        found.append(_verified(asked, held.join(crowded, keys, "left_anti"), keys, distance))
        down, key = LEVELS[level + 1], f"k{level + 1}"
        held = _keyed(held.join(crowded, keys, "left_semi"), key, "rest", "rest_", down, ball=False).drop("rest").withColumnRenamed("rest_", "rest")
        asked = _keyed(asked.join(crowded, keys, "left_semi"), key, "rest", "rest_", down, ball=True).drop("rest").withColumnRenamed("rest_", "rest")
        keys = [*keys, key]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int, distance: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, least id, root of its class) of every fingerprint."""
    signed = saved(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    roots = components(links(signed, distance, hot))
    own = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = own.join(roots, own.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return signed, saved(rooted, "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    seed: int = SEED, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id that links reach."""
    signed, rooted = _rooted(docs, id_col, text_col, words, seed, distance, hot)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")


def _row_key(doc_id: Column, fp: Column) -> Column:
    return F.concat_ws("/", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), fp)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row, that of the smallest id, of each class. Rows are told apart by id and
    fingerprint; of rows equal in these the first text stays. A null id loses against any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text) for text in texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, fp])

    fp, key = free_name(docs, "fp"), free_name(docs, "row")
    _, rooted = _rooted(docs, id_col, text_col, WORDS, SEED, DISTANCE, HOT)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("last"), "least", "fp")).alias("_w"))
    kept = first.select(_row_key(F.col("_w.least"), F.col("_w.fp")).alias(key))
    printed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    keyed = printed.withColumn(key, _row_key(F.col(id_col), F.col(fp))).drop(fp)
    return one_per_row_key(keyed, kept, key, text_col)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
