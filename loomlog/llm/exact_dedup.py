"""Exact duplicates by salted digest groups, the contents compared at every stage.

Texts are equal when identical without their ASCII white space. Grouping is by (digest, salt, content):
each task first combines the rows it has read (map-side aggregation, keyed by the whole content),
the salted groups are merged after a shuffle by (digest, salt), and the winners of the salts are
combined by (digest, content). A group of copies, however large, so leaves one row per task and then
one per salt. What a row learns about its group comes back by an equi-join on the digest; should one
digest have several contents, its rows are joined by the content instead.

Nulls: a null text is the empty text. A null id loses ties against any other; a group of null ids
only has keep_id null, and the first of equal rows stays undetermined, so all of them are kept.
Repeated rows (same id, same text) count in group_size, and each copy of the row that stays is marked
as kept. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.llm.common import SPACE, free_name, one_per_row_key, pick, table, text_of
from loomlog.session import saved

SALTS = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: Room for an id below a length; a null id stands behind all others.
_ROOM = "100000000000000000000BD"
_LAST = "9300000000000000000BD"


def rows_of(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, length, digest, content) of every row."""
    rows = pick(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), text_of("text").alias("text"))
    content = normalised(F.col("text"))
    return rows.select("id", F.length("text").alias("length"), F.unhex(digest(content)).alias("digest"), content.alias("content"))


def classes(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, content, length, keep_id, group_size) of each distinct content.

    Length and id of the best row are one number, so that all three stages are hash aggregations:
    within the task, per (digest, salt), and over the salts.
    """
    best = F.expr(f"cast(length as decimal(11, 0)) * {_ROOM} - coalesce(cast(id as decimal(19, 0)), {_LAST})").cast("decimal(38, 0)")
    salted = (rows.select("digest", "content", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), best.alias("best"))
              .groupBy("digest", "salt", "content").agg(F.max("best").alias("best"), F.count("*").alias("n")))
    whole = salted.groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    length = F.expr(f"(best + {_ROOM} / 2) div {_ROOM}")
    keep = F.expr(f"cast(length as decimal(11, 0)) * {_ROOM} - best")
    return (whole.withColumn("length", length).withColumn("keep", keep)
            .select("digest", "content", F.col("length").cast("int").alias("length"),
                    F.when(F.col("keep") < F.expr(_LAST), F.col("keep").cast("long")).alias("keep_id"), "group_size"))


def _marked(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, length) of every row."""
    rows = rows_of(docs, id_col, text_col, digest)
    found = saved(classes(rows, salts).drop("content"), "classes")
    clashing = found.groupBy("digest").count().filter("count > 1").select("digest")
    members = rows.select("id", "length", "digest")
    if clashing.isEmpty():
        joined = members.join(found.withColumnRenamed("length", "best_length"), "digest")
    else:
        clashing = saved(clashing, "clashing")
        alone = found.join(clashing, "digest", "left_anti").withColumnRenamed("length", "best_length")
        several = rows.join(clashing, "digest", "left_semi")
        by_content = several.join(classes(several, salts).withColumnRenamed("length", "best_length"), ["digest", "content"])
        joined = members.join(alone, "digest").unionByName(by_content.drop("content"))
    return joined.select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                         (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("best_length"))).alias("kept"), "digest", "length")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                     digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row; of a group the row with the longest
    text, then the smallest id, stays. `digest` gives hexadecimal text."""
    return _marked(docs, id_col, text_col, salts, digest).drop("length")


def _row_key(doc_id: Column, length: Column, digest: Column) -> Column:
    return F.concat_ws("/", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), length, F.upper(digest))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row, the one that stays, of each class of equal texts. Rows are told apart by
    id, length and digest; of rows equal in these the first text stays."""
    marked = _marked(docs, id_col, text_col, SALTS, sha256).filter("kept")
    key = free_name(docs, "row")
    kept = marked.select(_row_key(F.col("doc_id"), F.col("length"), F.hex("digest")).alias(key))
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.withColumn(key, _row_key(docs[id_col], F.length(text), sha256(normalised(text))))
    return one_per_row_key(keyed, kept, key, text_col)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
             first_value(len) OVER w AS keep_len
      FROM t WINDOW w AS (PARTITION BY body ORDER BY len DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND len = keep_len AS kept,
       sha256(body) AS text_sha256
FROM g
"""
