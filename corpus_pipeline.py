"""From documents to token ids: quality, exact and near duplicates, benchmark passages, encoding.

Every stage takes all rows of the one before. A null or empty text is the empty text: it has no words, so it is
scored like any other, equals other empty texts, matches no benchmark item and has no tokens. Null ids
are kept as null; rows that repeat an id are decided one by one, and of rows that are equal in every respect one stays in the
duplicate stages. Empty tables go through every stage as empty tables. All stages but the last return the columns that they
were given, whatever else is in the table and whatever those columns are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import bpe, decontamination, exact_dedup, quality, simhash
from loomlog.llm.common import bucket_of, table
from loomlog.session import saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; it learns as op10_quality does. Without labelled
    documents there is no model to reject any, and all stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) != 0)
    return quality.drop_poor(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the longest, then the one with the smallest id, a null id last."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id, a null id last. Shingles of three words
    and three bits, as the operator's contract has it; texts without words are one class."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; items that are null or too short match none."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked by decoding them; one row per document, ids null as they come."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Fitted models and fingerprints have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
