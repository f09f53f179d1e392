"""Classes of equal texts against a dictionary, with a fair and a clashing digest."""

import re

import pytest
from pyspark.sql import functions as F

from loomlog.llm import exact_dedup as ed

TEXTS = [(5, "a b c"), (3, "abc"), (9, "a  b\tc"), (1, "a b c"), (2, None), (7, ""), (8, " \n"), (4, "abd"), (6, "ab d"), (10, "é"), (None, "a b  c"), (None, "zz"),
         (11, "a\xa0b"), (12, "q" * 50_000), (13, "q " * 50_000), (14, "x"), (14, "x")]


def expected():
    groups: dict = {}
    for doc, text in TEXTS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for doc, text in TEXTS:
        group = groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")]
        best = min(group)
        out.append((doc, best[3], len(group), (-len(text or ""), doc) == (best[0], best[3])))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [ed.sha256, lambda c: F.lpad(F.hex(F.length(c) % 2), 2, "0")])
def test_classes(spark, digest):
    docs = spark.createDataFrame([(*t, "x", 1) for t in TEXTS], "doc_id long, text string, content string, length int").repartition(3)
    found = ed.exact_duplicates(docs, digest=digest).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, found), key=str) == expected()


def test_drop(spark):
    docs = spark.createDataFrame([t for t in TEXTS if t[0] not in (None, 14)], "doc_id long, text string")
    kept = ed.drop_duplicates(docs).collect()
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept]
    assert len(bodies) == len(set(bodies)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in TEXTS if i not in (None, 14)})


def test_drop_decides_by_row(spark):
    rows = [*TEXTS, (None, "unique y"), (None, "unique y"), (21, "p"), (22, "p"), (22, "q"), (23, "r s"), (23, "rs"), (23, "r\ts")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").repartition(3)
    left = ed.drop_duplicates(docs)
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert left.columns == docs.columns
    assert sorted(bodies) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})
    kept = {(r.doc_id, r.text) for r in left.collect()}
    assert {(None, "unique y"), (None, "zz"), (14, "x"), (21, "p"), (22, "q"), (23, "r\ts")} <= kept


def test_no_documents(spark):
    assert ed.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names(spark):
    """Whatever a table's other columns are called, they stay."""
    names = ["row", "_row", "first", "_first", "ROW_", "digest", "length", "content", "count"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, t, *range(9)) for i, t in [(1, "a"), (2, "a "), (3, "b"), (None, None)]], schema)
    left = ed.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in left.collect()), key=str) == sorted([(2, "a "), (3, "b"), (None, None)], key=str)
    assert ed.drop_duplicates(docs.limit(0)).count() == 0
