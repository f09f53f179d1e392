"""Fingerprints, links and classes against brute force, at any bucket size."""

import numpy as np
import pytest
import xxhash

from loomlog.llm import simhash as sh
from loomlog.llm.components import components


def brute(text):
    words = (text or "").encode().lower().split()
    pieces = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(sh, "STEP", 7)
    for text in ["", None, "a", "A b", "One two three", "É é x " * 40, "a\x0bb\xa0c d " * 9]:
        assert sh.fingerprint(text or "") == signed(brute(text))


@pytest.mark.parametrize("hot", [256, 3])
def test_links(spark, hot):
    rng = np.random.default_rng(3)
    found = {0, 7, 1 << 62, *(int(x) for x in rng.integers(0, 1 << 63, 10))}
    for base in list(found)[:8]:
        for _ in range(15):
            found.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    values = sorted(signed(x) for x in found)
    expected = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    assert {tuple(r) for r in sh.links(df, hot=hot).collect()} == expected


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200), (200, 250)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(3, base), (1, base + " x"), (2, base.upper()), (9, "other words here now"), (4, None), (5, ""), (None, base), (6, "x y"), (6, "x y")]
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, fp long")
    found = sh.near_duplicates(docs).collect()
    values = [brute(t) for _, t in texts]
    near = {i: {j for j, w in enumerate(values) if (v ^ w).bit_count() <= 3} for i, v in enumerate(values)}
    expected = []
    for i, (doc, _) in enumerate(texts):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        expected.append((doc, signed(values[i]), min((texts[j][0] for j in seen if texts[j][0] is not None), default=None)))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert sh.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_decides_by_row(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(200)) for k in "xyz")
    docs = spark.createDataFrame([(None, one), (1, one), (None, two), (None, two), (3, three), (3, three), (3, two + " " + three)], "doc_id long, text string")
    left = sh.keep_one(docs.repartition(3))
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, one), (None, two), (3, three), (3, two + " " + three)], key=str)


def test_clashing_names(spark):
    names = ["row", "_row", "first", "_first", "FP", "_fp", "root", "least", "node"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame([(i, t, *range(9)) for i, t in [(1, "a b c"), (2, "A b  c"), (3, "x y z"), (None, None), (None, "")]], schema)
    left = sh.keep_one(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {1, 3, None} and left.count() == 3
    assert sh.keep_one(docs.limit(0)).count() == 0
