"""Phrases against a plain count, summaries against their guarantee, long texts against short parts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomlog.llm import collocations as co

SCHEMA = "doc_id long, lang string, text string, n int, phrase int, hash string"


def plain(rows, least, most=4, inside=80, top=2000):
    """The same by dictionaries."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, low = lang if lang is not None else "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: n for p, n in counts.items() if len(p) > 1 and n >= least}
        kept = []
        for p, a in often.items():
            if any(100 * n >= inside * a for q, n in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, cut = min((2000000 * a // (counts[p[:j]] + counts[p[j:]]), j) for j in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(i, lang, text, 1, 2, "x") for i, (lang, text) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in co.collocations(docs, **how).collect())


def some_rows(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "Ünd", "ABC", "x\xa0y", "\x1c", "'"]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\r\n", "\x0b"]
    rows = [(rnd.choice(["en", "de", None]), "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randrange(30)))) for _ in range(n)]
    return rows + [("en", None), ("und", "w1 w2 w3"), ("fr", ""), ("fr", " . ,"), ("en", rows[0][1])] + [("es", "a b c d")] * 9


@pytest.mark.parametrize("how", [{"least": 5}, {"least": 3, "inside": 50, "top": 7}, {"least": 2, "most": 3}, {"least": 8, "most": 2}])
def test_phrases(spark, how):
    rows = some_rows(1)
    assert found(spark, rows, **how) == plain(rows, **how) != []


def test_small_tables_and_steps(spark, monkeypatch):
    """Few bits let wrong runs through, which the count drops; texts are cut at any place."""
    rows = some_rows(2) + [("en", "w1 w2 " * 300 + "one w1. " + "q" * 500 + " w1 w2 w3" * 40)]
    expected = plain(rows, 5)
    assert found(spark, rows, least=5, bits=6) == expected
    for step in (16, 64, 300):
        assert _in_steps(rows, step, monkeypatch) == _in_steps(rows, 1 << 22, monkeypatch)


def _in_steps(rows, step, monkeypatch):
    monkeypatch.setattr(co, "STEP", step)
    batch = pa.RecordBatch.from_pydict({"lang": [lang or "und" for lang, _ in rows], "text": pa.array([(t or "").encode() for _, t in rows], pa.binary())})
    total = Counter()
    for words in co._parts(iter([batch]), 4):
        for key, n in co._exact(words, [np.full(8, 255, np.uint8)] * 4):
            total[key] += n
    return total


def test_summary_keeps_every_frequent_item():
    rnd = np.random.default_rng(4)
    for least in (5, 30):
        items = np.concatenate([rnd.integers(0, 5000, 40000), np.repeat(np.arange(9000, 9040), least), np.repeat(np.arange(9100, 9140), least - 1)]).astype(np.uint64)
        rnd.shuffle(items)
        summary = co.Summary(len(items), least)
        for part in np.array_split(items, 400):
            summary.n_waiting = 1 << 30  # merge at once
            summary.add(*co._merged(part, np.ones(len(part), np.int64)))
            assert len(summary.hashes) <= summary.room
        kept, counts = set(summary.survivors().tolist()), Counter(items.tolist())
        assert summary.off < least and {x for x, n in counts.items() if n >= least} <= kept
        assert all(counts[h] >= n >= counts[h] - summary.off for h, n in zip(summary.hashes.tolist(), summary.counts.tolist()))


def test_large_counts(spark):
    """Products beyond 64 bits."""
    a, rest = 4 * 10**18, 8 * 10**18 + 1
    assert spark.range(1).select(co._score(co.F.lit(a), co.F.lit(rest))).first()[0] == 2000000 * a // rest


def test_empty_table(spark):
    assert found(spark, []) == []
