"""The trie against one made of dictionaries, over one and several partitions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from loomlog.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, name int, part int, ends string"


def sequences_of(rows):
    """Rebuilt sequences by the rule of the query."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            tie = int.from_bytes(xxhash.xxh64_digest((text or "").encode(), 42), "big", signed=True)
            own[c].append((turn is not None, turn or 0, role or "", tie, role or "", text or ""))
    out = {}
    for c in own:
        own[c].sort()
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        out[c] = [x[4:] for x in own.get(base, [])[:h]] + [x[4:] for x in own[c][h:]]
    return out


def plain(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -99, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(n)))).encode()).hexdigest()) for n, m in members.items())


def found(spark, rows):
    convs = spark.createDataFrame([(*r, "k", 1, 2, "e") for r in rows], SCHEMA)
    out = pt.trie(pt.rebuilt(pt.turns_of(convs)))
    assert out.columns == pt.RESULT
    return sorted(tuple(-99 if x is None else x for x in r) for r in out.collect())


@pytest.fixture(params=[1, 5, 13])
def parts(spark, request):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(200, 290), *range(405, 440), -3, -120]:
        for t in range(rnd.choice([1, 2, 3, 7, 7, 8])):
            same = rnd.random() < 0.7
            rows.append((c, t if rnd.random() < 0.95 else None, rnd.choice(["user", None]), f"t{t % 3}" if same else rnd.choice(["é𝒳", "", None, "x"])))
    return rows + [(None, 0, "user", "lost"), (5, 3, "user", "t0"), (5, 3, "user", "t0")] + [(c, t, "user", "same") for c in range(1000, 1040) for t in range(9)]


def test_trie(spark, parts):
    rows = some_rows(parts)
    assert found(spark, rows) == plain(sequences_of(rows))


def test_equal_sequences_over_partitions(spark, parts):
    """Most conversations are equal or a prefix of one another."""
    seqs = {c: [("user", "a"), ("assistant", "bc"), ("user", "d")][: 3 if c % 4 else c % 3] + ([("user", str(c))] if c % 50 == 1 else []) for c in range(300)}
    turns = spark.createDataFrame([(c, t, *x) for c, s in seqs.items() for t, x in enumerate(s)], "conv_id long, turn long, role string, text string")
    listed = pt.sequences(pt.turns_of(turns))
    turnless = spark.createDataFrame([(c,) for c, s in seqs.items() if not s], "conv_id long").select(
        "conv_id", F.lit(b"").alias("key"), F.array().cast("array<long>").alias("sizes"))
    got = sorted(tuple(-99 if x is None else x for x in r) for r in pt.trie(listed.unionByName(turnless)).collect())
    assert got == plain(seqs)


def test_long_conversation(spark):
    rows = [(c, t, "user", "x" * (t % 7)) for c in (0, 1, 2) for t in range(3000 + c)] + [(2, 5000, "user", "last")]
    got, expected = found(spark, rows), plain(sequences_of(rows))
    assert got == expected


def test_turnless_and_empty(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert found(spark, [(lone, 0, "user", "gone")]) == [(lone, 0, -99, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert found(spark, []) == []


def test_common():
    a = bytes(range(16)) * 300
    assert pt.common(a, a) == 300 and pt.common(a, a[:160]) == 10 and pt.common(a, b"") == 0
    assert pt.common(a, a[:4000] + b"\xff" + a[4001:]) == 250
