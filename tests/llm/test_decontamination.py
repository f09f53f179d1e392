"""Tiles against a plain greedy search; reordered and hidden passages; odd rows."""

import random

import numpy as np
import pytest

from loomlog.llm import decontamination as dc


def greedy(doc, item, least):
    """Longest free match first, by trying all places."""
    used_doc, used, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not used_doc[i + n] and not used[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sum(tiles), len(tiles)
        used_doc[i : i + n], used[j : j + n] = [True] * n, [True] * n
        tiles.append(n)


def test_tiles_are_greedy():
    rng = random.Random(5)
    for _ in range(60):
        item = [rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(30)]
        cuts = sorted(rng.sample(range(30), 3))
        parts = [item[a:b] for a, b in zip([0, *cuts], [*cuts, 30])]
        rng.shuffle(parts)
        doc = [w for p in parts for w in [*p, "noise", *rng.sample(item, 2)]]
        known = dc.Items([(1, " ".join(item))], 3)
        found = known.of(" ".join(doc)).get(0, (0, 0))
        assert found[0] == greedy(doc, item, 3)[0]


ITEM = " ".join(f"q{i}" for i in range(40))
HALVES = " ".join(f"q{i}" for i in range(20, 40)) + " between them " + " ".join(f"q{i}" for i in range(20))


@pytest.mark.parametrize("window", [100_000, 200])
def test_documents(spark, monkeypatch, window):
    monkeypatch.setattr(dc, "WINDOW", window)
    noise = " ".join(f"n{i % 977}" for i in range(5000))
    docs = spark.createDataFrame([
        (1, f"{noise} {ITEM} {noise}", 0), (2, HALVES.upper().replace(" ", ", "), 0), (3, noise, 0), (4, None, 0), (None, ITEM.replace(" ", " ** "), 0), (5, "", 0),
        (6, " ".join(f"q{i}" for i in range(12)), 0), (7, " ".join(f"q{39 - i}" for i in range(40)), 0), (8, "the " * 20_000, 0)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(7, ITEM, "x"), (8, None, "x"), (9, "q1 q2", "x"), (None, "the " * 30, "x")], "item_id long, text string, doc_id string")
    found = dc.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (2, 7), (None, 7), (8, None)}
    assert all(r.coverage == 1 for r in found)
    left = dc.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7]
    assert dc.contaminated(docs, items.limit(0)).count() == 0 and dc.contaminated(docs.limit(0), items).count() == 0
    assert dc.drop_contaminated(docs, items.limit(0)).count() == 9


@pytest.mark.parametrize("window", [100_000, 7, 64])
def test_passages_far_apart(monkeypatch, window):
    monkeypatch.setattr(dc, "WINDOW", window)
    words, noise = ITEM.split(), [f"n{i % 977}" for i in range(150_000 if window > 64 else 500)]
    doc = [*noise[:1000], *words[24:], *noise, *words[:12], *noise, *words[12:24]]
    known = dc.Items([(1, "another item of six words"), (7, ITEM)], 5)
    assert known.of(" ".join(doc)) == {1: (40, 3)}
    assert known.of(" ".join(noise + words)) == {1: (40, 1)}


def test_steps_give_the_same_tiles(monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choice("abc") for _ in range(20))) for k in range(5)]
    docs = [" ".join(rng.choice("abcd") for _ in range(150)) for _ in range(20)]
    whole = [dc.Items(items, 3).of(d) for d in docs]
    monkeypatch.setattr(dc, "WINDOW", 4)
    assert [dc.Items(items, 3).of(d) for d in docs] == whole and any(whole)


def test_blocks_find_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c {i} " + " ".join(f"i{i % 4}w{j}" for j in range(9))) for i in range(8)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(9))) for k in range(4)], "item_id long, text string")
    whole = sorted(map(tuple, dc.contaminated(docs, items).collect()))
    of = dc.blocks_of
    monkeypatch.setattr(dc, "blocks_of", lambda df, i, t: of(df, i, t, most=30))
    assert sorted(map(tuple, dc.contaminated(docs, items).collect())) == whole and len(whole) == 8


def test_running_hash():
    ids = np.random.default_rng(1).integers(0, 9, 50)
    found = dc.running_hashes(ids, 5)
    expected = [sum(int(x) * pow(int(dc._BASE), 4 - k, 1 << 64) for k, x in enumerate(ids[i : i + 5])) % (1 << 64) for i in range(46)]
    assert found.tolist() == expected and len(dc.running_hashes(ids[:4], 5)) == 0


def test_repetitive_texts_in_bounded_memory():
    """100,000 equal words against an item of 1,000: all pairs would be 100 million."""
    import tracemalloc

    items = dc.Items([(1, "a " * 1000), (2, "b c " * 20)], dc.LEAST)
    tracemalloc.start()
    found = items.of("a " * 100_000 + "b c b c b c b c b c b c b c b c b c b c b c b c")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == (1000, 1) and found[1][0] >= 20 and most < 400e6


def test_pair_steps_do_not_change_matches(monkeypatch):
    rnd = random.Random(6)
    item = " ".join(rnd.choice("ab") for _ in range(60))
    doc = " ".join(rnd.choice("ab") for _ in range(400))
    known = dc.Items([(1, item), (2, item[20:])], dc.LEAST)
    whole = known.of(doc)
    for pairs in (1, 50, 999):
        monkeypatch.setattr(dc, "PAIRS", pairs)
        assert known.of(doc) == whole


def both_ways(docs, items):
    found = [sorted(map(str, dc.contaminated(docs, items, broadcast_chars=n).collect())) for n in (dc.BLOCK_CHARS, 0)]
    left = [sorted(map(str, dc.drop_contaminated(docs, items, broadcast_chars=n).collect())) for n in (dc.BLOCK_CHARS, 0)]
    assert found[0] == found[1] and left[0] == left[1]
    return found[0], left[0]


def test_join_by_seeds_gives_the_same_rows(spark):
    rng = random.Random(11)
    items = [(i if i else None, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(3, 40))), "x") for i in range(60)]
    items += [items[3], (90, None, "x"), (91, "", "x"), (92, "a b", "x"), (93, "the " * 30, "x")]
    docs = []
    for i in range(80):
        parts = []
        for _, text, _ in rng.sample(items[:60], 3):
            words = text.split()
            cut = rng.randrange(len(words))
            parts += rng.choice([[*words[cut:], *words[:cut]], words[: max(cut, 5)], words])
            parts += [f"n{rng.randrange(900)}"] * rng.randint(0, 3)
        docs.append((i, " ".join(parts), 1, "k"))
    docs += [docs[0], (None, docs[1][1], 1, "k"), (None, None, 1, "k"), (500, "", 1, "k"), (501, "the " * 3000, 1, "k"), *[(600 + i, docs[2][1], 1, "k") for i in range(50)]]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id long, key string")
    items = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    found, left = both_ways(docs, items)
    assert found and len(left) < docs.count()
    assert both_ways(docs.limit(0), items) == ([], []) and len(both_ways(docs, items.limit(0))[1]) == docs.count()


def test_join_by_seeds_on_the_tables(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found, _ = both_ways(docs, items)
    assert found
