"""Near-duplicates against brute force, and buckets that hold a third of all rows."""

import random

import pytest

from loomlog.operators import library as lb
from loomlog.operators import near_duplicates as nd


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))}


def brute(texts, t=nd.THRESHOLD):
    sets = {p: shingles(x) for p, x in texts.items() if x}
    out = {}
    for p, a in sets.items():
        best = max((len(a & b) / len(a | b) for q, b in sets.items() if q != p), default=0)
        if best >= t:
            out[p] = best
    return out


def run(spark, texts, **kw):
    rows = [("work", p, x) for p, x in texts.items()]
    c = lb.parse_articles(spark.createDataFrame(rows, "brain string, path string, content string"))
    return {r["path"]: r for r in nd.near_duplicate_articles(c, **kw).collect()}


def corpus(n, seed, copies, variants):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 5000)
    texts = {f"library/{i:04}.md": " ".join(word() for _ in range(rng.randint(20, 120))) for i in range(n)}
    base = [word() for _ in range(100)]
    for i in range(copies):
        texts[f"library/copy{i:04}.md"] = " ".join(base)
    for i in range(variants):
        v = list(base)
        v[rng.randrange(100)] = f"only{i}"
        texts[f"library/var{i:04}.md"] = " ".join(v)
    return texts


def test_same_articles_as_brute_force(spark):
    texts = corpus(60, 3, 40, 50)
    texts["library/none.md"] = ""
    texts["library/short.md"] = "two words"
    want, got = brute(texts), run(spark, texts)
    assert set(got) == set(want)
    for p, r in got.items():
        exact = len(shingles(texts[p]) & shingles(texts[r["partner"]])) / len(shingles(texts[p]) | shingles(texts[r["partner"]]))
        assert r["jaccard"] == pytest.approx(exact) and exact >= nd.THRESHOLD


@pytest.mark.parametrize("families", [6, 40])
def test_families_that_share_a_passage(spark, families):
    """All share a long passage, though only members of a family are alike; every family must be
    found, however many there are."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(60)]
    texts = {}
    for fam in range(families):
        own = [f"f{fam}x{i}" for i in range(40)]
        for k in range(4):
            v = list(own)
            v[rng.randrange(40)] = f"v{fam}{k}"
            texts[f"library/{fam}-{k}.md"] = " ".join(shared + v)
    assert set(run(spark, texts)) == set(brute(texts))


def test_nearly_alike_at_the_threshold(spark):
    rng = random.Random(9)
    texts = {}
    for i in range(40):
        base = [f"b{i}w{j}" for j in range(60)]
        texts[f"library/{i}-a.md"] = " ".join(base)
        changed = list(base)
        for j in rng.sample(range(60), rng.randint(1, 5)):
            changed[j] = f"c{i}x{j}"
        texts[f"library/{i}-b.md"] = " ".join(changed)
    assert set(run(spark, texts)) == set(brute(texts))


@pytest.mark.parametrize("own", [lambda i: 40, lambda i: 20 + i % 40])
def test_one_template(spark, own, monkeypatch):
    """All articles are one template and some words of their own, and none or few are alike. What is kept per bucket and compared
    grows with the articles, not with their square."""
    rows, keep = {}, nd.saved
    def counted(df, name, *args):  # noqa: E306
        out = keep(df, name, *args)
        rows[name] = rows.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(nd, "saved", counted)
    made = {}
    for n in (100, 200):
        rows.clear()
        texts = {f"library/{i:04}.md": " ".join([f"t{j}" for j in range(100)] + [f"o{i}x{j}" for j in range(own(i))]) for i in range(n)}
        assert set(run(spark, texts)) == set(brute(texts))
        made[n] = dict(rows)
    for name in ("buckets", "leaders", "hits", "waiting"):
        assert made[200].get(name, 0) <= 2.5 * made[100].get(name, 0), (name, made)
    assert made[200].get("hits", 0) <= 200 * 8


def test_repeated_rows_and_paths(spark):
    """Copies, rows that come twice, one path with two texts, nulls: one row per article that has a partner."""
    one, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [("w", "p1", one), ("w", "p1", one), ("w", "p2", one), ("w", "p2", other), ("w", "p3", other + " c"), ("w", "p4", "alone here now"),
            ("v", "p5", one), ("w", None, other), ("w", "p6", ""), ("w", "p7", None), ("w", "p8", "")]
    c = lb.parse_articles(spark.createDataFrame(rows, "brain string, path string, content string"))
    got = {(r["brain"], r["path"]) for r in nd.near_duplicate_articles(c).collect()}
    assert got == {("w", "p1"), ("w", "p2"), ("w", "p3"), ("w", None)}


def test_shingles_are_shuffled_once_each_way(spark, monkeypatch):
    """Rows, one for each shingle, are dealt by shingle once and by article once, and sets of articles without a
    candidate are not dealt at all."""
    plans, keep = {}, nd.saved
    def kept(df, name, *args):  # noqa: E306
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name, *args)
    monkeypatch.setattr(nd, "saved", kept)
    texts = {f"library/{i:03}.md": " ".join(f"o{i}x{j}" for j in range(40)) for i in range(60)}
    texts["library/a.md"], texts["library/b.md"] = (" ".join([f"s{j}" for j in range(40)] + [end]) for end in "ab")
    assert set(run(spark, texts)) == {"library/a.md", "library/b.md"}
    dealt = [line.split("hashpartitioning(")[1].split("#")[0] for line in plans["buckets"].split("\n") if "Exchange hashpartitioning(" in line]
    assert dealt.count("key") == 1
    signed = spark.createDataFrame([(k, "w", [k]) for k in range(1000)], "id long, brain string, shingles array<bigint>")
    assert nd._sets(signed, spark.createDataFrame([(5, 9)], "id long, partner long")).count() < 100


def test_plans_do_not_grow_with_the_articles(spark, monkeypatch):
    """The driver holds, logs and prints plans many times over: the keys of copies and of pairs are in none."""
    longest, keep = [], nd.saved
    def kept(df, name, *args):  # noqa: E306
        longest[-1] = max(longest[-1], len(df._jdf.queryExecution().toString()))
        return keep(df, name, *args)
    monkeypatch.setattr(nd, "saved", kept)
    for n in (20, 600):
        longest.append(0)
        texts = {f"library/{i:04}{end or 'a'}.md": " ".join([f"o{i}x{j}" for j in range(30)] + [end]) for i in range(n) for end in ("", "b", "b c", "c b")}
        texts |= {f"library/{i:04}copy.md": texts[f"library/{i:04}a.md"] for i in range(n)}
        assert set(run(spark, texts)) == set(texts)
    assert longest[1] < 1.05 * longest[0]
