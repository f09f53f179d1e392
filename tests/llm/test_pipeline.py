"""Each stage against what it should do to its own input, and all of them together."""

import re

import corpus_pipeline as cp
from loomlog.llm import decontamination as dc, quality as ql, simhash as sh
from loomlog.llm.common import bucket_of, table
from loomlog.session import saved


def test_stages(spark, sf_dir):
    docs = before = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = saved(stage(spark, before, sf_dir), "stage")
        old, new = before.collect(), docs.collect()
        ids = {r.doc_id for r in new}
        assert len(ids) == len(new) and ids <= {r.doc_id for r in old}
        if name == "encoding":
            assert len(new) == len(old)
            break
        assert docs.columns == columns and {tuple(r) for r in new} <= {tuple(r) for r in old}
        if name == "quality":
            model = ql.fit(before, table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) != 0)
            assert ids == {r.doc_id for r in ql.quality(before, model).filter("score >= 0.3").collect()}
        elif name == "exact_dedup":
            groups: dict = {}
            for r in old:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
            assert ids == {min(g)[1] for g in groups.values()}
        elif name == "near_dedup":
            prints = {r.doc_id: sh.fingerprint(r.text or "") for r in old}
            todo, expected = set(prints), set()
            while todo:
                part, edge = set(), {min(todo)}
                expected |= edge
                while edge:
                    part |= edge
                    edge = {j for j in todo - part if any(((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 3 for i in edge)}
                todo -= part
            assert ids == expected
        else:
            known = dc.Items([(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()], dc.LEAST)
            held = {r.doc_id for r in old if any(c >= dc.THRESHOLD * len(known.words[i]) for i, (c, _) in known.of(r.text or "").items())}
            assert ids == {r.doc_id for r in old} - held
        before = docs
    assert sorted(tuple(r)[:4] for r in cp.run(spark, sf_dir).collect()) == sorted(tuple(r)[:4] for r in docs.collect())


def odd_documents(spark, sf_dir):
    """Nulls, empty and blank texts, repeated ids and rows, a very long text, and columns with names that the
    stages use themselves."""
    some = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(20).collect()]
    items = [r.text for r in table(spark, sf_dir, "benchmark").orderBy("item_id").limit(2).collect()]
    long = " ".join(f"word{i} of the text" for i in range(60_000))
    rows = [*some, some[0], (some[1][0], some[2][1]), (None, None), (None, ""), (None, some[3][1]), (10**12, " \t\n"), (10**12 + 1, long), (10**12 + 1, long),
            (10**12 + 2, items[0]), (None, items[1])]
    names = ["row", "first", "fp", "label", "score", "same", "ids", "doc", "n_tokens_", "_fp", "_row", "kept", "digest"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, t, None, "s", None, *names) for i, t in rows], schema)


def test_stages_on_odd_rows(spark, sf_dir):
    docs = odd_documents(spark, sf_dir)
    for name, stage in cp.STAGES:
        for before in (docs, docs.limit(0)):
            out = saved(stage(spark, before, sf_dir), "odd")
            if name == "encoding":
                assert out.count() == before.count() and out.filter("doc_id is null").count() == before.filter("doc_id is null").count()
            else:
                old, new = [tuple(r) for r in before.collect()], [tuple(r) for r in out.collect()]
                assert out.columns == docs.columns and not set(new) - set(old)
                texts = {r[1] or "" for r in new}
                if name == "exact_dedup":
                    bodies = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in new]
                    assert sorted(bodies) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in old})
                elif name == "decontamination" and old:
                    assert len(new) < len(old) and {"", " \t\n"} <= texts
                elif name == "near_dedup" and old:
                    assert len([r for r in new if not (r[1] or "").strip()]) == 1
