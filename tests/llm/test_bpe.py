"""Encoding and decoding against the tokenizers library; the transducer against whole merges."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomlog.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " ", "it's I'LL we'd", "ΑΣΣ ΟΔΟΣ σ İ", "a\x1cb \x85c\xa0d", "<|endoftext|>x <|startoftext|>", "é ́", "123 ½ ² Ⅷ 一二三",
         "🎉🎉 ﬁ", "=" * 700, "ab" * 900, "_" * 50 + "a_b", "word, " * 3000, "same", "same"]


@pytest.fixture(scope="module")
def own():
    return bpe.WordTokenizer(open(PATH, encoding="utf-8").read())


def test_transducer_settles_what_stays(own):
    rng, machine = random.Random(1), own.transducer
    for _ in range(60):
        symbols = [own.inner[rng.choice(b"abthein=-")] for _ in range(rng.randint(1, 300))]
        symbols[-1] = own.last[98]
        small = bpe.Transducer(machine.ranks, machine.lengths, buffer=1)
        assert list(small.word(iter(symbols))) == machine.merged(list(symbols))


def test_lookahead_is_the_longest_token(own):
    assert own.transducer.lookahead == max(len(t.removesuffix("</w>")) for t in own.tokens[:49_406])


def test_documents(spark):
    rows = [(i if i else None, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokenizer, expected = Tokenizer.from_file(PATH), []
    for doc, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
    found = bpe.encode_documents(docs, PATH, with_text=True, piece=3).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected, key=str)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_bytes_come_out_as_soon_as_they_are_text(own):
    machine = own.decoder(byte_level=True)
    ids = own.encode("héllo 🎉 wörld").tolist()
    pieces = [machine.feed([i]) for i in ids] + [machine.finish()]
    assert "".join(pieces) == "héllo 🎉 wörld " and "�" not in "".join(pieces)
    parts = [own.inner[b] for b in "🎉".encode()]
    assert [machine.feed([i]) for i in parts] == ["", "", "", "🎉"]
    assert machine.feed(parts[:2]) == "" and machine.finish() == "�"
