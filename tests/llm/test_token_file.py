"""Token files: exact round trips, places, damage, odd texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomlog.llm import rans, token_file as tf
from loomlog.session import fresh_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2047, 70_000, 2048 * 128 + 5])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.001, n), 50_000).astype(np.uint32)
    table = rans.table_of(rans.scaled(np.bincount(ids, minlength=50_001)))
    block = rans.encode(ids, table, lanes=64, every=16)
    assert (rans.decode(block, table) == ids).all()
    lanes = max(1, min(64, n // 256))
    if n > 48 * lanes:
        assert (rans.decode(block, table, 1, 3) == ids[16 * lanes : 48 * lanes]).all()


def test_damage_is_seen():
    ids = np.arange(1000, dtype=np.uint32) % 7
    table = rans.table_of(rans.scaled(np.bincount(ids)))
    block = bytearray(rans.encode(ids, table))
    block[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode(bytes(block), table)


def test_scaled_keeps_rare_ids():
    freq = rans.scaled(np.array([10**9, 1, 0, 1]), 8)
    assert freq.sum() == 256 and freq[1] >= 1 and freq[3] >= 1 and freq[2] == 0


TEXTS = ["", None, " ", "a b", "  a", "a\n\nb c", "x\ty z", "<|endoftext|> a", "a <|endoftext|>.", "it's, ok.", "é́. ŀ,", "a\x00b c",
         "\na", "a\n", "a\xa0b c", "..,,", ", a", "1,2.", "word, " * 4000 + "x,y.z", "= " * 900, "x" * 5000, "a b", "a b"]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(tf, "STEP", 2000)
    rows = [(i % 20 if i != 3 else None, text, "z", i) for i, text in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int")
    path = fresh_folder(spark, "file")
    tf.write_token_file(docs, path, PATH, 2, block_ids=500)
    found = tf.read_token_file(spark, path).collect()
    tokenizer, at, expected = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected


def test_no_documents(spark):
    path = fresh_folder(spark, "file")
    tf.write_token_file(spark.createDataFrame([], "doc_id long, text string"), path, PATH, 2)
    assert tf.read_token_file(spark, path).count() == 0
