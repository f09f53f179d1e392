"""Token ids of a corpus in a compressed binary file that is read in parallel.

A file is a folder: `blocks` holds one row per block of whole documents (its place in the id
sequence, document ids, token counts, and one rANS frame as bytes), `freqs` the frequency table that
all blocks share. Parquet is the container, so blocks are written and read by any number of tasks and
committed whole.

Nulls: a null text is the empty text, a null id is kept and sorts first. Rows that repeat an id are
kept, in the order of their texts. An empty table gives a file without blocks. Columns other than the
id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from loomlog.llm import rans
from loomlog.llm.common import pick, shipped_tokenizer, texts
from loomlog.session import fresh_folder, saved

#: A block is closed at this many ids; it is larger only if its last document is.
BLOCK_IDS = 1 << 18
#: Entries of a worker's memory of encoded pieces; it is emptied when full.
MEMORY = 1_000_000
#: Characters that are encoded at a time, about; the distinct pieces among them are looked up once.
STEP = 1 << 23
#: White space next to white space, or other than a space or a line feed; and the piece mark.
_UNSAFE = "\x00|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Words that go through the tokenizer as one text.
LINES = 1 << 12
#: Characters by which the texts of equal ids are dealt out.
BEGIN = 256
# Letters in every version of Unicode; the pattern of the tokenizer leaves a word of them whole.
_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u048a-\u04ff]"
_POINT = f"({_LETTERS})([.,])"
_PLAIN = f"^ ?{_LETTERS}+$"
_CUT = re.compile(r"(?<=\S)(?=\x20\S)")

RAW = "part int, block long, at long, doc_ids array<long>, counts array<long>, width int, ids binary, used binary, times binary"
FILE = "part int, block long, first_id long, doc_ids array<long>, counts array<long>, frame binary"


class _Pieces(dict):
    """Numbers of pieces of text that the tokenizer never joins; `flat` holds their ids one after the
    other, piece `n` from `starts[n]` to `starts[n + 1]`. New pieces only go through the tokenizer: plain
    words, which its pattern leaves whole, many at a time, one a line, and the others one by one."""

    def __init__(self, tokenizer_json: str, kind: str, lines: bool) -> None:
        self.kind = kind
        self.tokenizer, self.lines = _tokenizer(tokenizer_json), _tokenizer(tokenizer_json) if lines else None
        if lines:
            whole = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), whole])
            # A character of a token's name stands for a byte of its text.
            names = self.tokenizer.get_vocab()
            self.bytes = np.zeros(max(names.values()) + 1, np.int64)
            self.bytes[list(names.values())] = list(map(len, names))
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.flat, self.starts = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces."""
        texts_ = pieces.to_pylist()
        found = np.fromiter(map(self.get, texts_, repeat(-1)), np.int64, len(texts_))
        unknown = np.flatnonzero(found < 0)
        if len(self) + len(unknown) > MEMORY and len(self):
            self.clear()
            found[:], unknown = -1, np.arange(len(texts_))
        plain = pc.match_substring_regex(pieces.take(pa.array(unknown)), _PLAIN).to_numpy(zero_copy_only=False)
        plain &= self.lines is not None
        for places, step, encoded in ((unknown[plain], 1 << 17, self._of_lines), (unknown[~plain], 1 << 15, self._one_by_one)):
            flat, sizes = [self.flat], [np.zeros(0, np.int64)]
            for at in range(0, len(places), step):
                words = [texts_[i] for i in places[at : at + step].tolist()]
                ids, size = encoded(words)
                flat.append(ids)
                sizes.append(size)
                found[places[at : at + step]] = np.arange(len(self), len(self) + len(words))
                self.update(zip(words, range(len(self), len(self) + len(words))))
            self.flat = np.concatenate(flat)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
        return found

    def _of_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines = ["\n".join(words[i : i + LINES]) for i in range(0, len(words), LINES)]
        ids = np.fromiter(chain.from_iterable([one.ids for one in self.lines.encode_batch_fast(lines, add_special_tokens=False)]), self.kind)
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(w.encode()) for w in words])) + 1
        return ids, np.diff(ends, prepend=0)

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [one.ids for one in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.kind, int(sizes.sum())), sizes


def _tokenizer(tokenizer_json: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class Encoder:
    """Encodes texts with a tokenizer, repeated pieces once a worker.

    A byte-level tokenizer whose pattern lets a word take one space before it always parts a text
    between two characters that are not white space with one space or line feed between them: before
    a space, and on both sides of a line feed. It also parts a letter and a comma or full stop behind
    it. Texts with other white space are encoded in one go.
    """

    def __init__(self, tokenizer_json: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        made = json.loads(tokenizer_json)
        first = made.get("pre_tokenizer") or {}
        self.by_parts = (first.get("type") == "ByteLevel" and bool(first.get("use_regex", True)) and not first.get("add_prefix_space")
                         and not made.get("normalizer"))
        # A special text in a word or at a line's end would be taken out of it.
        special = [t["content"] for t in made.get("added_tokens") or []]
        lines = self.by_parts and not any("\n" in t or re.search(_PLAIN, t) for t in special)
        self.kind, self.pieces = kind, _Pieces(tokenizer_json, kind, lines)

    def encode(self, some: list[str]) -> Iterator[bytes]:
        """Ids of each text. Long texts are cut where a word with a space before it begins."""
        rows, owner, size = [], [], 0
        for i, text in enumerate(some):
            for segment in self._segments(text):
                rows.append(segment)
                owner.append(i)
        out: list[list[bytes]] = [[] for _ in some]
        first = 0
        for at, segment in enumerate(rows, 1):
            size += len(segment)
            if size >= STEP or at == len(rows):
                for i, ids in zip(owner[first:at], self._batch(rows[first:at]), strict=True):
                    out[i].append(ids)
                first, size = at, 0
        return (b"".join(ids) for ids in out)

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while self.by_parts and len(text) - at > 2 * STEP and (cut := _CUT.search(text, at + STEP)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _batch(self, some: list[str]) -> list[bytes]:
        column = pa.array(some, pa.large_string())
        unsafe = pc.match_substring_regex(column, _UNSAFE).to_numpy(zero_copy_only=False) if self.by_parts else np.ones(len(some), bool)
        safe = column.filter(pa.array(~unsafe))
        marked = pc.replace_substring(pc.replace_substring(safe, " ", "\x00 "), "\n", "\x00\n\x00")
        split = pc.split_pattern(pc.replace_substring_regex(marked, _POINT, "\\1\x00\\2"), "\x00")
        coded = split.flatten().dictionary_encode()
        numbers = self.pieces.numbers(coded.dictionary)
        width = np.dtype(self.kind).itemsize
        # The ids of all pieces as one binary column, from which those of the texts are taken in order.
        offsets = pa.py_buffer(self.pieces.starts * width)
        known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.pieces), [None, offsets, pa.py_buffer(self.pieces.flat)])
        found = known.take(pa.array(numbers)).take(coded.indices)
        buffers = found.buffers()
        ends, raw = np.frombuffer(buffers[1], np.int64)[: len(found) + 1], memoryview(buffers[2] or b"")
        bounds = ends[split.offsets.to_numpy()]
        made = (bytes(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return [self.pieces.ids(text) if odd else next(made) for text, odd in zip(some, unsafe.tolist(), strict=True)]


@lru_cache(maxsize=2)
def _encoder(tokenizer_json: str, kind: str) -> Encoder:
    return Encoder(tokenizer_json, kind)


def raw_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
               block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents in the order of their ids, encoded, `end_id` after each, cut into blocks of ids."""
    shipped = shipped_tokenizer(docs.sparkSession, tokenizer_path)
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shipped.value, kind).encode
        end = np.array([end_id], dtype=kind).tobytes()
        part, block, at, total, docs_, counts, ids, width = 0, 0, 0, 0, [], [], [], len(end)

        def closed() -> pa.RecordBatch:
            raw = b"".join(ids)
            times = np.bincount(np.frombuffer(raw, kind))
            used = np.flatnonzero(times)
            row = {"part": [part], "block": [block], "at": [at], "doc_ids": [docs_], "counts": [counts], "width": [width], "ids": [raw],
                   "used": [used.astype("<u4").tobytes()], "times": [times[used].astype("<u4").tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=_RAW)

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            for doc, found in zip(batch.column("id").to_pylist(), encode(texts(batch, "text")), strict=True):
                found += end
                docs_.append(doc)
                counts.append(len(found) // width)
                ids.append(found)
                total += counts[-1]
                if total >= block_ids:
                    yield closed()
                    block, at, total, docs_, counts, ids = block + 1, at + total, 0, [], [], []
        if docs_:
            yield closed()

    # Equal ids, or none, may be many: the ranges go on by how the texts begin, which keeps their order.
    ordered = (pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
               .repartitionByRange("id", F.substring("text", 1, BEGIN)).sortWithinPartitions("id", "text"))
    return ordered.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(run, RAW)


_RAW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                  ("counts", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary()), ("used", pa.binary()), ("times", pa.binary())])
_FILE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()),
                   ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("frame", pa.binary())])


def id_counts(blocks: DataFrame) -> DataFrame:
    """How often each id occurs in all blocks: (token, n). Blocks bring their own counts, so their ids are
    not read; each task sums what it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for used, times in zip(batch.column("used"), batch.column("times"), strict=True):
                used, times = np.frombuffer(used.as_buffer(), "<u4"), np.frombuffer(times.as_buffer(), "<u4")
                if len(used) and used[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(used[-1]) + 1 - len(total), np.int64)])
                total[used] += times
        tokens = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": tokens.astype(np.int64), "n": total[tokens]})

    return blocks.select("used", "times").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                     text_col: str = "text", block_ids: int = BLOCK_IDS, bits: int = 20) -> None:
    """Encode whole texts and write them in ascending order of their ids.

    The driver sees the counts of the ids, whose number the vocabulary bounds, and one total per
    partition of the sort.
    """
    spark = docs.sparkSession
    blocks = saved(raw_blocks(docs, tokenizer_path, end_id, id_col, text_col, block_ids), "token-blocks", "lz4")
    rows = id_counts(blocks).collect()
    counts = np.zeros(max([end_id, *(r.token for r in rows)]) + 1, dtype=np.int64)
    for r in rows:
        counts[r.token] = r.n
    freq = rans.scaled(counts, bits)
    totals = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n")).collect()}
    base, seen = {}, 0
    for part in sorted(totals):
        base[part], seen = seen, seen + totals[part]
    shared = spark.sparkContext.broadcast((freq, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, base = shared.value
        table = rans.table_of(freq)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                frame = rans.encode(np.frombuffer(row.column("ids")[0].as_buffer(), f"<u{row.column('width')[0].as_py()}"), table)
                part = row.column("part")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [row.column("part"), row.column("block"), pa.array([base[part] + row.column("at")[0].as_py()], pa.int64()),
                     row.column("doc_ids"), row.column("counts"), pa.array([frame], pa.binary())], schema=_FILE)

    spark.createDataFrame([(bits, freq.astype("<u4").tobytes())], "bits int, freqs binary").coalesce(1).write.parquet(f"{path}/freqs")
    blocks.mapInArrow(run, FILE).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a file, decoded: (doc_id, start, n_tokens, ids_crc32[, ids])."""
    freqs = spark.read.parquet(f"{path}/freqs").first().freqs
    shared = spark.sparkContext.broadcast(bytes(freqs))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.table_of(np.frombuffer(shared.value, "<u4"))
        for batch in batches:
            for row in batch.to_pylist():
                ids = rans.decode(row["frame"], table).astype("<u4")
                counts = np.array(row["counts"], dtype=np.int64)
                ends = np.cumsum(counts)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a block and its documents differ")
                raw = memoryview(ids.tobytes())
                out = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": row["first_id"] + ends - counts, "n_tokens": counts,
                       "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(counts.tolist(), ends.tolist(), strict=True)], pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, schema)


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the file format and back."""
    import public_tokenizers

    from loomlog.llm.common import table

    path = fresh_folder(spark, "token-file")
    write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_token_file(spark, path, with_ids=False)
