"""Benchmark decontamination by greedy string tiling.

Words are runs between white space without what is not a letter or digit, in lower case. A running
Karp-Rabin hash over `least` words finds the seeds that a document shares with test items; seeds on one
diagonal make maximal matches; the longest match is marked first, and what marked words leave of other
matches competes again, so tiles never overlap on either side. A document is contaminated by an item
when tiles cover at least `threshold` of the item's words, in whatever order the passages stand.

The items are a stated query set. A set of up to `BLOCK_CHARS` characters is sent to all tasks and compared with
all documents in one pass. A larger one is joined by its seeds: the seeds of documents that pass a bit table
of all item seeds meet the items', pairs that share too few for tiles to reach the threshold are dropped, and
what is left is tiled. Both ways compare words in the end and give the same rows. Documents are read whole:
seeds are hashed `WINDOW` words at a time, and the matches of all steps are tiled together, so the verdict does not
depend on where in the document the passages stand. Where texts repeat themselves every place of the one may meet every place of the
other: such pairs are joined to matches in steps of bounded size.

Nulls: a null text has no words and matches nothing; an item with fewer than `least` words, or a null
text, matches nothing. Null ids are kept as null. Repeated rows give repeated results. Empty tables give
no rows. Columns other than ids and texts are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.llm.collocations import _bits as bit_table, _held as in_table
from loomlog.llm.common import filtered, free_name, pick, table, text_of, texts
from loomlog.session import saved

LEAST, THRESHOLD = 5, 0.5
#: Characters of a block of items, and words whose hashes are held at a time.
BLOCK_CHARS, WINDOW = 4_000_000, 100_000
#: Entries of a task's memory of words.
MEMORY = 500_000
#: Pairs of equal seeds that are held at a time, before those on one diagonal are joined.
PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the table of item seeds, at most (32 MB).
MOST_BITS = 28
_NOT_WORD = re.compile(r"[\W_]+")


def words_of(text: str) -> list[str]:
    return [w for w in (_NOT_WORD.sub("", x) for x in text.lower().split()) if w]


class _Numbers(dict):
    """Number of each run of characters: that of its word among the items, 0 for other words, -1 for
    no word."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, run: str) -> int:
        word = _NOT_WORD.sub("", run)
        number = self.vocabulary.get(word, 0) if word else -1
        if len(self) >= MEMORY:
            self.clear()
        if len(run) < 64:
            self[run] = number
        return number


def running_hashes(ids: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `least` ids, modulo 2**64."""
    n = len(ids) - least + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(least):
        out = out * _BASE + ids[i : i + n].astype(np.uint64)
    return out


def _joined(items: np.ndarray, places: np.ndarray, others: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches of so many seeds each, in order, with those that follow each other on a diagonal as one."""
    if not len(items):
        return items, places, others, seeds
    order = np.lexsort((places, places - others, items))
    items, places, others, seeds = items[order], places[order], others[order], seeds[order]
    new = (np.diff(items) != 0) | (np.diff(places - others) != 0) | (np.diff(places) != seeds[:-1])
    first = np.flatnonzero(np.concatenate([[True], new]))
    return items[first], places[first], others[first], np.add.reduceat(seeds, first)


class Items:
    """A block of items: word numbers, and where each seed stands."""

    def __init__(self, rows: list[tuple[int | None, str]], least: int) -> None:
        self.least, self.ids = least, [i for i, _ in rows]
        vocabulary: dict[str, int] = {}
        self.words = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)], dtype=np.int64) for _, t in rows]
        self.numbers = _Numbers(vocabulary)
        self.text = np.concatenate([*self.words, np.zeros(0, np.int64)])
        self.start = np.cumsum([0, *map(len, self.words)])
        hashes = [running_hashes(w, least) for w in self.words]
        seeds = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])
        order = np.argsort(seeds, kind="stable")
        self.item, self.place = item[order], place[order]
        self.seeds, self.first, self.count = np.unique(seeds[order], return_index=True, return_counts=True)

    def _seeds(self, doc: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
        """Matches between items and the seeds of `WINDOW` places of the document from `begin` on."""
        part = doc[begin : begin + WINDOW + self.least - 1]
        hashes = running_hashes(part, self.least)
        at = np.searchsorted(self.seeds, hashes)
        at[at == len(self.seeds)] = 0
        hit = np.flatnonzero(self.seeds[at] == hashes)
        found = at[hit]
        total, parts, a = np.cumsum(self.count[found]), [], 0
        while a < len(hit) or not parts:
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
            parts.append(self._pairs(part, hit[a:b], found[a:b], begin))
            a = b
        return _joined(*map(np.concatenate, zip(*parts))) if len(parts) > 1 else parts[0]

    def _pairs(self, part: np.ndarray, hit: np.ndarray, found: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
        """Matches of the places `hit` of a part of a document, whose seeds are `found`."""
        counts = self.count[found]
        to = np.repeat(self.first[found] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        items, places, others = self.item[to], np.repeat(hit, counts), self.place[to]
        # Equal hashes are checked by their words.
        same = np.ones(len(places), dtype=bool)
        for i in range(self.least):
            same &= part[places + i] == self.text[self.start[items] + others + i]
        return _joined(items[same], places[same] + begin, others[same], np.ones(same.sum(), dtype=np.int64))

    def matches(self, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(item, places in the document, places in the item, words) of the maximal matches of the whole
        document. What one step of hashes ends with and the next goes on with is one match."""
        if not len(self.seeds):
            return
        steps = [self._seeds(doc, begin) for begin in range(0, len(doc) - self.least + 1, WINDOW)]
        if not any(len(s[0]) for s in steps):
            return
        items, places, others, sizes = _joined(*map(np.concatenate, zip(*steps)))
        bounds = np.flatnonzero(np.diff(items, prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(items)]):
            yield int(items[a]), places[a:b], others[a:b], sizes[a:b] + self.least - 1

    def tiled(self, item: int, places: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
        """(words of the item that tiles cover, tiles)."""
        text, least = self.words[item], self.least
        heap = [(-int(n), int(p), int(o)) for n, p, o in zip(sizes, places, others)]
        heapq.heapify(heap)
        used_doc: set[int] = set()
        used = np.zeros(len(text), dtype=bool)
        covered = tiles = 0
        # Fewer free words than a tile has: nothing can follow.
        while heap and covered + least <= len(text):
            n, p, o = heapq.heappop(heap)
            free = [i for i in range(-n) if not used[o + i] and (p + i) not in used_doc]
            if len(free) == -n:
                used[o : o - n] = True
                used_doc.update(range(p, p - n))
                covered, tiles = covered - n, tiles + 1
                continue
            # What marked words leave of the match competes by its own length.
            start = last = None
            for i in [*free, None]:
                if i is not None and last is not None and i == last + 1:
                    last = i
                    continue
                if start is not None and last - start + 1 >= least:
                    heapq.heappush(heap, (-(last - start + 1), p + start, o + start))
                start = last = i
        return covered, tiles

    def of(self, text: str) -> dict[int, tuple[int, int]]:
        """Per item with a shared seed: (covered words, tiles) in the whole text."""
        get = self.numbers.__getitem__
        ids = np.fromiter(map(get, text.lower().split()), np.int64)
        ids = ids[ids >= 0]
        return {item: self.tiled(item, *found) for item, *found in self.matches(ids)}


def blocks_of(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about `most` characters, streamed to the driver one block at a time."""
    block, size = [], 0
    rows = pick(items, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), text_of("text").alias("text"))
    for row in rows.toLocalIterator():
        block.append((row.id, row.text))
        size += len(row.text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _chars(items: DataFrame, text_col: str) -> int:
    return pick(items, text_col).toDF("text").agg(F.sum(F.length("text").cast("long"))).first()[0] or 0


class _Hashes(dict):
    """Hash of the word in each run of characters, 0 for no word."""

    def __missing__(self, run: str) -> int:
        word = _NOT_WORD.sub("", run)
        value = (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) if word else 0
        if len(self) >= MEMORY:
            self.clear()
        if len(run) < 64:
            self[run] = value
        return value

    def seeds(self, text: str, least: int) -> tuple[np.ndarray, int]:
        """Hashes of all windows of `least` words, and the number of words."""
        words = np.fromiter(map(self.__getitem__, text.lower().split()), np.uint64)
        words = words[words > 0]
        return running_hashes(words, least), len(words)


def _key(text: Column) -> Column:
    """What stands for a text: equal texts are compared once."""
    return F.unhex(F.sha2(text, 256))


def _item_seeds(items: DataFrame, least: int, threshold: float) -> DataFrame:
    """(item, seed, times, need): how often a seed stands in an item, and how many places of the item must
    have a seed in common with a document. A tile of n words has n - least + 1 seeds, at least n / least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), texts(batch, "text"), strict=True):
                found, n = hashes.seeds(text, least)
                seeds, times = np.unique(found, return_counts=True)
                need = max(1, int(np.ceil(threshold * n / least - 1e-9)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seeds), item)), pa.array(seeds.view(np.int64)), pa.array(times.astype(np.int64)),
                                                  pa.array(np.full(len(seeds), need))], names=["item", "seed", "times", "need"])

    return items.select("item", "text").mapInArrow(run, "item long, seed long, times long, need long")


def _doc_seeds(docs: DataFrame, shared, least: int) -> DataFrame:
    """(key, seed) of documents (key, text): the seeds that pass the bit table, once per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = _Hashes(), np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), texts(batch, "text"), strict=True):
                found = hashes.seeds(text, least)[0]
                found = np.unique(found[in_table(bits, found)]) if len(found) else found
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.binary()), pa.array(found.view(np.int64))], names=["key", "seed"])

    return docs.select("key", "text").mapInArrow(run, "key binary, seed long").distinct()


def _tiles(rows: DataFrame, least: int, threshold: float) -> DataFrame:
    """(key, item_id, covered, item_words, tiles, coverage) of rows (key, kind, id, text): a document's text, kind 0, and then the
    items, kind 1, that it is compared with. Both stream through; a document and a block of items are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, block, size = None, "", [], 0

        def closed() -> pa.RecordBatch:
            known, hits = Items(block, least), []
            for item, (covered, tiles) in known.of(doc).items():
                n = len(known.words[item])
                if covered >= threshold * n:
                    hits.append((key, known.ids[item], covered, n, tiles, covered / n))
            types = [pa.binary(), *[pa.int64()] * 4, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*hits)) or [[]] * 6, types, strict=True)],
                                              names=["key", "item_id", "covered", "item_words", "tiles", "coverage"])

        for batch in batches:
            for own, kind, item, text in zip(*[batch.column(c).to_pylist() for c in ("key", "kind", "id")], texts(batch, "text"), strict=True):
                if block and (kind == 0 or size >= BLOCK_CHARS):
                    yield closed()
                    block, size = [], 0
                if kind == 0:
                    key, doc = own, text
                else:
                    block.append((item, text))
                    size += len(text)
        if block:
            yield closed()

    ordered = rows.repartition("key").sortWithinPartitions("key", "kind")
    return ordered.mapInArrow(run, "key binary, item_id long, covered long, item_words long, tiles long, coverage double")


def _by_seeds(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, chars: int, least: int, threshold: float) -> DataFrame:
    """`_tiles` of texts (key, text) and the items of any number that they are contaminated by."""
    known = pick(items, item_id, item_text).toDF("id", "text").select(F.col("id").cast("long").alias("id"), text_of("text").alias("text"))
    known = saved(known.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = saved(_item_seeds(known, least, threshold), "item-seeds")
    bits = min(MOST_BITS, max(20, (2 * chars).bit_length()))
    shared = bit_table(seeds.select(F.col("seed").alias("hash")).distinct(), bits)
    both = _doc_seeds(docs, shared, least).join(seeds, "seed").groupBy("key", "item").agg(F.sum("times").alias("n"), F.max("need").alias("need"))
    pairs = saved(both.filter("n >= need").select("key", "item"), "candidates")
    # Of texts that many rows have each task sends one on.
    whole = docs.join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    rows = whole.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "text").unionByName(
        pairs.join(known, "item").select("key", F.lit(1).alias("kind"), "id", "text"))
    return saved(_tiles(rows, least, threshold), "tiles")


SCHEMA = "doc_id long, item_id long, covered long, item_words long, tiles long, coverage double"


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                 item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD, broadcast_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item whose words tiles cover to at least `threshold`. Items of more than
    `broadcast_chars` characters in all are joined by their seeds."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    chars = _chars(items, item_text)
    if chars > broadcast_chars:
        keyed = rows.select("doc_id", _key(text_of("text")).alias("key"), text_of("text").alias("text"))
        found = _by_seeds(keyed.select("key", "text"), items, item_id, item_text, chars, least, threshold)
        return keyed.select("doc_id", "key").join(found, "key").drop("key")
    out = docs.sparkSession.createDataFrame([], SCHEMA)

    def found(block: list[tuple[int | None, str]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(shared.value, least)
            for batch in batches:
                hits = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text"), strict=True):
                    for item, (covered, tiles) in known.of(text).items():
                        n = len(known.words[item])
                        if covered >= threshold * n:
                            hits.append((doc, known.ids[item], covered, n, tiles, covered / n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(list(zip(*hits)) or [[]] * 6, [pa.int64()] * 5 + [pa.float64()], strict=True)],
                    names=["doc_id", "item_id", "covered", "item_words", "tiles", "coverage"])

        return rows.mapInArrow(run, SCHEMA)

    for i, block in enumerate(blocks_of(items, item_id, item_text)):
        out = found(block) if i == 0 else out.unionByName(found(block))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                      least: int = LEAST, threshold: float = THRESHOLD, broadcast_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` without contaminated rows, with all their columns; `broadcast_chars` as in `contaminated`. Rows are decided
    one by one; null and empty texts stay, and so do all rows if there is no item."""
    chars = _chars(items, item_text)
    if chars > broadcast_chars:
        key = free_name(docs, "key")
        keyed = docs.withColumn(key, _key(text_of(text_col)))
        texts_only = docs.select(_key(text_of(text_col)).alias("key"), text_of(text_col).alias("text"))
        gone = _by_seeds(texts_only, items, item_id, item_text, chars, least, threshold).select(F.col("key").alias(key)).distinct()
        return keyed.join(gone, key, "left_anti").select(*[keyed[c] for c in docs.columns])
    for block in blocks_of(items, item_id, item_text):
        docs = filtered(docs, _clean(docs.sparkSession.sparkContext.broadcast(block), text_col, least, threshold))
    return docs


def _clean(shared, text_col: str, least: int, threshold: float):
    held: list[Items] = []

    def clean(batch: pa.RecordBatch) -> np.ndarray:
        if not held:
            held.append(Items(shared.value, least))
        known = held[0]
        return np.array([not any(c >= threshold * len(known.words[i]) for i, (c, _) in known.of(text).items()) for text in texts(batch, text_col)], dtype=bool)

    return clean


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents and the items that they hold."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
