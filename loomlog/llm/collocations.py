"""Phrase collocations: frequent n-grams by Misra-Gries summaries, counted exactly, scored by their cuts.

Texts are lower-cased (A-Z), split at punctuation into pieces and at blanks into words; a phrase is two to
`most` neighbouring words of a piece. All counts are per language.

Candidates are found by rounds of one, two and then more words. A round takes the n-grams whose shorter
parts have survived, under a 64-bit hash that deals them out to buckets. Every task sums what it has read
into one summary per bucket; the summaries of a bucket are merged into one of more counters than the
bucket's mass divided by the threshold: whenever it has more, the count of the largest superfluous one is
taken off all. What is taken off so stays below the threshold, so every frequent n-gram survives; what
cannot reach the threshold even with that added is dropped. Survivors are kept as two bits each of a table
of fixed size. Bits that several hashes share let n-grams through that are not frequent; they are dropped
after the second pass, which counts by the words themselves. A bucket's summary is all that a task holds, and
it shrinks with the number of buckets, four per shuffle partition.

Scores: cutting a candidate of frequency a into two parts of frequencies l and r gives
floor(2000000 a / (l + r)); the lowest counts. Candidates that lie inside a longer one which has at
least `inside` percent of their frequency are dropped. Each language keeps its first `top`.

Nulls: a null text is empty, a null language is `und`. Ids are not read, so rows that repeat count each
time. Empty texts have no words; long texts are worked through in pieces of `STEP` bytes. An empty table
gives no rows. Columns other than the language and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomlog.llm.common import pick, table
from loomlog.session import saved

LEAST, MOST, INSIDE, TOP = 30, 4, 80, 2000
#: Bytes of text that are looked at together.
STEP = 1 << 22
#: Different n-grams that a task sums up before it sends them on.
HELD = 1 << 21
#: Phrases that a task of the second pass counts up before it sends them on.
COUNTED = 1 << 20
#: Bits of the table of survivors of a round (8 MB).
BITS = 26
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

# Bytes: 0 part of a word, 1 blank, 2 end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: `code` of each in `words`, and whether it stands in the piece of the next
    one, or of the one after that, and so on (`joined[k]`: k + 1 words in a row). The first `known`
    words of a text have been counted with the part before it."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, known: np.ndarray, lang_names: list[str], most: int) -> None:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        kind = _KIND[raw]
        inside = kind == 0
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[starts[sizes > 0]] = False
        after[ends[sizes > 0] - 1] = False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        doc = np.searchsorted(starts, first, "right") - 1
        # Among texts that begin at one place only the last is not empty.
        piece = np.searchsorted(np.flatnonzero(kind == 2), first) + doc
        offsets = np.concatenate([[0], np.cumsum(last - first)])
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
        coded = column.dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.lang = langs[doc] if len(doc) else np.zeros(0, np.int64)
        self.lang_names = lang_names
        self.code = coded.indices.to_numpy().astype(np.int64)
        rank = np.arange(len(first)) - np.searchsorted(doc, doc)
        self.new = rank >= known[doc] if known.any() else None
        self.joined = [piece[k:] == piece[: max(len(piece) - k, 0)] for k in range(1, most)]

    def hashes(self, most: int) -> list[np.ndarray]:
        """64-bit hashes of the runs of 1 to `most` words from each word on, of pieces or not."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        lang = np.array([xxhash.xxh64_intdigest(n, 1) for n in self.lang_names], np.uint64)
        h = [_mixed(own[self.code] ^ lang[self.lang]) if len(self.code) else np.zeros(0, np.uint64)]
        for k in range(1, most):
            n = max(len(self.code) - k, 0)
            h.append(_mixed(h[-1][:n] * _MIX[0] + h[0][k:]))
        return h

    def passing(self, h: list[np.ndarray], tables: list[np.ndarray | None]) -> list[np.ndarray]:
        """For each length, which runs stand in one piece, have only passing parts, and pass the table of
        their length if there is one."""
        out = []
        for k, t in enumerate(tables):
            good = np.ones(len(h[k]), bool) if k == 0 else self.joined[k - 1] & out[-1][: len(h[k])] & out[-1][1 : len(h[k]) + 1]
            if t is not None:
                at = np.flatnonzero(good)
                good[at[~_held(t, h[k][at])]] = False
            out.append(good)
        return out

    def counted(self, good: np.ndarray, k: int) -> np.ndarray:
        """Places of the runs of k + 1 words that pass and end in a word not counted before."""
        return np.flatnonzero(good if self.new is None else good & self.new[k : k + len(good)])


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    out = np.ones(len(h), bool)
    for part in (h, h >> np.uint64(32)):
        slot = part & np.uint64(len(bits) * 8 - 1)
        out &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Words]:
    """Words of the texts of (lang, text) batches, about `STEP` bytes at a time. A longer text is cut
    behind the end of a piece, else at a blank, and then goes on some words before that."""
    texts, langs, known, names, size = [], [], [], {}, 0

    def flush() -> Words:
        return Words(texts, np.array(langs, np.int64), np.array(known, np.int64), list(names), most)

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            raw = memoryview(text.as_buffer() or b"")
            at, seen, done = 0, 0, 0
            while True:
                to, back, words = _cut(raw, at, seen, most)
                texts.append(bytes(raw[at:to]))
                langs.append(names.setdefault(lang, len(names)))
                known.append(done)
                size += to - at
                if size >= STEP:
                    yield flush()
                    texts, langs, known, names, size = [], [], [], {}, 0
                if to == len(raw):
                    break
                at, seen, done = back, to, words
    if texts:
        yield flush()


def _cut(raw: memoryview, at: int, seen: int, most: int) -> tuple[int, int, int]:
    """(to, back, words): where the part of a text ends that begins at `at` and is counted up to `seen`;
    where the next one begins, and how many of its words are counted by then."""
    step = seen + STEP
    if len(raw) <= step + STEP:
        return len(raw), len(raw), 0
    for end in (step + STEP, len(raw)):  # the second only where a whole step holds one word
        kind = _KIND[np.frombuffer(raw[step:end], np.uint8)]
        if (ends := np.flatnonzero(kind == 2)).size:
            to = step + int(ends[0]) + 1
            return to, to, 0
        if (blanks := np.flatnonzero(kind == 1)).size:
            to = back = step + int(blanks[0])
            words = 0
            while words < most - 1 and back > at:
                back -= 1
                words += _KIND[raw[back]] == 0 and (back == at or _KIND[raw[back - 1]] != 0)
            return to, back, int(words)
    return len(raw), len(raw), 0


def _merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their summed counts."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Summary:
    """Misra-Gries counters of hashes. `off` is what has been taken off every count so far, at most."""

    def __init__(self, mass: int, least: int) -> None:
        self.room, self.least, self.off = mass // least + 1, least, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray, off: int = 0) -> None:
        """Merge another summary, `off` taken off it."""
        self.off += off
        self.waiting.append((hashes, counts))
        self.n_waiting += len(hashes)
        if self.n_waiting > max(self.room, 1 << 16):
            self.shrink()

    def shrink(self) -> None:
        parts = [(self.hashes, self.counts), *self.waiting]
        self.hashes, self.counts = _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        self.waiting, self.n_waiting = [], 0
        if len(self.hashes) > self.room:
            cut = int(np.partition(self.counts, len(self.counts) - self.room - 1)[len(self.counts) - self.room - 1])
            keep = self.counts > cut
            self.hashes, self.counts, self.off = self.hashes[keep], self.counts[keep] - cut, self.off + cut

    def survivors(self) -> np.ndarray:
        self.shrink()
        return self.hashes[self.counts + self.off >= self.least]


_LOCAL = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("mass", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _summaries(docs: DataFrame, first: int, last: int, tables: list, buckets: int) -> DataFrame:
    """Per task and bucket the mass (kind 0) and the summed hashes (kind 1) of the runs of `first` to
    `last` words that the tables let through."""

    def rows(held: list[np.ndarray], sums: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = _merged(np.concatenate(held), np.concatenate(sums))
        bounds = np.searchsorted(hashes, (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64))
        bounds = np.concatenate([[0], bounds, [len(hashes)]]).tolist()
        used = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
        cut = [slice(bounds[b], bounds[b + 1]) for b in used]
        none = [None] * len(used)
        return pa.RecordBatch.from_arrays([
            pa.array(used * 2, pa.int32()), pa.array([0] * len(used) + [1] * len(used), pa.int32()),
            pa.array([int(counts[c].sum()) for c in cut] + none, pa.int64()),
            pa.array(none + [hashes[c].tobytes() for c in cut], pa.binary()),
            pa.array(none + [counts[c].tobytes() for c in cut], pa.binary())], schema=_LOCAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [None if t is None else np.frombuffer(t.value, np.uint8) for t in tables]
        held, sums, n = [], [], 0
        for words in _parts(batches, last):
            h = words.hashes(last)
            good = words.passing(h, bits)
            found = np.concatenate([h[k][words.counted(good[k], k)] for k in range(first - 1, last)])
            hashes, counts = _merged(found, np.ones(len(found), np.int64))
            held.append(hashes)
            sums.append(counts)
            n += len(hashes)
            if n >= HELD:
                yield rows(held, sums)
                held, sums, n = [], [], 0
        if n:
            yield rows(held, sums)

    return docs.mapInArrow(run, "bucket int, kind int, mass long, hashes binary, counts binary")


def _survivors(local: DataFrame, least: int) -> DataFrame:
    """(hash) of the n-grams that may be frequent: the summaries of each bucket merged, one after the
    other. The masses of a bucket come first, as its summary is sized by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, mass, summary = None, 0, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], names=["hash"])

        for batch in batches:
            for i in range(batch.num_rows):
                own, kind = batch.column("bucket")[i].as_py(), batch.column("kind")[i].as_py()
                if own != bucket:
                    if summary is not None:
                        yield closed()
                    bucket, mass, summary = own, 0, None
                if kind == 0:
                    mass += batch.column("mass")[i].as_py()
                else:
                    summary = summary or Summary(mass, least)
                    summary.add(*(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("hashes", "<u8"), ("counts", "<i8"))))
        if summary is not None:
            yield closed()

    parts = int(local.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return local.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, "hash long")


def _bits(hashes: DataFrame, bits: int):
    """Broadcast of the bit table of some hashes, two bits each. The driver sees words of the table, never
    hashes: at most its fixed size."""
    mask = F.lit((1 << bits) - 1).cast("long")
    slots = hashes.select(F.explode(F.array(F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask))).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    made = np.zeros(1 << (bits - 6), "<i8")
    made[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(made.tobytes())


def frequent(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST,
             bits: int = BITS) -> DataFrame:
    """(lang, phrase, k, n): exact counts of all runs of 1 to `most` words that occur `least` times in their
    language, and one row per language with k = 0 and all its words in n."""
    spark = docs.sparkSession
    rows = pick(docs, lang_col, text_col).toDF("lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                                                                     F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables: list = []
    rounds = [(1, 1), (2, 2), (3, most)][: min(most, 3)]
    for first, last in rounds:
        found = _survivors(_summaries(rows, first, last, tables + [None] * (last - first + 1), buckets), least)
        shared = _bits(saved(found, "survivors"), bits)
        tables += [shared] * (last - first + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task has read, one row a bucket."""
        shared = [np.frombuffer(t.value, np.uint8) for t in tables]
        total: dict[tuple, int] = {}

        def rows() -> pa.RecordBatch:
            langs, phrases, ks = (list(x) for x in zip(*total))
            bucket = np.fromiter((xxhash.xxh64_intdigest(p) % buckets for p in phrases), np.int64, len(phrases))
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            offsets, order = pa.array(np.append(first, len(order)), pa.int32()), pa.array(order)
            columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(ks, pa.int32()), pa.array(list(total.values()), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.ListArray.from_arrays(offsets, c.take(order)) for c in columns]],
                                              names=["bucket", *_COUNTED])

        for words in _parts(batches, most):
            for key, n in _exact(words, shared):
                total[key] = total.get(key, 0) + n
            if len(total) >= COUNTED:
                yield rows()
                total.clear()
        if total:
            yield rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of each bucket, summed up again whenever many rows have come together."""
        bucket, parts, n = None, [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(parts).group_by(["lang", "phrase", "k"]).aggregate([("n", "sum")]).rename_columns(_COUNTED)

        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("bucket")[i].as_py()
                if own != bucket and parts:
                    yield from _batches(summed(), least)
                    parts, n = [], 0
                bucket = own
                parts.append(pa.table({c: batch.column(c)[i].values for c in _COUNTED}))
                n += len(parts[-1])
                if n > COUNTED:
                    parts = [summed()]
                    n = len(parts[0])
        if parts:
            yield from _batches(summed(), least)

    local = rows.mapInArrow(count, "bucket int, lang array<string>, phrase array<binary>, k array<int>, n array<long>")
    shuffled = local.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket")
    counts = shuffled.mapInArrow(add, "lang string, phrase binary, k int, n long")
    return saved(counts.withColumn("phrase", F.col("phrase").cast("string")), "frequent")


_COUNTED = ["lang", "phrase", "k", "n"]


def _batches(counts: pa.Table, least: int) -> list[pa.RecordBatch]:
    """Frequent runs and the totals of languages."""
    return counts.filter((pc.field("n") >= least) | (pc.field("k") == 0)).to_batches()


def _exact(words: Words, tables: list[np.ndarray]) -> Iterator[tuple[tuple, int]]:
    """((lang, phrase, k), n) of the runs that pass the tables, told apart by their words."""
    if not len(words.code):
        return
    n_words = len(words.words)
    new = np.arange(len(words.code)) if words.new is None else np.flatnonzero(words.new)
    for lang, n in enumerate(np.bincount(words.lang[new], minlength=len(words.lang_names)).tolist()):
        if n:
            yield (words.lang_names[lang], b"", 0), n
    good = words.passing(words.hashes(len(tables)), tables)
    # Of each run so far: its number among those of its length, exact because it is made from the number
    # of the run one word shorter and the last word.
    number = words.lang * n_words + words.code
    for k in range(len(tables)):
        at = np.flatnonzero(good[k])
        key = number[at] if k == 0 else number[at] * n_words + words.code[at + k]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        number = np.full(len(words.code), -1, np.int64)
        number[at] = inverse
        counted = words.counted(good[k], k)
        times = np.bincount(number[counted], minlength=len(first))
        for place, n in zip(at[first].tolist(), times.tolist()):
            if n:
                yield (words.lang_names[words.lang[place]], b" ".join([words.words[c] for c in words.code[place : place + k + 1].tolist()]), k + 1), n


def _score(a: Column, rest: Column) -> Column:
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(2000000).cast("decimal(7,0)"), rest.cast("decimal(20,0)"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST,
                 inside: int = INSIDE, top: int | None = TOP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language; `top` None: all."""
    counts = frequent(docs, lang_col, text_col, least, most, bits)
    known = counts.filter("k > 0").select("lang", "phrase", "n")
    phrases = counts.filter("k > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))

    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"),
                       F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("tail"))
    for part, out in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(out)), ["lang", part])
    lowest = F.min(F.struct(_score(F.col("a"), F.col("l").cast("decimal(20,0)") + F.col("r")).alias("score"), "cut", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    sizes = F.expr("sequence(2, size(words) - 1)")
    parts = F.flatten(F.transform(sizes, lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1),
                                                                  lambda at: F.array_join(F.slice("words", at, size), " "))))
    around = (phrases.filter("size(words) > 2").select("lang", F.explode(parts).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    percent = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * inside
    kept = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~percent)

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top:  # the best of each share of a language first, so that no task sorts all of one
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        kept = kept.withColumn("_rank", F.row_number().over(share)).filter(F.col("_rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top:
        kept = kept.filter(F.col("rank") <= top)
    totals = counts.filter("k = 0").select("lang", "n")
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, a, k, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT c.*, unnest(range(1, k)) AS j FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * cut.a) // (x.a + y.a) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:j], ' ')
      JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[j + 1:cut.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(ws[b:b + size - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, ws, a, k, size, unnest(range(1, k - size + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS size FROM c)) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, encode(phrase)) AS rank
      FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

