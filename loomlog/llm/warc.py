"""WARC archives: written by Spark's text writer, read back in byte ranges with verified boundaries.

Writing. A record is one string, header and payload; of records with equal payloads that with the
smallest id is a response, others are revisits of it that hold no payload. Plain archives: the text writer
ends each record with its blank line, so part files are WARC files. Packed ones (`members`): each record
is a gzip member of its own, whose extra field `sl` tells its packed and unpacked length, and the text writer
ends each with an empty member, so part files are valid gzip files that can be read from the middle.

Reading. Tasks cut their byte range at every mark (a version line, an empty member), so each cut is a
candidate record; from its header it knows its successor, the offset behind its payload or member. A cut
inside a payload is a candidate too. Chains are verified by pointer jumping: only what is reached from
the start of the file is a record, and each round doubles the distance that is covered. A chain that
does not end where its file does is an error. Records that hold marks are joined again from their pieces.

Nulls: a null html is the empty payload, a null url an empty target; a null id is written as an empty
field and read as null, and never is the smallest unless all are null (such records are all responses).
Repeated rows are written each; rows that repeat the smallest id of a payload are all responses. An
empty table gives archives without records. Columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomlog.llm.common import pick, table, text_of
from loomlog.session import fresh_folder, saved

# Version line, ends of lines and records, base32 letters.
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits are four letters."""
    digits = F.sha1(payload)
    letters = []
    for group in range(8):
        number = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(LETTERS), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(value) of each record without the blank line at its end.

    Payloads are compared by SHA-256 and length. Only narrow rows are grouped; the payloads are
    shuffled once, to meet their decision.
    """
    rows = pick(pages, id_col, url_col, payload_col).toDF("id", "url", "payload").select(
        F.col("id").cast("long").alias("id"), F.coalesce("url", F.lit("")).alias("url"), text_of("payload").cast("binary").alias("payload"))
    same = F.unhex(F.sha2("payload", 256)).alias("same")
    first = rows.select(same, "id").groupBy("same").agg(F.min("id").alias("first"))
    rows = rows.withColumn("same", same).join(first, "same")
    return rows.select(_record(F.col("id") > F.col("first")).alias("value"))


def _record(revisit: Column) -> Column:
    revisit = F.coalesce(revisit, F.col("id").isNull() & F.col("first").isNotNull())
    size = F.octet_length("payload").cast("string")

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(VERSION), F.when(revisit, line("WARC-Type", "revisit")).otherwise(line("WARC-Type", "response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), key, F.lit(">"))), line("WARC-Date", "1970-01-01T00:00:00Z"),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        line("X-Page-ID", key), line("X-Payload-Length", size),
        F.when(revisit, F.concat(line("WARC-Profile", PROFILE), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
                                 line("X-Refers-To", F.col("first").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", "application/octet-stream"), F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(size), F.lit(END))
    return F.when(revisit, head).otherwise(F.concat(head, F.col("payload").cast("string")))


@dataclass(frozen=True)
class Frame:
    """How records lie in a file: `mark` separates the cuts, the first record begins at `first`."""

    mark: bytes
    first: int


#: An empty gzip member.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
FRAMES = {"none": Frame(VERSION.encode(), len(VERSION)), "members": Frame(EMPTY, 0)}


def member(record: bytes) -> bytes:
    """A gzip member with its packed and unpacked length in the extra field `sl`."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, 24 + len(body) + 8, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record))


def member_length(raw: bytes) -> int | None:
    """Packed length of the member that `raw` begins with."""
    if len(raw) < 24 or raw[:4] != b"\x1f\x8b\x08\x04" or raw[10:16] != b"\x0c\0sl\x08\0":
        return None
    return struct.unpack_from("<I", raw, 16)[0]


def write_warc(pages: DataFrame, path: str, compression: str = "none", per_file: int = 20_000, **columns: str) -> None:
    """Write archives of at most `per_file` records, plain, as `members`, or packed as whole files (`gzip`),
    which Spark and other readers unpack, but one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [member(x.as_buffer().to_pybytes() + END.encode()) for x in batch.column("value")]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    rows, end, packed = records(pages, **columns), END, compression
    if compression == "members":
        rows = rows.select(F.col("value").cast("binary")).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
        end, packed = EMPTY.decode("latin-1"), "none"
    rows.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", packed).option("maxRecordsPerFile", per_file).text(path)


CUT = ("file string, block long, rel long, size long, next_rel long, type string, page_id long, refers_to long, "
       "payload_bytes long, payload_digest string, whole boolean")
_FOUND = [("type", pa.string()), *[(n, pa.int64()) for n in ("page_id", "refers_to", "payload_bytes")], ("payload_digest", pa.string())]
_CUT = pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in ("block", "rel", "size", "next_rel")], *_FOUND, ("whole", pa.bool_())])


def ranges(spark: SparkSession, path: str, frame: Frame) -> DataFrame:
    """(file, block, value): what lies between marks, in file order within a block."""
    lines = spark.read.option("lineSep", frame.mark.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fields(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of the header that `raw` begins with, and its length, however long it is."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = [line.partition(b":") for line in raw[:end].split(b"\r\n")]
    if not all(colon for _, colon, _ in lines):
        return None
    return {n.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for n, _, v in lines}, end + 4


def _number(text: str | None) -> int | None:
    return int(text) if text and text.removeprefix("-").isascii() and text.removeprefix("-").isdigit() else None


def _record_of(raw: bytes) -> dict | None:
    """What a record tells, and the length `next` that its header claims, without its version line; None without a
    readable header. The digest of a payload that is not all there stays open."""
    found = _fields(raw)
    size = _number(found[0].get("content-length")) if found else None
    if size is None or size < 0:
        return None
    fields, head = found
    kind, end = fields.get("warc-type"), head + size + len(END)
    row = {"next": end, "type": kind, "page_id": _number(fields.get("x-page-id")), "refers_to": _number(fields.get("x-refers-to")),
           "payload_bytes": size, "payload_digest": None}
    if kind == "revisit":
        row |= {"payload_bytes": _number(fields.get("x-payload-length")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
    elif end <= len(raw):
        row["payload_digest"] = digest_of(raw[head : head + size])
    return row


def _unpacked(raw: bytes) -> dict | None:
    """What the record in a whole member tells."""
    try:
        record = zlib.decompress(raw, 31)
    except zlib.error:
        return None
    return _record_of(record.removeprefix(VERSION.encode()))


def _cut(file: str, block: int, rel: int, raw: bytes, frame: Frame) -> dict:
    """A candidate; without a readable header it has no successor."""
    row = dict.fromkeys(_CUT.names) | {"file": file, "block": block, "rel": rel, "size": len(raw), "whole": True}
    if frame.mark == EMPTY:
        size = member_length(raw)
        if size is None:
            return row
        row |= {"whole": size <= len(raw)}
        found = (_unpacked(raw) if size == len(raw) else None) or {}
    else:
        found = _record_of(raw)
        if found is None:
            return row
        size = found["next"]
        row |= {"whole": found["payload_digest"] is not None}
    return row | {n: found.get(n) for n, _ in _FOUND} | {"next_rel": rel + size + len(frame.mark)}


def _placed(batches: Iterator[pa.RecordBatch], frame: Frame) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, offset from the block's first cut, value) of a task's ranges."""
    at, place = 0, None
    for batch in batches:
        for file, block, raw in zip(*(batch.column(n).to_pylist() for n in ("file", "block", "value")), strict=True):
            if (file, block) != place:
                place, at = (file, block), 0
            yield file, block, at, raw
            at += len(raw) + len(frame.mark)


def candidates(spark: SparkSession, path: str, frame: Frame) -> DataFrame:
    """All cuts with their place, written once: offsets `start` and `next` of candidates and their
    successors, counted behind the mark before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for place in _placed(batches, frame):
            out.append(_cut(*place, frame))
            if len(out) == 5000:
                yield pa.RecordBatch.from_pylist(out, schema=_CUT)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=_CUT)

    cuts = saved(ranges(spark, path, frame).mapInArrow(run, CUT), "warc-cuts")
    # One row per block of a file: a block begins where those before it end.
    blocks = cuts.groupBy("file", "block").agg(F.sum(F.col("size") + len(frame.mark)).alias("length"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base"))
    return cuts.join(blocks, ["file", "block"]).withColumn("start", F.col("base") + F.col("rel")).withColumn("next", F.col("base") + F.col("next_rel"))


def _walked(keys: tuple, rows: pa.Table) -> pa.Table:
    """Of each candidate of a block, where its chain leaves the block."""
    starts, nexts = rows.column("start").to_pylist(), rows.column("next").to_pylist()
    leaves: dict[int, int] = {}
    for start, to in sorted(zip(starts, nexts, strict=True), reverse=True):
        leaves[start] = leaves.get(to, to)
    return pa.table({"file": rows.column("file"), "start": rows.column("start"), "to": pa.array([leaves[s] for s in starts], pa.int64())})


def _marked(keys: tuple, rows: pa.Table) -> pa.Table:
    """The candidates of a block that its entry reaches."""
    nexts = dict(zip(rows.column("start").to_pylist(), rows.column("next").to_pylist(), strict=True))
    at, reached = rows.column("entry")[0].as_py(), []
    while at in nexts:
        reached.append(at)
        at = nexts[at]
    return pa.table({"file": pa.array([keys[0].as_py()] * len(reached), pa.string()), "start": pa.array(reached, pa.int64())})


def reachable(cuts: DataFrame, frame: Frame) -> DataFrame:
    """(file, start) of the candidates on the chain from the start of each file.

    Each task first follows chains within its block, so pointers jump from block to block; every round
    doubles them, and a file of one block needs none.
    """
    held = cuts.filter("next is not null").select("file", "block", "start", "next")
    starts = held.select("file", "start")
    leaves = held.groupBy("file", "block").applyInArrow(_walked, "file string, start long, to long")
    jumps = saved(leaves.join(starts.withColumnRenamed("start", "to"), ["file", "to"]), "warc-jumps")
    entries = starts.filter(F.col("start") == frame.first)
    while not jumps.isEmpty():
        further = jumps.join(entries, ["file", "start"]).select("file", F.col("to").alias("start"))
        entries = saved(entries.unionByName(further).distinct(), "warc-entries")
        jumps = saved(jumps.alias("a").join(jumps.alias("b"), F.expr("a.file = b.file and a.to = b.start")).select("a.file", "a.start", "b.to"), "warc-jumps")
    entered = entries.join(held.select("file", "start", "block"), ["file", "start"]).select("file", "block", F.col("start").alias("entry"))
    return held.join(entered, ["file", "block"]).groupBy("file", "block").applyInArrow(_marked, "file string, start long")


def _joined_pieces(keys: tuple, rows: pa.Table, frame: Frame) -> pa.Table:
    """What a record tells that holds marks, from its pieces."""
    pieces = sorted(rows.select(["start", "size", "value"]).to_pylist(), key=lambda r: r["start"])
    raw = frame.mark.join([r["value"] for r in pieces])
    if frame.mark == EMPTY:
        found = _unpacked(raw[: member_length(raw)])
    else:
        found = _record_of(raw)
    if found is None or found["payload_digest"] is None:
        raise ValueError("a record is cut off or damaged")
    return pa.table({"file": pa.array([keys[0].as_py()]), "start": pa.array([pieces[0]["start"]], pa.int64()),
                     **{n: pa.array([found[n]], t) for n, t in _FOUND}})


def _checked(cuts: DataFrame, held: DataFrame, frame: Frame) -> None:
    """Raise unless the chain of every file ends at its end."""
    ends = cuts.groupBy("file").agg(F.max(F.col("start") + F.col("size") + len(frame.mark)).alias("end"))
    last = held.groupBy("file").agg(F.max("next").alias("last"))
    odd = ends.join(last, "file", "left").filter((F.col("end") > len(frame.mark)) & ~F.col("last").eqNullSafe(F.col("end"))).first()
    if odd:
        raise ValueError(f"the records of {odd['file']} end at {odd['last']}, not at {odd['end']}")


def read_warc(spark: SparkSession, path: str, members: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record."""
    frame = FRAMES["members" if members else "none"]
    cuts = candidates(spark, path, frame)
    held = saved(reachable(cuts, frame).join(cuts, ["file", "start"]), "warc-records")
    _checked(cuts, held, frame)
    fields = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    parted, whole = held.filter("not whole"), held.filter("whole")
    damaged = whole.filter("type is null").first()
    if damaged:
        raise ValueError(f"a record at {damaged['start']} of {damaged['file']} is damaged")
    if parted.isEmpty():
        return whole.select(*fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, rel, raw in _placed(batches, frame):
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "rel": [rel], "value": [raw]})

    # Pieces belong to the last record that begins at or before them.
    owners = cuts.select("file", "block", "rel", "start", "size").join(held.select("file", "start", F.col("start").alias("owner")), ["file", "start"], "left")
    so_far = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owners = owners.withColumn("owner", F.last("owner", ignorenulls=True).over(so_far))
    needs = parted.select("file", F.col("start").alias("owner"))
    pieces = (ranges(spark, path, frame).mapInArrow(run, "file string, block long, rel long, value binary")
              .join(owners.join(needs, ["file", "owner"]), ["file", "block", "rel"]))
    joined = pieces.groupBy("file", "owner").applyInArrow(lambda keys, rows: _joined_pieces(keys, rows, frame),
                                                          "file string, start long, type string, page_id long, refers_to long, payload_bytes long, payload_digest string")
    return whole.select(*fields).unionByName(joined.select(*fields))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives of packed records and back."""
    path = fresh_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, compression="members")
    return read_warc(spark, path, members=True)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body),
h AS (SELECT page_id, first, strlen(body) AS payload_bytes, sha1(body) AS d FROM p JOIN f USING (body))
SELECT page_id, payload_bytes,
       array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(d, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)]
                        FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id > first OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first OR page_id IS NULL AND first IS NOT NULL THEN first END AS refers_to
FROM h
"""
