"""Archives: every record and nothing inside payloads, whatever the byte ranges."""

import base64
import hashlib

import pytest

from loomlog.llm import warc
from loomlog.session import fresh_folder

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 999\r\nContent-Length: %d\r\n\r\nhello\r\n\r\n"
PAYLOADS = ["plain", None, "", FAKE % 5, FAKE % 50, FAKE % 100_000, "a" + FAKE % 5 * 30, "WARC/1.1\r\n" * 400, "é" * 3000, "x\r\n\r\n", "WARC/1.1\r\n"]


def rows():
    return [(i if i % 13 else None, None if i % 7 == 0 else f"u{i}\r\nX: y", (PAYLOADS[i % 11] or "") + "p" * (i % 3) if i % 5 else PAYLOADS[i % 11], "t")
            for i in range(90)]


def expected(pages):
    first: dict = {}
    for i, _, html, _ in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", 1 << 60), i)
    out = []
    for i, _, html, _ in pages:
        body, of = (html or "").encode(), first.get(html or "")
        again = of is not None and (i is None or i > of)
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", of if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("files", "compression"), [(1, "none"), (3, "none"), (2, "gzip"), (1, "members"), (3, "members")])
def test_round_trip(spark, files, compression):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        pages = spark.createDataFrame(rows(), "page_id long, url string, html string, type string")
        path = fresh_folder(spark, "warc")
        warc.write_warc(pages.repartition(files), path, compression)
        found = sorted(map(tuple, warc.read_warc(spark, path, compression == "members").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == expected(rows())


def test_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>é"), (2, "v", "<p>é")], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert raw.count(b"Content-Length: 5\r\n\r\n<p>\xc3\xa9\r\n\r\n") == 1 and raw.count(b"Content-Length: 0\r\n\r\n\r\n\r\n") == 1


def test_no_pages(spark):
    path = fresh_folder(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def hostile():
    """Payloads that hold whole records of both forms; some cannot be packed, so their bytes show in the file."""
    noise = "".join(chr(0x100 + int.from_bytes(hashlib.sha256(b"%d" % i).digest()[:2], "little") % 0x700) for i in range(20_000))
    return [(1, "u" * 70_000, "a", "t"), (2, "data:" + "x" * 200_000, FAKE % 5, "t"), (3, "v", noise, "t"), (4, "w", "b" * 100_000, "t"), (5, "z", "a", "t")]


@pytest.fixture()
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("compression", ["none", "gzip", "members"])
def test_long_headers(spark, small_blocks, compression):
    pages = spark.createDataFrame(hostile(), "page_id long, url string, html string, type string")
    path = fresh_folder(spark, "warc")
    warc.write_warc(pages.coalesce(1), path, compression)
    assert sorted(map(tuple, warc.read_warc(spark, path, compression == "members").collect())) == sorted((*r,) for r in expected(hostile()))


def _member_file(tmp_path, records):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "part-0").write_bytes(b"".join(warc.member(r) + warc.EMPTY for r in records))
    return folder


def _record(i, payload):
    return (f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: {i}\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"


def test_members_inside_members(spark, tmp_path, small_blocks, monkeypatch):
    """Stored blocks show whole members and marks of a payload in the file; none of them is a record. The
    chain goes through many blocks, so pointers jump in several rounds."""
    monkeypatch.setattr(warc.zlib, "compressobj", lambda level, *rest, f=warc.zlib.compressobj: f(0, *rest))
    fake = warc.member(_record(999, b"hello")) + warc.EMPTY
    payloads = [b"p%d" % i + fake * (i % 4) + warc.EMPTY * (i % 3) + b"x" * (700 * (i % 5)) for i in range(60)]
    folder = _member_file(tmp_path, [_record(i, p) for i, p in enumerate(payloads)])
    rounds = []
    monkeypatch.setattr(warc, "saved", lambda df, name, f=warc.saved: rounds.append(name) or f(df, name))
    found = sorted(tuple(r)[:3] for r in warc.read_warc(spark, str(folder), True).collect())
    assert found == [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()) for i, p in enumerate(payloads)]
    assert rounds.count("warc-jumps") >= 3
    import gzip
    assert gzip.decompress((folder / "part-0").read_bytes()) == b"".join(_record(i, p) for i, p in enumerate(payloads))


@pytest.mark.parametrize("damage", ["cut", "flip", "plain"])
def test_broken_files_are_errors(spark, tmp_path, damage):
    folder = _member_file(tmp_path, [_record(i, b"payload %d" % i * 50) for i in range(20)])
    raw = (folder / "part-0").read_bytes()
    if damage == "plain":
        raw = b"".join(_record(i, b"x") for i in range(5)) + b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"
    (folder / "part-0").write_bytes(raw[:-30] if damage == "cut" else raw if damage == "plain" else raw[:60] + b"\0" + raw[61:])
    with pytest.raises(ValueError, match="end at|damaged"):
        warc.read_warc(spark, str(folder), damage != "plain").collect()
