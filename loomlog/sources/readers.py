"""Readers: transcripts, hook events, session logs, articles, responses."""

from __future__ import annotations

import bz2
import gzip
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.front_matter import GENERATED_FILES, unix_newlines
from loomlog.functions.titles import log_name_session, log_name_time
from loomlog.operators.transcripts import parse_entries

EVENT_SCHEMA = ("session_id string, transcript_path string, cwd string, prompt string, mode string, "
                "title string, event_id long, ts timestamp")
RESPONSE_SCHEMA = ("run_id long, kind string, brain string, log_date date, session_file string, attempt int, "
                   "run_ts timestamp, text string")

_ROW_BITS = (1 << 33) - 1
#: Rows and bytes of files that a task holds before it hands them on.
_FILE_ROWS, _FILE_BYTES = 10_000, 4 << 20


def _path() -> Column:
    return F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def line_order() -> Column:
    """Order key of a text line within its file: start of its block plus the row count in
    the read task. It grows with the line and is unique in the file, but is not dense
    (`line_number` makes it so). No shuffle and no window, however large the file."""
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))


def read_transcript_lines(spark: SparkSession, path: str, session_pattern: str = r"([^/_]+)\.jsonl$",
                          day_pattern: str = r"/(\d{4}-\d{2}-\d{2})/") -> DataFrame:
    """(session_id, log_date, file, line_no, raw) of every non-blank line; id and date (null where
    there is none) are taken from the file path. Lines are in order within their file: a store
    with dated copies of one session holds its turns several times, see `latest_copies`."""
    return (spark.read.option("recursiveFileLookup", "true").text(path)
            .select(F.regexp_extract(_path(), session_pattern, 1).alias("session_id"),
                    F.try_to_date(F.regexp_extract(_path(), day_pattern, 1), "yyyy-MM-dd").alias("log_date"),
                    _path().alias("file"), line_order().alias("line_no"), F.col("value").alias("raw"))
            .filter(F.trim("raw") != ""))


def latest_copies(lines: DataFrame) -> DataFrame:
    """Lines of the latest copy of each session (session_id, log_date, file, ..)."""
    latest = (lines.groupBy("session_id").agg(F.max(F.struct("log_date", "file")).alias("_latest"))
              .select("session_id", F.col("_latest.file").alias("file")))
    return lines.join(latest, ["session_id", "file"], "left_semi")


def read_transcripts(spark: SparkSession, path: str, session_pattern: str = r"([^/_]+)\.jsonl$") -> DataFrame:
    """Typed transcript lines; malformed ones stay as rows with is_entry = false."""
    return parse_entries(read_transcript_lines(spark, path, session_pattern))


def parse_hook_events(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON payload lines as events. What is no JSON object is dropped; a missing session id
    becomes `unknown`, a missing directory or prompt empty."""
    payload = F.col(col)
    good = lines.filter(F.startswith(F.ltrim(payload), F.lit("{")) & F.try_parse_json(payload).isNotNull())
    return (good.withColumn("_e", F.from_json(payload, EVENT_SCHEMA)).select("_e.*")
            .withColumn("session_id", F.coalesce("session_id", F.lit("unknown")))
            .withColumn("cwd", F.coalesce("cwd", F.lit("")))
            .withColumn("prompt", F.coalesce("prompt", F.lit(""))))


def read_hook_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return parse_hook_events(reader.text(path))


def read_session_logs(spark: SparkSession, root: str, day_pattern: str = r"/(\d{4}-\d{2}-\d{2})/[^/]*\z",
                      name_pattern: str = r"([^/]*)\z", glob: str = "*.md") -> DataFrame:
    """Narrative files `<root>/<date>/<name>.md` line by line: log_date, file_name, hhmmss,
    session_id, line_no, line. A log of any size is read in splits. The patterns take date
    and name from the file path."""
    name = F.col("file_name")
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
            .select(F.try_to_date(F.regexp_extract(_path(), day_pattern, 1), "yyyy-MM-dd").alias("log_date"),
                    F.regexp_extract(_path(), name_pattern, 1).alias("file_name"),
                    line_order().alias("line_no"), F.col("value").alias("line"))
            .filter("log_date is not null")
            .withColumn("hhmmss", log_name_time(name)).withColumn("session_id", log_name_session(name)))


def _is_shown(name: str, folder: bool) -> bool:
    """Names that Spark's file sources do not take for hidden."""
    listed = "=" in name or folder and name.startswith(("_metadata", "_common_metadata"))
    return not (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and not listed)


def _entries(folder: str, deep: bool) -> Iterator[tuple[str, bool]]:
    """(path, is folder) of what lies in a folder or, with `deep`, of all files below it, as they are listed."""
    with os.scandir(folder) as found:
        for e in found:
            folder = e.is_dir()
            if _is_shown(e.name, folder):
                if folder:
                    yield from _entries(e.path, True) if deep else [(e.path, True)]
                elif e.is_file():
                    yield e.path, False


def _lister(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found = (entry for path, folder in given for entry in (_entries(path, deep) if folder else [(path, False)]))
        for rows in batched(found, _FILE_ROWS):
            paths, folders = zip(*rows)
            yield pa.record_batch({"file": pa.array(paths, pa.string()), "folder": pa.array(folders, pa.bool_())})

    return run


def _lz4_size(data: bytes) -> int:
    """Bytes that a raw LZ4 block holds: literals and matches, their lengths carried on while they are 255."""
    at, size = 0, 0

    def length(n: int) -> int:
        nonlocal at
        more = n == 15
        while more:
            n, more, at = n + data[at], data[at] == 255, at + 1
        return n

    while at < len(data):
        token, at = data[at], at + 1
        literals = length(token >> 4)
        at, size = at + literals, size + literals
        if at < len(data):
            at += 2
            size += length(token & 15) + 4
    return size


def _snappy_size(data: bytes) -> int:
    size = 0
    for n, byte in enumerate(data):
        size |= (byte & 127) << 7 * n
        if byte < 128:
            break
    return size


def _unpack_blocks(codec: str, size: Callable[[bytes], int]) -> Callable[[bytes], bytes]:
    """Hadoop's block files: the length of a block, then its chunks, each after its packed length."""
    def run(data: bytes) -> bytes:
        at, out = 0, bytearray()
        while at < len(data):
            end, at = len(out) + int.from_bytes(data[at:at + 4], "big"), at + 4
            while len(out) < end:
                n, at = int.from_bytes(data[at:at + 4], "big"), at + 4
                chunk, at = data[at:at + n], at + n
                out += pa.Codec(codec).decompress(chunk, size(chunk), asbytes=True)
        return bytes(out)

    return run


def _unpack_zstd(data: bytes) -> bytes:
    return pa.input_stream(pa.BufferReader(data), compression="zstd").read()


#: Files that Spark unpacks, by their suffix.
_UNPACK = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".deflate": zlib.decompress, ".zst": _unpack_zstd,
           ".lz4": _unpack_blocks("lz4_raw", _lz4_size), ".snappy": _unpack_blocks("snappy", _snappy_size)}


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def held() -> pa.RecordBatch:
        return pa.record_batch({"file": pa.array(paths, pa.string()), "value": pa.array(texts, pa.binary())})

    paths, texts, size = [], [], 0
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as f:
                text = f.read()
            if not text:
                continue  # a file source has no row for it
            text = _UNPACK.get(os.path.splitext(path)[1], bytes)(text)
            paths.append(path)
            texts.append(text)
            size += len(text)
            if size >= _FILE_BYTES or len(paths) >= _FILE_ROWS:
                yield held()
                paths, texts, size = [], [], 0
    if paths:
        yield held()


def _local_files(spark: SparkSession, base: str, glob: str) -> DataFrame:
    """(file, value) of every file below a local folder that all tasks see. Tasks list the folders and read the
    files, so no list of files passes through the driver; names are listed as they come and dealt out twice: what lies
    in the folder itself, then all files."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = "file string, folder boolean"
    root = spark.range(0, 1, 1, 1).select(F.lit(base).alias("file"), F.lit(True).alias("folder"))
    inside = root.mapInArrow(_lister(False), names).repartition(tasks, "file")
    # The pattern as Hadoop reads it: braces, classes.
    named = F.lit(rf"(?s)/(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()})\z")
    files = inside.mapInArrow(_lister(True), names).select("file").filter(F.regexp(F.concat(F.lit("/"), F.substring_index("file", "/", -1)), named))
    return (files.repartition(tasks, "file").mapInArrow(_read_whole, "file string, value binary")
            .select("file", F.col("value").cast("string").alias("value")))


def _spark_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """The same by Spark's reader, which lists all files on the driver."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .text(root, wholetext=True).select(_path().alias("file"), "value"))


def read_articles(spark: SparkSession, root: str, brain: str, prefix: str = "library/", glob: str = "*.md") -> DataFrame:
    """Articles below `root` (brain, path, content), without the generated files at the root.
    One article is one document written by one edit, so it is read as one value. `root` is one
    folder in any file system; a file that does not lie below it by name is an error.

    A local folder is listed and read by the tasks, when the rows are asked for: the driver holds nothing that grows with the
    number of files. Elsewhere Spark lists the files, on the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.toUri().getPath().rstrip("/") + "/"
    below = r"\A(?:[^:/]+:(?://[^/]*)?)?\Q" + base + r"\E(.+)\z"
    scheme = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getScheme()
    local = scheme == "file" and base.startswith("/") and not set(base) & set("{}[]*?\\") and os.path.isdir(base)
    files = _local_files(spark, base, glob) if local else _spark_files(spark, root, glob)
    rel = F.when(F.col("file").rlike(below), F.regexp_extract("file", below, 1)).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {base}: "), F.col("file"))))
    return (files.select(F.lit(brain).alias("brain"), rel.alias("_rel"), unix_newlines(F.col("value")).alias("content"))
            .filter(~F.col("_rel").isin(*GENERATED_FILES))
            .select("brain", F.concat(F.lit(prefix), "_rel").alias("path"), "content"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved response texts, kept as they came."""
    return spark.read.schema(RESPONSE_SCHEMA).parquet(path)
