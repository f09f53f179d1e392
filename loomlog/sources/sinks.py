"""Append-only tables and text documents."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from loomlog.functions.titles import truncate_text
from loomlog.operators.compile_window import latest_cursor

CURSOR_SCHEMA = "brain string, cursor_date date, cursor_session string, run_ts timestamp"
ERROR_LIMIT = 500


def append_partitioned(df: DataFrame, root: str, by: Sequence[str]) -> None:
    """Append below partition folders. The rebalance hint lets Spark join small partitions
    and split large ones, so a hot day is written by many tasks."""
    df.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(root)


def stored(spark: SparkSession, root: str, schema: str | StructType | None = None) -> DataFrame | None:
    """A written table, or None where there is none yet or no file is left. Any other trouble is an
    error."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(root)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_session_log(narrative: DataFrame, root: str) -> None:
    """Append the narrative lines (see `session_narrative`) that the log does not hold yet, so a
    session has one header a day and a repeated run adds nothing. Only the keys of the days
    concerned are read."""
    keys = ["store", "log_date", "session_id", "line_no"]
    old = stored(narrative.sparkSession, root)
    if old is not None:
        days = narrative.select("log_date").distinct()
        narrative = narrative.join(old.select(*keys).join(days, "log_date", "left_semi"), keys, "left_anti")
    append_partitioned(narrative, root, ["store", "log_date"])


def write_snapshot(snapshots: DataFrame, root: str) -> None:
    """Append transcript copies; readers take `latest_snapshot`."""
    append_partitioned(snapshots, root, ["store", "log_date"])


def write_versions(versions: DataFrame, root: str) -> None:
    append_partitioned(versions, root, ["brain"])


def write_document(lines: DataFrame, order: Sequence[Column | str], path: str, col: str = "line") -> None:
    """Write ordered lines as text. The sort is by range, so part files in name order are the
    document and no task holds all of it."""
    lines.orderBy(*order).select(col).write.text(path)


def write_text_files(rows: DataFrame, root: str, by: Sequence[str], col: str, order: Sequence[str] = ()) -> None:
    """Write each group of `by` as one text file of its `col` values, a line each, in `order`:
    `<root>/<by>=<value>/../<file>`, the layout of a text table partitioned by these columns. A group of any size
    is written as its rows come.

    In a local folder the tasks write the files themselves: Hadoop's local file system without its native library
    starts a process to set the permissions of every folder, file and checksum file, which costs far more than
    the file. A file appears whole under its one name, so a task that runs again leaves no second copy."""
    spark, keys = rows.sparkSession, list(by)
    # Null and the empty text share a folder.
    named = rows.withColumns({k: F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys})
    groups = named.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, col)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    target = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    if target.getScheme() == "file":
        os.makedirs(target.getPath())
        groups.mapInArrow(_file_writer(target.getPath(), keys), "files long").agg(F.sum("files")).collect()
    else:
        groups.write.partitionBy(*keys).option("lineSep", "\n").text(root)


def _folder_value(value: str | None) -> str:
    """A value in a folder name, escaped as Spark does."""
    if value is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)


def _file_writer(root: str, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, folder, out, files = None, "", None, 0
        hidden = f".{uuid.uuid4().hex}"

        def finish() -> None:
            if out:
                out.close()
                os.replace(f"{folder}/{hidden}", f"{folder}/part-00000.txt")

        for batch in batches:
            *values, texts = [c.to_pylist() for c in batch.columns]
            for key, group in groupby(zip(zip(*values), texts), itemgetter(0)):
                if key != last:
                    finish()
                    last, folder = key, "/".join([root, *(f"{k}={_folder_value(v)}" for k, v in zip(keys, key))])
                    os.makedirs(folder, exist_ok=True)
                    out, files = open(f"{folder}/{hidden}", "wb"), files + 1
                for _, text in group:
                    out.write(f"{text or ''}\n".encode())
        finish()
        yield pa.record_batch({"files": pa.array([files], pa.int64())})

    return run


def write_cursor(rows: DataFrame, root: str) -> None:
    """Append resume points (brain, cursor_date, cursor_session, run_ts)."""
    rows.write.mode("append").parquet(root)


def read_cursor(spark: SparkSession, root: str) -> DataFrame:
    """Latest resume point per library; no table yet gives no rows."""
    rows = stored(spark, root, CURSOR_SCHEMA)
    return latest_cursor(spark.createDataFrame([], CURSOR_SCHEMA) if rows is None else rows)


def errors(rows: DataFrame, ts: Column | str, stage: str, key: Column, message: Column) -> DataFrame:
    """Failures as rows (ts, stage, key, message, shown); `shown` is the message cut for a report."""
    return rows.select(F.col(ts).alias("ts") if isinstance(ts, str) else ts.alias("ts"), F.lit(stage).alias("stage"),
                       key.cast("string").alias("key"), message.alias("message"), truncate_text(message, ERROR_LIMIT).alias("shown"))


def write_errors(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").parquet(root)
