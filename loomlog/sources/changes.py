"""Changes to several stored tables that take effect together.

A change has a name and a folder of its own below a home. Rows to add are written there, laid out as their
tables are; then one record names the files to move into the tables and the files that go. Writing the
record, a rename, is the commit. Applying it deletes and moves file by file, and every step may be done
again, so after a crash `settle` completes what was committed, and what was not never shows. Files that
a change does not name stay as they are, also those that a stream adds meanwhile.

One writer works on a home at a time, and settles it first; readers who want no half-applied change do
too. The driver handles names of files, never rows. Hidden folders (`_changes`) are left out by Spark's
readers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.sources.sinks import stored

FOLDER = "_changes"
#: Files that are looked up, moved or deleted at the same time.
AT_ONCE = 16


@lru_cache(4)
def _path_class(jvm):
    """Looking a class up by its dotted name costs a call for every part of it."""
    return jvm.org.apache.hadoop.fs.Path


def _path(spark: SparkSession, name: str):
    return _path_class(spark._jvm)(name)


def _fs(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _each(step: Callable, items: Iterable) -> list:
    """`step` of every item, many at a time; the first error is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(step, items))


def _files(spark: SparkSession, folder: str, depth: int) -> list[str]:
    """Data files `depth` partition folders below a folder, listed level by level."""
    fs = _fs(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = fs.listStatus(_path(spark, folder))
    for _ in range(depth):
        found = fs.listStatus(hadoop.FileUtil.stat2Paths(found))
    paths = hadoop.FileUtil.stat2Paths(found)
    names = _each(lambda i: paths[i].toString(), range(len(paths)))
    return [n for n in names if not n.rsplit("/", 1)[-1].startswith(("_", "."))]


def _delete(spark: SparkSession, file: str) -> str:
    """Delete a file; returns its folder."""
    fs, path = _fs(spark, file), _path(spark, file)
    fs.delete(path, False)
    return fs.makeQualified(path.getParent()).toString()


def _clear(spark: SparkSession, folders: set[str], roots: set[str]) -> None:
    """Delete folders that are empty, and those above them that are empty then, up to the tables' roots."""
    def clear(folder: str) -> str | None:
        fs, path = _fs(spark, folder), _path(spark, folder)
        if not fs.exists(path) or not fs.listStatus(path):
            fs.delete(path, False)
            return fs.makeQualified(path.getParent()).toString()
        return None

    above = {fs.makeQualified(_path(spark, r)).toString() for r in roots for fs in [_fs(spark, r)]}
    while folders := folders - above:
        folders = {f for f in _each(clear, sorted(folders)) if f}


def _move(spark: SparkSession, file: str, to: str) -> None:
    """Move a file; done already if it is not there any more."""
    fs, path, target = _fs(spark, file), _path(spark, file), _path(spark, to)
    if not fs.exists(path):
        return
    fs.mkdirs(target.getParent())
    if not fs.rename(path, target):
        raise OSError(f"cannot move {file} to {to}")


def _write(spark: SparkSession, file: str, text: str) -> None:
    fs = _fs(spark, file)
    out = fs.create(_path(spark, file + ".new"), True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(_path(spark, file + ".new"), _path(spark, file)):
        raise OSError(f"cannot write {file}")


def _read(spark: SparkSession, file: str) -> str | None:
    fs = _fs(spark, file)
    if not fs.exists(_path(spark, file)):
        return None
    source = fs.open(_path(spark, file))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


class Change:
    """One change. A name that was used before and never committed starts anew."""

    def __init__(self, spark: SparkSession, home: str, name: str) -> None:
        self.spark, self.folder = spark, f"{home.rstrip('/')}/{FOLDER}/{name}"
        if finished(spark, home, name) or _read(spark, f"{self.folder}/record.json"):
            raise ValueError(f"the change {name} is committed")
        _fs(spark, self.folder).delete(_path(spark, self.folder), True)
        self.roots: list[tuple[str, int]] = []
        self.dropped: list[tuple[str, str]] = []

    def add(self, rows: DataFrame, root: str, by: Sequence[str] = ()) -> None:
        """Rows that come into the table at `root`, which is partitioned by `by`."""
        writer = rows.write.mode("error")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/new/{len(self.roots)}")
        self.roots.append((root.rstrip("/"), len(by)))

    def drop(self, files: Sequence[str], root: str) -> None:
        """Files that leave the table at `root`."""
        self.dropped += [(f, root.rstrip("/")) for f in files]

    def remove(self, root: str, victims: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> None:
        """Take the rows whose `keys` are among `victims` out of a table. Only the files that hold such
        rows are written anew."""
        rows = stored(self.spark, root)
        if rows is None:
            return
        hit = (rows.select(*keys, F.col("_metadata.file_path").alias("_file")).join(victims.select(*keys), list(keys), "left_semi")
               .select("_file").distinct().collect())
        if hit:
            files = [r["_file"] for r in hit]
            held = self.spark.read.schema(rows.schema).option("basePath", root).parquet(*files)
            self.add(held.join(victims.select(*keys), list(keys), "left_anti"), root, by)
            self.drop(files, root)

    def replace(self, root: str, rows: DataFrame, units: DataFrame, by: str) -> None:
        """Put `rows` in place of whatever a table, partitioned by `by`, holds of the partitions in `units`. Only
        names of files and partitions are read of what was there."""
        held = stored(self.spark, root, rows.schema)
        if held is not None:
            old = (held.select(by, F.col("_metadata.file_path").alias("_file")).join(units.select(by), by, "left_semi")
                   .select("_file").distinct().collect())
            self.drop([r["_file"] for r in old], root)
        self.add(rows.hint("rebalance", by), root, [by])

    def empty(self) -> bool:
        return not self.roots and not self.dropped

    def commit(self) -> None:
        """Make the change certain. Until here nothing shows."""
        there = _each(lambda d: _fs(self.spark, d[0]).exists(_path(self.spark, d[0])), self.dropped)
        missing = [f for (f, _), ok in zip(self.dropped, there) if not ok]
        if missing:
            raise RuntimeError(f"another writer took {missing[0]} and {len(missing) - 1} more")
        moves = []
        for i, (root, depth) in enumerate(self.roots):
            base = _fs(self.spark, self.folder).makeQualified(_path(self.spark, f"{self.folder}/new/{i}")).toString()
            moves += [(f, root + f[len(base):]) for f in _files(self.spark, base, depth)]
        _write(self.spark, f"{self.folder}/record.json", json.dumps({"drop": self.dropped, "move": moves}))

    def run(self) -> None:
        """Commit and apply."""
        self.commit()
        _apply(self.spark, self.folder)


def _apply(spark: SparkSession, folder: str) -> None:
    record = json.loads(_read(spark, f"{folder}/record.json"))
    # Added first, so that no folder is taken away and made again.
    _each(lambda m: _move(spark, *m), record["move"])
    folders = set(_each(lambda d: _delete(spark, d[0]), record["drop"]))
    _clear(spark, folders, {root for _, root in record["drop"]})
    _fs(spark, folder).delete(_path(spark, f"{folder}/new"), True)
    _move(spark, f"{folder}/record.json", f"{folder}/done.json")


def finished(spark: SparkSession, home: str, name: str) -> bool:
    """Whether the change of this name has been applied."""
    done = f"{home.rstrip('/')}/{FOLDER}/{name}/done.json"
    return _fs(spark, done).exists(_path(spark, done))


def settle(spark: SparkSession, home: str) -> None:
    """Complete the changes that were committed and not fully applied."""
    folder = f"{home.rstrip('/')}/{FOLDER}"
    fs = _fs(spark, folder)
    if fs.exists(_path(spark, folder)):
        open_ = [p.getPath().toString() for p in fs.listStatus(_path(spark, folder))]
        for one in sorted(f for f in open_ if fs.exists(_path(spark, f"{f}/record.json"))):
            _apply(spark, one)
