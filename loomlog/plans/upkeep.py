"""Jobs that rewrite stored tables: opt-out purge, moves out of staging, and whole compile runs.

Each is one change over all tables concerned (`sources/changes.py`): it shows as a whole, and running it
again, also after a crash at any step, ends in the same tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions.arrays import explode_rows
from loomlog.functions.front_matter import front_matter, list_field
from loomlog.operators.routing import migrate_unclassified, nolog_sessions
from loomlog.session import saved
from loomlog.sources.changes import Change, finished, settle
from loomlog.sources.sinks import stored

LOG_PARTS = ("store", "log_date")


def versions_from(versions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Keys of the article versions that name one of the sessions as a source."""
    keys = ["brain", "path", "run_id", "seq"]
    named = explode_rows(versions, keys, list_field(front_matter(F.col("content")), "sources"), "session_id")
    return named.join(sessions.select("session_id"), "session_id", "left_semi").select(*keys).distinct()


def purge_stored(spark: SparkSession, home: str, sessions: DataFrame, tables: Mapping[str, Sequence[str]], name: str,
                 versions: str | None = None) -> bool:
    """Take every row of sessions that opted out from stored tables; False if there was none.

    `tables`: root to partition columns, of logs, staged logs, snapshots and marks alike (session_id, ..).
    `versions`: root of the article versions, partitioned by brain; those that name such a session as a source go, so
    the article falls back to the version before. Only files with such rows are rewritten.
    """
    settle(spark, home)
    gone = saved(nolog_sessions(sessions), "nolog")
    change = Change(spark, home, name)
    for root, by in tables.items():
        change.remove(root, gone, ["session_id"], by)
    held = stored(spark, versions) if versions else None
    if held is not None:
        change.remove(versions, saved(versions_from(held, gone), "versions-gone"), ["brain", "path", "run_id", "seq"], ["brain"])
    if change.empty():
        return False
    change.run()
    return True


def migrate_stored(spark: SparkSession, home: str, sessions: DataFrame, tables: Sequence[tuple[str, str]], name: str) -> bool:
    """Move staged rows of sessions that have a scope by now into their stores; False if none moved.

    `tables`: (root of the staged table, partitioned by log_date; root of the stores' table, by store and
    log_date), of logs, snapshots and the like. The rows of a session and day move together, and stay
    staged where the store has that session and day already. Sessions that opted out are left to the purge.
    """
    settle(spark, home)
    change = Change(spark, home, name)
    known = sessions.select("session_id", "scope", "store").dropDuplicates(["session_id"])
    for staged_root, root in tables:
        staged = stored(spark, staged_root)
        if staged is None:
            continue
        keys = staged.select("session_id", "log_date").distinct()
        there = stored(spark, root)
        taken = (keys.select("*", F.lit(None).cast("string").alias("store")).limit(0) if there is None
                 else there.select("session_id", "log_date", F.col("store").cast("string").alias("store")).distinct())
        moved = saved(migrate_unclassified(keys, known, taken).filter("state = 'moved'").select("session_id", "log_date", "store"), "moved")
        if moved.isEmpty():
            continue
        change.add(staged.join(moved, ["session_id", "log_date"]), root, LOG_PARTS)
        change.remove(staged_root, moved, ["session_id", "log_date"], ["log_date"])
    if change.empty():
        return False
    change.run()
    return True


def commit_run(spark: SparkSession, home: str, run: str, parts: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> bool:
    """Add what one compile run made to several tables (root to rows and partition columns): versions,
    changelog rows, errors and the resume point. Readers see all of it or, until the commit, nothing; a
    run that was committed before is only completed, and False is returned."""
    settle(spark, home)
    if finished(spark, home, run):
        return False
    change = Change(spark, home, run)
    for root, (rows, by) in parts.items():
        change.add(rows, root, by)
    change.run()
    return True
