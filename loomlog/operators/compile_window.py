"""Which closed sessions a run compiles, and where the next one resumes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.plans.ordered import latest_per_key


@dataclass(frozen=True)
class Cursor:
    """Resume point: a whole date is done, or a date up to and including one log file."""

    day: date
    session_file: str | None = None

    @property
    def start(self) -> date:
        return self.day if self.session_file else self.day + timedelta(days=1)

    @property
    def key(self) -> tuple[str, str]:
        name = (self.session_file or "").removesuffix(".md")
        head, _, _ = name.partition("_")
        return head, name.rpartition("_")[2]


def parse_cursor(text: str) -> Cursor:
    """Cursor file text: a date line, then an optional log file name."""
    lines = [s.strip() for s in text.splitlines() if s.strip()]
    return Cursor(date.fromisoformat(lines[0]), lines[1] if len(lines) > 1 else None)


def latest_cursor(cursors: DataFrame) -> DataFrame:
    return latest_per_key(cursors, ["brain"], ["run_ts"])


def cursor_map(cursors: DataFrame) -> dict[str, Cursor]:
    """Resume points on the driver: one row per configured library."""
    return {r["brain"]: Cursor(r["cursor_date"], r["cursor_session"]) for r in cursors.collect()}


def pending_sessions(logs: DataFrame, cursors: Mapping[str, Cursor], today: date, day: date | None = None) -> DataFrame:
    """Logs (brain, log_date, hhmmss, session_id, ..) to compile: after the cursor, before today.

    The bounds are literals, so they prune `brain` and `log_date` partitions. On the
    cursor's own date only logs after its session are left; comparing time key and id, not
    names, survives a title change. `day` picks one date and sets the resume point aside. A
    library without a cursor starts at its first day.
    """
    fresh = ~F.col("brain").isin(*cursors) if cursors else F.lit(True)
    parts = [fresh & ((F.col("log_date") == F.lit(day)) if day is not None else (F.col("log_date") < F.lit(today)))]
    for brain, cursor in cursors.items():
        mine = F.col("brain") == brain
        if day is not None:
            parts.append(mine & (F.col("log_date") == F.lit(day)))
            continue
        later = mine & (F.col("log_date") >= F.lit(cursor.start)) & (F.col("log_date") < F.lit(today))
        if cursor.session_file:
            hhmmss, session = cursor.key
            later &= ((F.col("log_date") > F.lit(cursor.day)) | (F.col("hhmmss") > hhmmss)
                      | ((F.col("hhmmss") == hhmmss) & (F.col("session_id") > session)))
        parts.append(later)
    return logs.filter(reduce(lambda a, b: a | b, parts, F.lit(False)))


def closed_day_cutoff(logs: DataFrame, today: date) -> DataFrame:
    """Days before today are closed: nothing is added to them any more."""
    return logs.filter(F.col("log_date") < F.lit(today))


def calendar_gaps(pending: DataFrame, cursors: Mapping[str, Cursor], today: date) -> DataFrame:
    """(brain, log_date) in range without a pending session: the cursor just passes them."""
    spark = pending.sparkSession
    ranges = [(b, c.start, today - timedelta(days=1)) for b, c in cursors.items() if c.start < today]
    days = (spark.createDataFrame(ranges, "brain string, lo date, hi date")
            .select("brain", F.explode(F.sequence("lo", "hi")).alias("log_date")))
    return days.join(pending.select("brain", "log_date").distinct(), ["brain", "log_date"], "left_anti")


def advance_cursor(done: DataFrame, run_ts: str) -> DataFrame:
    """New resume point per library after its compiled sessions (brain, log_date, hhmmss,
    session_id, file_name)."""
    last = latest_per_key(done, ["brain"], ["log_date", "hhmmss", "session_id"])
    return last.select("brain", F.col("log_date").alias("cursor_date"), F.col("file_name").alias("cursor_session"),
                       F.lit(run_ts).cast("timestamp").alias("run_ts"))
