"""Daily copies of transcripts, with what they share stored once.

A copy is cut into pieces by its content: a line whose hash ends in six zero bits ends a piece, and so
does every 4,096th line, so a copy that has grown since has the same pieces but for its last one. Pieces
are stored under (session, digest); a manifest lists the pieces of each copy. Ten daily copies of a session cost its
lines once, and the last piece of each day.

Positions are running counts over chunks of line numbers, so a session of any size is cut by many tasks; a
piece holds 4,096 lines at most. Both tables change together (`sources/changes.py`): writing the same copies again
adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.plans.ordered import CHUNK_WIDTH, running_sum
from loomlog.session import saved
from loomlog.sources.changes import Change, finished, settle
from loomlog.sources.sinks import stored

#: A piece ends at a line whose hash is a multiple of this, or at this many lines.
EVERY, MOST = 64, 4096

COPY = ["session_id", "store", "log_date"]
PIECES = "session_id string, store string, log_date date, piece long, first long, n_lines long, digest string"
LINES = "session_id string, digest string, pos long, line string"


def cut(lines: DataFrame, chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """Adds position (from 1, dense) and piece (from 0) to the lines of copies (session_id, store, log_date, line_no,
    line)."""
    chunk = F.floor(F.col("line_no") / chunk_width)
    placed = running_sum(lines.select(*COPY, "line_no", "line"), COPY, ["line_no"], F.lit(1), "position", chunk)
    ends = (F.pmod(F.xxhash64("line"), F.lit(EVERY)) == 0) | (F.col("position") % MOST == 0)
    numbered = running_sum(placed, COPY, ["line_no"], ends.cast("int"), "_ended", chunk)
    return numbered.select(*COPY, "line_no", "line", "position", (F.col("_ended") - ends.cast("int")).alias("piece"))


def pieces_of(numbered: DataFrame) -> DataFrame:
    """One row per piece, see `PIECES`; the digest is over the digests of its lines in order."""
    listed = F.array_sort(F.collect_list(F.struct("position", F.sha2(F.col("line").cast("binary"), 256).alias("sha"))))
    return (numbered.groupBy(*COPY, "piece").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n_lines"),
                                                 F.sha2(F.array_join(F.transform(listed, lambda r: r["sha"]), "\n"), 256).alias("digest"))
            .select(*COPY, "piece", "first", "n_lines", "digest"))


def write_copies(lines: DataFrame, home: str, name: str, chunk_width: int = CHUNK_WIDTH) -> bool:
    """Store copies below `home` (`pieces` by store and day, `lines`); copies that are there already, by session, store and day,
    are left as they are. False if the change of this name was made before."""
    spark = lines.sparkSession
    settle(spark, home)
    if finished(spark, home, name):
        return False
    numbered = saved(cut(lines, chunk_width), "copy-lines")
    pieces = saved(pieces_of(numbered), "copy-pieces")
    held = stored(spark, f"{home}/pieces", PIECES)
    if held is not None:
        days = pieces.select("store", "log_date").distinct()
        pieces = pieces.join(held.select(*COPY).join(days, ["store", "log_date"], "left_semi"), COPY, "left_anti")
    # Of the copies that share a new piece, one gives its lines.
    new = pieces.groupBy("session_id", "digest").agg(F.min(F.struct("store", "log_date", "piece", "first")).alias("_p"))
    known = stored(spark, f"{home}/lines", LINES)
    if known is not None:
        new = new.join(known.select("session_id", "digest"), ["session_id", "digest"], "left_anti")
    new = saved(new.select("session_id", "digest", "_p.*"), "new-pieces")
    given = numbered.join(new, [*COPY, "piece"]).select("session_id", "digest", (F.col("position") - F.col("first")).alias("pos"), "line")
    change = Change(spark, home, name)
    change.add(pieces, f"{home}/pieces", ["store", "log_date"])
    change.add(given, f"{home}/lines")
    change.run()
    return True


def read_copies(spark: SparkSession, home: str) -> DataFrame:
    """(session_id, store, log_date, position, line) of all copies."""
    settle(spark, home)
    pieces = spark.read.schema(PIECES).parquet(f"{home}/pieces")
    lines = spark.read.schema(LINES).parquet(f"{home}/lines")
    return (pieces.join(lines, ["session_id", "digest"])
            .select(*COPY, (F.col("first") + F.col("pos")).alias("position"), "line"))
