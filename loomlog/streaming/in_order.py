"""Streams worked through in the order of event time, each batch committed as a whole.

Rows wait in a stored table until the frontier, the latest time seen less a delay, has passed them; what
has passed is handed to a step in one piece, so the result does not depend on how rows fall into batches. A
step may hold rows back (an unread tail, the last known state of a key); they come again before newer
ones. Output, waiting rows and frontier of a batch are one change (`sources/changes.py`): a batch that is
run again after a failure adds nothing twice and loses nothing. Rows that come after the frontier has
passed their time go to the error table, whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomlog.operators.redaction import redact_table
from loomlog.plans.ordered import previous_value, running_sum
from loomlog.plans.upkeep import migrate_stored, purge_stored
from loomlog.session import saved
from loomlog.sources.changes import Change, finished, settle
from loomlog.sources.readers import parse_hook_events
from loomlog.sources.sinks import errors, stored

#: Microseconds of one chunk of a session's rows.
CHUNK = 3_600_000_000
EVER = (1 << 62)

Step = Callable[[Change, DataFrame], DataFrame]


@dataclass
class InOrder:
    """`step(change, rows)` gets the rows of a batch that have passed, adds its output to the change and
    returns the rows it holds back. Rows have a column `at` (microseconds) and the others of `schema`;
    `key` names one of them for error rows."""

    home: str
    name: str
    schema: str
    key: str
    delay: int
    step: Step

    def _root(self, kind: str) -> str:
        return f"{self.home}/{self.name}-{kind}"

    def frontier(self, spark: SparkSession) -> int:
        rows = stored(spark, self._root("frontier"), "at long")
        top = rows.agg(F.max("at")).first()[0] if rows is not None else None
        return -EVER if top is None else top

    def work(self, spark: SparkSession, batch: DataFrame | None, unit: str) -> None:
        """Take in a batch; None lets pass all that waits."""
        settle(spark, self.home)
        if finished(spark, self.home, unit):
            return
        schema = StructType.fromDDL(self.schema)
        empty = spark.createDataFrame([], schema)
        new = empty if batch is None else saved(batch.select(*schema.fieldNames()), f"{self.name}-batch")
        before = self.frontier(spark)
        top = new.agg(F.max("at")).first()[0]
        now = EVER if batch is None else max(before, before if top is None else top - self.delay)
        change = Change(spark, self.home, unit)

        late = new.filter(F.col("at") <= before)
        told = errors(late, F.timestamp_micros("at"), f"{self.name}: late", F.col(self.key), F.to_json(F.struct(*schema.fieldNames())))
        if not late.isEmpty():
            change.add(told, f"{self.home}/errors")
        held = stored(spark, self._root("waiting"), schema)
        rows = saved((empty if held is None else held).unionByName(new.filter(F.col("at") > before)), f"{self.name}-work")
        kept = self.step(change, rows.filter(F.col("at") <= now))
        change.add(rows.filter(F.col("at") > now).unionByName(kept.select(*schema.fieldNames())), self._root("waiting"))
        change.add(spark.createDataFrame([(before if batch is None else now,)], "at long").coalesce(1), self._root("frontier"))
        for kind in ("waiting", "frontier"):
            change.drop(files(spark, self._root(kind)), self._root(kind))
        change.run()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Work through what a stream has now; a later run with the same checkpoint goes on."""
        mark = f"{self.name}-{zlib.crc32(checkpoint.encode()):08x}"

        def add(batch: DataFrame, batch_id: int) -> None:
            self.work(batch.sparkSession, batch, f"{mark}-{batch_id}")

        stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def finish(self, spark: SparkSession, unit: str = "finish") -> None:
        """Let pass what still waits for the frontier."""
        self.work(spark, None, f"{self.name}-{unit}")


def files(spark: SparkSession, root: str) -> list[str]:
    """Data files of a stored table."""
    rows = stored(spark, root)
    return [] if rows is None else list(rows.inputFiles())


# ---- stops: the turn that each one closes ----

TURN_SCHEMA = "session_id string, at long, rank int, pos long, kind string, text string, store string, scope string"


def turn_rows(turns: DataFrame) -> DataFrame:
    """What of a transcript concerns turns: real user messages open one, assistant texts are said.

    turns: session_id, line_no, ts, entry_type, is_sidechain, is_real_user, text.
    """
    kind = (F.when((F.col("entry_type") == "user") & F.col("is_real_user"), "open")
            .when((F.col("entry_type") == "assistant") & (F.coalesce("text", F.lit("")) != ""), "said"))
    none = F.lit(None).cast("string")
    return (turns.filter(~F.coalesce("is_sidechain", F.lit(False))).withColumn("kind", kind).filter("kind is not null")
            .select("session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(0).alias("rank"), F.col("line_no").cast("long").alias("pos"),
                    "kind", F.when(F.col("kind") == "said", F.col("text")).alias("text"), none.alias("store"), none.alias("scope")))


def stop_rows(events: DataFrame, config) -> DataFrame:
    """Stop events, routed, behind the lines of the same time."""
    stops = config.route(events).filter("mode = 'stop'")
    return stops.select("session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("rank"), F.col("event_id").cast("long").alias("pos"),
                        F.lit("stop").alias("kind"), F.lit(None).cast("string").alias("text"), "store", "scope")


def stopped_turns(home: str, delay: int, chunk: int = CHUNK) -> InOrder:
    """Log of what was said in the turn that each stop closes, as rows (session_id, event_id, line_no, scope,
    text, store, log_date) below `home`/turns, redacted.

    Every line said belongs to the first stop or real user message behind it. A stop writes its lines,
    and nothing if the session opted out; lines that a user message cuts off are not written; lines with
    nothing behind them yet are the unread tail and are held back. A second stop in a turn so writes what
    was said since the first. One running sum over the session numbers the pieces, chunk by chunk.
    """
    def step(change: Change, rows: DataFrame) -> DataFrame:
        ends = F.col("kind").isin("open", "stop")
        numbered = saved(running_sum(rows, ["session_id"], ["at", "rank", "pos"], ends.cast("int"), "_piece", F.floor(F.col("at") / chunk)), "pieces")
        closing = numbered.filter(ends).select("session_id", (F.col("_piece") - 1).alias("_piece"), F.struct(
            F.col("kind").alias("kind"), F.col("pos").alias("event_id"), F.col("at").alias("at"), F.col("store").alias("store"), F.col("scope").alias("scope")).alias("_end"))
        said = numbered.filter(F.col("kind") == "said").join(closing, ["session_id", "_piece"], "left")
        out = (said.filter("_end.kind = 'stop' and _end.scope <> 'nolog'")
               .select("session_id", "_end.event_id", F.col("pos").alias("line_no"), "_end.scope", "text", "_end.store",
                       F.to_date(F.timestamp_micros("_end.at")).alias("log_date")))
        change.add(redact_table(out, ["text"]), f"{home}/turns", ["store", "log_date"])
        return said.filter("_end is null")

    return InOrder(home, "stops", TURN_SCHEMA, "session_id", delay, step)


# ---- scopes: changes and what follows from them ----

SCOPE_SCHEMA = "session_id string, at long, event_id long, scope string, store string, known boolean"


def scope_rows(events: DataFrame, config) -> DataFrame:
    return config.route(events).select("session_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"), "scope",
                                       "store", F.lit(False).alias("known"))


def scope_history(home: str, delay: int, chunk: int = CHUNK) -> InOrder:
    """Scope changes below `home`/changes (session_id, event_id, at, was, scope, store, action): a change out
    of `unset` asks for a move, one to `nolog` for a purge. The last row of each session is held back."""
    def step(change: Change, rows: DataFrame) -> DataFrame:
        before = previous_value(rows, ["session_id"], ["at", "event_id"], "scope", "was", F.floor(F.col("at") / chunk))
        action = (F.when((F.col("scope") == "nolog") & (F.col("was") != "nolog"), "purge")
                  .when((F.col("was") == "unset") & ~F.col("scope").isin("unset", "nolog"), "migrate"))
        out = before.filter(~F.col("known")).withColumn("action", action).filter("action is not null")
        change.add(out.select("session_id", "event_id", "at", "was", "scope", "store", "action"), f"{home}/changes")
        last = rows.groupBy("session_id").agg(F.max_by(F.struct("at", "event_id", "scope", "store"), F.struct("at", "event_id")).alias("_l"))
        return last.select("session_id", "_l.*", F.lit(True).alias("known"))

    return InOrder(home, "scopes", SCOPE_SCHEMA, "session_id", delay, step)


def apply_scopes(spark: SparkSession, home: str, logs: str, staged: str, name: str) -> tuple[bool, bool]:
    """Bring stored logs in line with the scopes that are known by now: rows of sessions that ever opted out
    go from the stores and staging, staged rows of the others move to the store of their last change. Run
    once at the end or after every batch, it leaves the same tables."""
    settle(spark, home)
    changes = stored(spark, f"{home}/changes")
    if changes is None:
        return False, False
    now = saved(changes.groupBy("session_id").agg(F.max_by(F.struct("scope", "store"), F.struct("at", "event_id")).alias("_n"),
                                                  F.bool_or(F.col("action") == "purge").alias("_gone"))
                .select("session_id", F.when(F.col("_gone"), "nolog").otherwise(F.col("_n.scope")).alias("scope"), "_n.store"), "scopes-now")
    gone = purge_stored(spark, home, now, {logs: ["store", "log_date"], staged: ["log_date"]}, f"{name}-purge")
    return gone, migrate_stored(spark, home, now, [(staged, logs)], f"{name}-move")


# ---- payloads: good ones to the log, bad ones to the error table ----

def log_payloads(lines: DataFrame, config, home: str, checkpoint: str) -> None:
    """Prompts of a stream of payload lines (value, and the time `ts` they came) to `home`/prompts, routed and
    redacted, and every line that is no payload, whole, to `home`/errors. `home`/batches counts both."""
    mark = f"payloads-{zlib.crc32(checkpoint.encode()):08x}"

    def add(batch: DataFrame, batch_id: int) -> None:
        spark, unit = batch.sparkSession, f"{mark}-{batch_id}"
        settle(spark, home)
        if finished(spark, home, unit):
            return
        rows = saved(batch.select("ts", "value", F.xxhash64("value").alias("line")), "payloads")
        change = Change(spark, home, unit)
        sound = F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull()
        events = parse_hook_events(rows)
        prompts = config.route(events.withColumn("raw_title", F.lit(None).cast("string"))).filter("scope <> 'nolog' and mode = 'prompt'")
        change.add(redact_table(prompts.select("session_id", "prompt", "scope", "store"), ["prompt"]), f"{home}/prompts", ["store"])
        change.add(errors(rows.filter(~sound), "ts", "payload", F.hex("line"), F.col("value")), f"{home}/errors")
        counts = rows.agg(F.lit(batch_id).cast("long").alias("batch"), F.count(F.lit(1)).alias("n_lines"), F.count_if(~sound).alias("n_bad"))
        change.add(counts, f"{home}/batches")
        change.run()

    lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
