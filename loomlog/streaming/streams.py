"""Streams of hook events and log tables."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomlog.operators.redaction import redact_table
from loomlog.session import ROCKSDB, fresh_folder
from loomlog.sources.sinks import stored

# Tasks get the classes of this module by value, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 1 << 30


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table or file as a stream with the schema it has. The last character is given
    as a pattern, because Spark streams a single file only through one. A trigger takes at
    most `BATCH_BYTES`, also when a long backlog is run at once."""
    path = path.rstrip("/")
    return (spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", BATCH_BYTES)
            .parquet(f"{path[:-1]}[{path[-1]}]"))


def run_once(df: DataFrame, spark: SparkSession, name: str, by: Sequence[str] = ()) -> str:
    """Run a stream over what is there now into a new parquet folder; returns the folder. The
    file sink commits each batch once, also when a batch is run again."""
    folder = fresh_folder(spark, name)
    writer = (df.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", fresh_folder(spark, f"{name}-state")).trigger(availableNow=True))
    if by:
        writer = writer.partitionBy(*by)
    writer.start(folder).awaitTermination()
    return folder


def log_turns(events: DataFrame, config) -> DataFrame:
    """What prompts write: routed and redacted rows; opted-out sessions write nothing.
    Stateless."""
    routed = config.route(events).filter("scope <> 'nolog' and mode = 'prompt'").withColumn("log_date", F.to_date("ts"))
    return redact_table(routed, ["prompt"])


def first_events(events: DataFrame) -> DataFrame:
    """First event of each session, exactly once for ever; state holds one id per session."""
    return events.dropDuplicates(["session_id"])


def first_events_within(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """The same with bounded state: a session silent for longer may be marked again."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id"])


def closed_days(events: DataFrame) -> DataFrame:
    """Events per store and day, sent out once the day can take no more (a day late)."""
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "store")
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select("store", F.to_date("window.start").alias("log_date"), "n_events"))


class ScopeChange(StatefulProcessor):
    """Keeps a session's scope; a change out of `unset` asks for a migration, one to `nolog`
    for a purge.

    State is one scope per session and when it was seen; with `ttl_ms` a session that is silent
    for longer is forgotten (for streams that stay up: a run of what is there now would wait for
    its timers). Rows older than what is known are late and change nothing. The
    rows of a session within one trigger are put in time order, so they are held at once: three
    narrow columns of at most `BATCH_BYTES` of events.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._scope = handle.getValueState("scope", "scope string, ts long, event_id long", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._scope.get() if self._scope.exists() else None
        before, last_ts, last_id = known if known else (None, None, None)
        parts = [[r[c].to_numpy() for c in ("ts", "event_id", "scope")] for r in rows]
        ts, ids, scopes = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((ids, ts))
        ts, ids, scopes = ts[order].astype("datetime64[us]").astype(np.int64), ids[order], scopes[order].astype(object)
        if known:
            new = (ts > last_ts) | ((ts == last_ts) & (ids > last_id))
            ts, ids, scopes = ts[new], ids[new], scopes[new]
        if not len(ids):
            return
        was = np.concatenate((np.array([before], dtype=object), scopes[:-1]))
        purge = (scopes == "nolog") & (was != "nolog") & np.not_equal(was, None)
        migrate = (was == "unset") & (scopes != "unset") & (scopes != "nolog")
        self._scope.update((scopes[-1], int(ts[-1]), int(ids[-1])))
        hit = purge | migrate
        if hit.any():
            yield pd.DataFrame({"session_id": key[0], "event_id": ids[hit], "was": was[hit], "scope": scopes[hit],
                                "action": np.where(purge[hit], "purge", "migrate")})

    def close(self) -> None:
        pass


CHANGE_SCHEMA = "session_id string, event_id long, was string, scope string, action string"


def scope_changes(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Scope changes per session from routed events (session_id, event_id, ts, scope)."""
    return (events.select("session_id", "event_id", "ts", "scope").groupBy("session_id")
            .transformWithStateInPandas(ScopeChange(ttl_ms), CHANGE_SCHEMA, "append", "processingTime" if ttl_ms else "none"))


def reclassified(spark: SparkSession, events: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """Run `scope_changes` over what is there now. A session of its own holds the state store
    setting, so the caller's stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    # Every partition keeps a state store open; more of them than cores only cost time.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(parts))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    folder = run_once(scope_changes(events(own)), own, "scope-changes")
    return spark.read.schema(CHANGE_SCHEMA).parquet(folder)


def compile_new_sessions(spark: SparkSession, source: str, done: str, state: str | None = None) -> None:
    """Add logs of `source` (store, log_date, session_id, ..) that `done`, partitioned by store
    and day, does not hold yet.

    Without `state` every run reads the source anew, and the anti-join alone keeps it
    idempotent; with it a run reads only what came since. A batch that is run again after a
    failure adds nothing twice either.
    """
    keys = ["store", "log_date", "session_id"]

    def add(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        held = stored(own, done, batch.schema)
        if held is not None:
            # Only the partitions of the batch's days are read.
            days = fresh.select("store", "log_date").distinct()
            fresh = fresh.join(held.select(*keys).join(days, ["store", "log_date"], "left_semi"), keys, "left_anti")
        fresh.write.mode("append").partitionBy("store", "log_date").parquet(done)

    (stream_table(spark, source).writeStream.foreachBatch(add)
     .option("checkpointLocation", state or fresh_folder(spark, "compile-state"))
     .trigger(availableNow=True).start().awaitTermination())

