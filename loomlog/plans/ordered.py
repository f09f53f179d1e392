"""Running values over groups that may be too large for one task.

A plain window function sends a whole group to one task. Here a group is cut into chunks
that follow the order. Chunks are summarised first (partial aggregation, one small row per
chunk), the window runs over those summaries, and the rows are then finished chunk by
chunk. Both the join and the last window are keyed by (group, chunk), so the rows are
shuffled once and a hot group is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import saved

CHUNK_WIDTH = 100_000


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                chunk: Column | None = None) -> DataFrame:
    """Inclusive running sum of `value` per group.

    `order` names the sort columns; `chunk` must not decrease along that order and holds a
    bounded number of rows per value. By default it is cut from the first, numeric column.
    """
    if chunk is None:
        chunk = F.floor(F.col(order[0]) / CHUNK_WIDTH)
    rows = df.withColumn("_chunk", chunk.cast("bigint")).withColumn("_value", value.cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
               .select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    inside = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.join(offsets, [*keys, "_chunk"])
            .withColumn(out, F.col("_before") + F.sum("_value").over(inside))
            .drop("_chunk", "_value", "_before"))


def range_chunks(df: DataFrame, order: Sequence[str], out: str = "_range") -> DataFrame:
    """Rows dealt out by ranges of their order, of about equal numbers of rows, the range's number in
    `out`: a chunk column for orders that are no numbers. Written once, so that every use sees the same ranges."""
    return saved(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id().cast("bigint")), "ranges")


def join_group_value(rows: DataFrame, values: DataFrame, keys: Sequence[str], chunk: Column,
                     how: str = "inner") -> DataFrame:
    """Join one row per group onto the rows of groups of any size. `values` is first copied to
    the chunks each group has, then joined by (group, chunk)."""
    rows = rows.withColumn("_chunk", chunk.cast("bigint"))
    spread = rows.select(*keys, "_chunk").distinct().join(values, list(keys), how)
    return rows.join(spread, [*keys, "_chunk"], how).drop("_chunk")


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str,
                   chunk: Column | None = None, initial: DataFrame | None = None) -> DataFrame:
    """`value` of the row before in the group; on the first row that of `initial` (keys..,
    value), else NULL. `value` is not NULL."""
    if chunk is None:
        chunk = F.floor(F.col(order[0]) / CHUNK_WIDTH)
    rows = df.withColumn("_chunk", chunk.cast("bigint"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    carried = (rows.groupBy(*keys, "_chunk")
               .agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
               .select(*keys, "_chunk", F.lag("_last").over(by_chunk).alias("_carried")))
    if initial is not None:
        start = initial.select(*keys, F.struct(F.col(value).alias("v")).alias("_start"))
        carried = (carried.join(start, list(keys), "left")
                   .select(*keys, "_chunk", F.coalesce("_carried", "_start").alias("_carried")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (rows.join(carried, [*keys, "_chunk"])
            .withColumn(out, F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(inside),
                                        F.col("_carried"))["v"])
            .drop("_chunk", "_carried"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key along `order`. Spark keeps one row per key and map task before the
    shuffle (window group limit), so a hot key moves no more rows than there are tasks."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key along `order`; same partial step as `latest_per_key`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
