"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keys: list[str], array: Column | str, out: str, pos: str | None = None) -> DataFrame:
    """One row per array member (keys.., [pos,] out); NULL and empty arrays give none.

    A plain explode makes Spark add a filter on the array below it, and with it a second
    copy of whatever builds the array. The outer form does not.
    """
    kept = pos or "_pos"
    rows = df.select(*keys, F.posexplode_outer(array).alias(kept, out)).filter(F.col(kept).isNotNull())
    return rows if pos else rows.drop(kept)


def keep_computed(df: DataFrame, condition: Column, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that pass a test on costly computed columns (keys.., values..). A filter would be
    pushed below their computation and repeat it; here each is computed once."""
    kept = F.when(condition, F.array(F.struct(*values)))
    return explode_rows(df, keys, kept, "_kept").select(*keys, *[F.col(f"_kept.{v}") for v in values])
