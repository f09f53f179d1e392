"""Projection of flagged articles into the shared store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.plans.ordered import first_per_key

# Sources in copy order; the one copied last wins a shared path.
PRECEDENCE = ("work", "both")


def union_sources(catalog: DataFrame) -> DataFrame:
    """Flagged articles of the work and both libraries, one per relative path. `digest` is made
    before the choice, so a comparison does not move the texts."""
    rank = F.array_position(F.array(*[F.lit(b) for b in reversed(PRECEDENCE)]), F.col("brain"))
    picked = catalog.filter(F.col("share") & F.col("brain").isin(*PRECEDENCE))
    picked = picked.withColumn("_rank", rank).withColumn("digest", F.md5("content"))
    return first_per_key(picked, ["rel"], ["_rank"]).drop("_rank")


def promote_diff(flagged: DataFrame, shared: DataFrame, contributor: str | None = None) -> DataFrame:
    """One row per path: copy, same or delete, by content hash (rel, action).

    flagged: rel, digest (see `union_sources`); shared: rel, content (and contributor, where several people
    share a store: then only a contributor's own rows are deleted, others' show as keep). A
    contributor needs a store that tells its rows' contributors.
    """
    if contributor is not None and "contributor" not in shared.columns:
        raise ValueError("the shared store has no contributor column")
    left = flagged.select("rel", F.col("digest").alias("_new"))
    owner: Column = F.col("contributor") if "contributor" in shared.columns else F.lit(contributor).cast("string")
    right = shared.select("rel", F.md5("content").alias("_old"), owner.alias("_owner"))
    gone = F.when(F.lit(contributor).isNull() | F.col("_owner").eqNullSafe(F.lit(contributor)), "delete").otherwise("keep")
    action = (F.when(F.col("_new").isNull(), gone).when(F.col("_new").eqNullSafe(F.col("_old")), "same")
              .otherwise("copy"))
    return left.join(right, "rel", "full_outer").select("rel", action.alias("action"))


def shared_minus_flagged(shared: DataFrame, flagged: DataFrame) -> DataFrame:
    """Paths of the shared store that nobody flags any more."""
    return shared.select("rel").join(flagged.select("rel"), "rel", "left_anti")


def promote_counts(diff: DataFrame) -> DataFrame:
    """One row: paths shared, paths removed, and the summary line."""
    done = diff.agg(F.count_if(F.col("action").isin("copy", "same")).alias("n_share"),
                    F.count_if(F.col("action") == "delete").alias("n_remove"))
    return done.withColumn("line", F.format_string("promote: %d added/updated, %d removed", "n_share", "n_remove"))


def apply_promotion(flagged: DataFrame, shared: DataFrame, contributor: str | None = None) -> DataFrame:
    """Shared store after the sync (rel, content[, contributor]); who copies a path owns it."""
    diff = promote_diff(flagged, shared, contributor)
    columns = ["rel", "content", *(["contributor"] if "contributor" in shared.columns else [])]
    kept = shared.select(*columns).join(diff.filter(F.col("action").isin("same", "keep")).select("rel"), "rel", "left_semi")
    new = flagged.withColumn("contributor", F.lit(contributor).cast("string")).select(*columns).join(diff.filter(F.col("action") == "copy").select("rel"), "rel", "left_semi")
    return kept.unionByName(new)
