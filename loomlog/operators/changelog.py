"""Changelog lines and run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.arrays import explode_rows
from loomlog.functions.front_matter import display_path
from loomlog.operators.library import LINK_MARK as DASH
from loomlog.operators.edits import RUNS_PER_CHUNK
from loomlog.plans.ordered import running_sum
from loomlog.session import saved

# Fixed texts of the output format: this head, and the lines below.
HEAD = "# Library changelog\n\n_Machine-maintained. One section per compile date._\n"
COUNTED = ["create", "update", "rewrite", "delete", "skip"]


def changelog_order(entries: DataFrame) -> DataFrame:
    """Ordinal of each entry within its day; run ids grow with time."""
    return running_sum(entries, ["brain", "section_date"], ["run_id", "seq"], F.lit(1), "ordinal",
                       F.floor(F.col("run_id") / RUNS_PER_CHUNK))


def changelog(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Changelog documents as lines (brain, section_date, run_id, rank, seq, line).

    entries: brain, kind, run_id, seq, action, path, note (see `applied_log`);
    runs: brain, kind, section_date, run_id, hm, summary, one row per run. Sorted by
    `changelog_sort()` the lines of a library are its document: a head without a date, then
    one section per date, newest first. Synthesis lists edits, skips, the summary, then that nothing ran; a
    review without edits is one line with its first skip reason.
    """
    keys = ["brain", "section_date", "run_id"]
    skip = F.col("action") == "skip"
    log = saved(entries.select("brain", "run_id", "seq", "action", "path", "note"), "changelog-entries")
    state = (log.groupBy("brain", "run_id")
             .agg(F.count(F.lit(1)).alias("n"), F.count_if(~skip).alias("n_edits"), F.min(F.when(skip, F.struct("seq", "note"))).alias("first")))
    run = saved(runs.join(state, ["brain", "run_id"], "left").fillna(0, ["n", "n_edits"]), "changelog-runs")

    compiling = F.col("kind") == "compile"
    tick = F.concat(F.lit("- `"), F.col("hm"), F.lit(f"` {DASH} "))
    verb = F.when(compiling, F.col("action")).otherwise(F.concat(F.lit("supervisor "), F.col("action")))
    edit_line = F.concat(tick, F.lit("**"), verb, F.lit("** `"), display_path(F.col("path")), F.lit("`"))
    skip_line = F.concat(tick, F.lit("_skip_: "), F.col("note"))
    items = (log.join(run.select(*keys, "kind", "hm"), ["brain", "run_id"]).filter(compiling | ~skip)
             .select(*keys, F.when(skip, 2).otherwise(1).alias("rank"), F.col("seq").cast("bigint").alias("seq"),
                     F.when(skip, skip_line).otherwise(edit_line).alias("line")))

    def line(rank: int, when: Column, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(rank).alias("rank"), text.alias("line")))

    passed = line(1, ~compiling & (F.col("n_edits") == 0),
                  F.concat(tick, F.lit("_supervisor pass_: "), F.coalesce(F.col("first.note"), F.lit("coherent"))))
    told = line(3, (F.coalesce("summary", F.lit("")) != "") & (compiling | (F.col("n_edits") > 0)),
                F.concat(F.when(compiling, "  - session summary: ").otherwise("  - supervisor summary: "), F.col("summary")))
    idle = line(4, compiling & (F.col("n") == 0), F.concat(tick, F.lit("_no sessions in range; compile ran no-op._")))
    own = explode_rows(run, keys, F.array_compact(F.array(passed, told, idle)), "_l").select(*keys, "_l.rank", F.lit(0).cast("bigint").alias("seq"), "_l.line")

    # Head of each library, and the frame of each of its days.
    day = F.concat(F.lit("## "), F.date_format("section_date", "yyyy-MM-dd"), F.lit("\n"))

    def outer(run_id: Column, rank: int, text: Column) -> Column:
        return F.struct(run_id.cast("bigint").alias("run_id"), F.lit(rank).alias("rank"), text.alias("line"))

    frame = F.when(F.col("_level") > 0, F.array(outer(F.lit(0), -1, F.lit(HEAD)))).otherwise(
        F.array(outer(F.col("lo"), 0, day), outer(F.col("hi"), 9, F.lit(""))))
    days = (run.groupingSets([["brain", "section_date"], ["brain"]], "brain", "section_date")
            .agg(F.grouping_id().alias("_level"), F.min("run_id").alias("lo"), F.max("run_id").alias("hi")))
    frames = (explode_rows(days, ["brain", "section_date"], frame, "_l")
              .select("brain", "section_date", "_l.run_id", "_l.rank", F.lit(0).cast("bigint").alias("seq"), "_l.line"))
    return frames.unionByName(items).unionByName(own)


def changelog_sort() -> list:
    return [F.desc_nulls_first("section_date"), "run_id", "rank", "seq"]


def run_report(entries: DataFrame) -> DataFrame:
    """Counts per library and action, and whether anything changed."""
    out = entries.groupBy("brain").agg(
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in COUNTED],
        F.count_distinct("run_id").alias("n_runs"))
    changed = sum((F.col(f"n_{a}") for a in COUNTED if a != "skip"), F.lit(0))
    return out.withColumn("changed", (changed > 0).cast("int"))
