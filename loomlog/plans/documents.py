"""Index and changelog kept up by increments.

A document is stored as fragments: of the index one per category, of the changelog one per day. Either
depends on nothing outside it, so a run makes the fragments anew that its edits and runs fall into, and no
other; all it rewrites is one change (`sources/changes.py`). A category is a folder of its own. Days are many
and small, so files hold ranges of them: a file with a day that is made anew is written without it, the
others stay, and a log has as many files as its runs and its size ask for, not one a day. Heads are made when
a document is read: they hold no more than the number of articles, which the fragments tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import front_matter as fm
from loomlog.operators import changelog as ch
from loomlog.operators import library as lb
from loomlog.session import saved
from loomlog.sources.changes import Change, finished, settle
from loomlog.sources.sinks import stored

INDEX_SCHEMA = "brain string, part int, category string, stem string, path string, line string, unit string"
CHANGELOG_SCHEMA = "brain string, section_date date, run_id bigint, rank int, seq bigint, line string, unit string"


def _unit(*of: str) -> Column:
    """Name of a fragment's partition: categories may hold any character and be as long as they like."""
    return F.concat(F.lit("u"), F.substring(F.sha2(F.to_json(F.struct(*of)).cast("binary"), 256), 1, 32))


def dirty_categories(edited: DataFrame, root: str = fm.LIBRARY_ROOT) -> DataFrame:
    """(brain, category) of edited paths (brain, path)."""
    category = fm.article_category(fm.display_path(F.col("path"), root))
    return edited.select("brain", category.alias("category")).distinct()


def refresh_documents(spark: SparkSession, home: str, name: str, catalog: DataFrame, edited: DataFrame, entries: DataFrame,
                      runs: DataFrame, new_runs: DataFrame, first_token: bool = False) -> bool:
    """Bring the stored documents up to date after a run; False if the run of this name was done before.

    `catalog`: the articles as they are now (see `parse_articles`); `edited`: (brain, path) of all that were
    written, moved or deleted; `entries` and `runs`: the whole log (see `changelog`); `new_runs`: (brain,
    run_id) of the runs whose days are written anew. Of a table that may hold years only what falls into
    dirty fragments is joined.
    """
    settle(spark, home)
    if finished(spark, home, name):
        return False
    change = Change(spark, home, name)

    categories = saved(dirty_categories(edited).withColumn("unit", _unit("brain", "category")), "dirty-categories")
    articles = catalog.join(categories, ["brain", "category"], "left_semi")
    lines = lb.index_sections(articles, first_token).withColumn("unit", _unit("brain", "category"))
    change.replace(f"{home}/index", _typed(lines, INDEX_SCHEMA), categories, "unit")

    days = runs.join(new_runs, ["brain", "run_id"], "left_semi").select("brain", "section_date").distinct()
    days = saved(days.withColumn("unit", _unit("brain", "section_date")), "dirty-days")
    of_days = runs.join(days, ["brain", "section_date"], "left_semi")
    told = entries.join(of_days, ["brain", "run_id"], "left_semi")
    lines = ch.changelog(told, of_days).filter("section_date is not null").withColumn("unit", _unit("brain", "section_date"))
    change.remove(f"{home}/changelog", days, ["unit"])
    change.add(_typed(lines, CHANGELOG_SCHEMA).repartitionByRange("section_date", "brain", "run_id"), f"{home}/changelog")

    change.run()
    return True


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    """`rows` with the columns of a stored table, in its order."""
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in (part.split() for part in schema.split(", "))])


def _fragments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    rows = stored(spark, root, schema)
    return (spark.createDataFrame([], schema) if rows is None else rows).drop("unit")


def index_document(spark: SparkSession, home: str, regenerated: str, brains: DataFrame | None = None) -> DataFrame:
    """What `library_index` gives of the whole catalog, from the stored fragments."""
    rows = _fragments(spark, f"{home}/index", INDEX_SCHEMA)
    counts = rows.filter("part = 2").groupBy("brain").agg(F.count(F.lit(1)).alias("n"))
    return lb.index_heads(counts, regenerated, brains=brains).unionByName(rows)


def changelog_document(spark: SparkSession, home: str) -> DataFrame:
    """What `changelog` gives of the whole log, from the stored fragments."""
    rows = _fragments(spark, f"{home}/changelog", CHANGELOG_SCHEMA)
    heads = rows.select("brain").distinct().select(
        "brain", F.lit(None).cast("date").alias("section_date"), F.lit(0).cast("bigint").alias("run_id"), F.lit(-1).alias("rank"),
        F.lit(0).cast("bigint").alias("seq"), F.lit(ch.HEAD).alias("line"))
    return heads.unionByName(rows)
