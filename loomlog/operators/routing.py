"""Scope and store of each session, opt-out purge and migration from staging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.titles import clean_title, normalize_cwd, prefix_scope
from loomlog.plans.ordered import first_per_key

UNCLASSIFIED = "unclassified"


def first_rule(cwd: Column, rules: Sequence[tuple[str, str | None]], default: str = "unset") -> Column:
    """Scope of the first rule whose needle occurs in the path.

    Rules are an ordered list in a config file, so they are planned as one CASE: first match
    wins by construction, with no join, no aggregate and no shuffle. Empty needles never
    match; a rule without a scope means `unset`.
    """
    norm = normalize_cwd(cwd)
    out = None
    for needle, scope in rules:
        if not needle:
            continue
        hit, value = F.contains(norm, F.lit(needle)), F.lit(scope or "unset")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(default)


def resolve_scope(sessions: DataFrame, rules: Sequence[tuple[str, str | None]], default: str = "unset",
                  title: str = "raw_title", cwd: str = "cwd") -> DataFrame:
    """Adds scope and title: title prefix first, then path rules, then the default."""
    return (sessions
            .withColumn("scope", F.coalesce(prefix_scope(F.col(title)), first_rule(F.col(cwd), rules, default)))
            .withColumn("title", clean_title(F.col(title))))


def route_to_store(sessions: DataFrame, stores: Mapping[str, str], unclassified: str = UNCLASSIFIED) -> DataFrame:
    """Adds store. Scopes are a fixed set of five, so the lookup is an expression."""
    out = None
    for scope, store in stores.items():
        if store:
            hit = F.col("scope") == scope
            out = F.when(hit, F.lit(store)) if out is None else out.when(hit, F.lit(store))
    return sessions.withColumn("store", F.lit(unclassified) if out is None else out.otherwise(unclassified))


def union_roots(tables: Sequence[DataFrame]) -> DataFrame:
    """Staging and every store as one table."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def nolog_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("scope") == "nolog").select("session_id").distinct()


def purge_nolog(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of all roots without those of sessions that opted out."""
    return rows.join(nolog_sessions(sessions), "session_id", "left_anti")


def purge_partitions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """(store, log_date) partitions a purge has to rewrite; the rest stay untouched."""
    return (rows.select("store", "log_date", "session_id")
            .join(nolog_sessions(sessions), "session_id", "left_semi")
            .select("store", "log_date").distinct())


def migrate_unclassified(staged: DataFrame, sessions: DataFrame, target: DataFrame) -> DataFrame:
    """Decide each staged row: `moved` to the store of its now-known scope, `clash` where the
    key is already there, `waiting` while unset. `nolog` sessions are left to the purge.

    staged: session_id, log_date; sessions: session_id, scope, store; target: session_id,
    log_date, store.
    """
    known = staged.join(sessions.select("session_id", "scope", "store"), "session_id", "left")
    taken = target.select("session_id", "log_date", "store").distinct().withColumn("_taken", F.lit(True))
    return (known.join(taken, ["session_id", "log_date", "store"], "left")
            .withColumn("state", F.when(F.coalesce(F.col("scope"), F.lit("unset")).isin("unset", "nolog"), "waiting")
                        .when(F.col("_taken"), "clash").otherwise("moved"))
            .drop("_taken"))


def move_to_current_store(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """All rows in the store their session belongs to now, not only staged ones; rows of
    unknown sessions stay where they are."""
    now = sessions.select("session_id", F.col("store").alias("_now"))
    return (rows.join(now, "session_id", "left").withColumn("store", F.coalesce("_now", "store")).drop("_now")
            .select(*rows.columns))


def once_per_session(events: DataFrame) -> DataFrame:
    """First event of each session: the one that sets the mark."""
    return first_per_key(events, ["session_id"], ["ts", "event_id"])


def cleared_marks(marks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Marks left after a purge."""
    return marks.join(nolog_sessions(sessions), "session_id", "left_anti")
