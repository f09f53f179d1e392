"""Session catalog and narrative lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.titles import log_file_name, log_summary_line
from loomlog.operators.redaction import redact_table
from loomlog.plans.ordered import CHUNK_WIDTH, join_group_value, latest_per_key

ASSISTANT = "Claude"


def session_first_entry(events: DataFrame) -> DataFrame:
    """First time of each (session, date) and its HHMMSS key; a later title change keeps it."""
    return (events.groupBy("session_id", F.to_date("ts").alias("log_date"))
            .agg(F.min("ts").alias("first_ts"))
            .withColumn("hhmmss", F.date_format("first_ts", "HHmmss")))


def session_catalog(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """One row per (store, date, session): time key, clean title, file name, log line. Sessions
    that opted out are not listed.

    sessions: session_id, scope, store, title; events: session_id, ts.
    """
    return (session_first_entry(events).join(sessions.filter("scope <> 'nolog'").select("session_id", "scope", "store", "title"), "session_id")
            .withColumn("file_name", F.concat(log_file_name(F.col("hhmmss"), F.col("title"), F.col("session_id")),
                                              F.lit(".md")))
            .withColumn("log_line", log_summary_line(F.col("title"), F.col("session_id"), F.col("scope"))))


def sort_sessions(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("log_date", "hhmmss", "session_id")


def header_text(title: Column, session_id: Column, scope: Column, started: Column,
                assistant: str = ASSISTANT) -> Column:
    name = F.coalesce(F.nullif(title, F.lit("")), session_id)
    return F.concat(F.lit(f"# {assistant} session: "), name, F.lit("\n\n_session_id: "), session_id,
                    F.lit("_  \n_scope: "), scope, F.lit("_  \n_Started: "),
                    F.date_format(started, "yyyy-MM-dd HH:mm:ss"), F.lit("_\n\n"))


def section_text(role: Column, ts: Column, text: Column, assistant: str = ASSISTANT) -> Column:
    clock = F.date_format(ts, "HH:mm:ss")
    return (F.when(role == "user", F.concat(F.lit("\n## ["), clock, F.lit("] User\n\n"), text, F.lit("\n\n")))
            .when(role == "assistant",
                  F.concat(F.lit("### ["), clock, F.lit(f"] {assistant}\n\n"), text, F.lit("\n\n---\n\n"))))


def session_narrative(turns: DataFrame, sessions: DataFrame, assistant: str = ASSISTANT) -> DataFrame:
    """Narrative documents as ordered rows (store, log_date, session_id, line_no, text).

    A header row (line_no -1) opens each (store, date, session), then one row per user or
    assistant turn; the texts in line order are the document. Rows stay rows: a session of
    any size is never gathered into one value. Sessions that opted out, side chains and blank
    texts write nothing, and texts are redacted.

    turns: session_id, line_no, role, ts, text[, is_sidechain]; sessions: session_id, scope,
    store, title.
    """
    main = turns.filter(~F.coalesce("is_sidechain", F.lit(False))) if "is_sidechain" in turns.columns else turns
    spoken = main.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != "")).withColumn("log_date", F.to_date("ts"))
    spoken = redact_table(spoken, ["text"])
    keys = ["store", "log_date", "session_id"]
    info = sessions.filter("scope <> 'nolog'").select("session_id", "scope", "store", "title")
    heads = (spoken.groupBy("session_id", "log_date").agg(F.min("ts").alias("ts"))
             .join(info, "session_id")
             .select(*keys, F.lit(-1).cast("bigint").alias("line_no"),
                     header_text(F.col("title"), F.col("session_id"), F.col("scope"), F.col("ts"),
                                 assistant).alias("text")))
    body = (join_group_value(spoken, info.select("session_id", "store"), ["session_id"],
                             F.floor(F.col("line_no") / CHUNK_WIDTH))
            .select(*keys, F.col("line_no").cast("bigint").alias("line_no"),
                    section_text(F.col("role"), F.col("ts"), F.col("text"), assistant).alias("text")))
    return heads.unionByName(body)


def filter_sessions(logs: DataFrame, needle: str) -> DataFrame:
    """Logs whose file name holds a part of a session id."""
    return logs.filter(F.contains(F.col("file_name"), F.lit(needle)))


def current_scopes(scope_events: DataFrame) -> DataFrame:
    """Latest known scope per session (session_id, ts, scope)."""
    return latest_per_key(scope_events, ["session_id"], ["ts"])
