"""Whole jobs: events to logs, responses to library, library to shared store."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.redaction import redact_json
from loomlog.operators.edits import (append_versions, latest_version, parse_edits, parse_errors, rejected_edits,
                                     retry_choice, with_blocks)
from loomlog.operators.compile_window import Cursor, pending_sessions
from loomlog.operators.library import compile_context, parse_articles, review_context
from loomlog.operators.promote import apply_promotion, union_sources
from loomlog.operators.redaction import redact_table
from loomlog.operators.transcripts import effective_mode, filter_tool_blocks, last_assistant_turn


def logged_turns(sessions: DataFrame, turns: DataFrame, config) -> DataFrame:
    """What a stop writes: the last assistant turn of each session that keeps a log, routed
    and redacted (session_id, store, scope, title, text).

    turns: session_id, line_no, entry_type, is_sidechain, is_real_user, text.
    """
    kept = config.route(sessions).filter("scope <> 'nolog'").select("session_id", "store", "scope", "title")
    last = last_assistant_turn(turns, turns.withColumn("block_no", F.lit(0)))
    return redact_table(last.join(kept, "session_id"), ["text"]).select(
        "session_id", "store", "scope", "title", "text")


def sanitized_snapshot(entries: DataFrame, mode: str = "none") -> DataFrame:
    """Transcript lines fit to be stored (session_id, line_no, line): tool blocks filtered
    first, then every string of the JSON redacted. Lines that are no entry have no safe form and are
    left out unless the mode is `full`; `malformed_lines` reports them."""
    if effective_mode(mode) != "full":
        # Tested on the parsed entry: a test of the finished line would repeat all of its work.
        entries = entries.filter("is_entry")
    kept = filter_tool_blocks(entries, mode).select("session_id", "line_no", F.col("sanitized").alias("_line"))
    return kept.select("session_id", "line_no", redact_json(F.col("_line")).alias("line"))


def malformed_lines(entries: DataFrame) -> DataFrame:
    """Error rows of lines that are no JSON object. Only their length is told: what they hold
    could not be filtered."""
    return (entries.filter("not is_entry")
            .select(F.lit("transcript").alias("stage"), F.concat_ws("/", "session_id", "line_no").alias("key"),
                    F.format_string("malformed line of %d characters", F.length("raw")).alias("message")))


def response_edits(responses: DataFrame) -> DataFrame:
    """Edits of the accepted attempt of each run (run_id, brain, kind, seq, ..)."""
    return parse_edits(retry_choice(with_blocks(responses)), ["run_id", "brain"])


def compile_inputs(lines: DataFrame, articles: DataFrame, cursors: Mapping[str, Cursor], today: date) -> DataFrame:
    """Prompt sections of all closed sessions after the resume points (see `compile_context`).

    lines: brain, log_date, hhmmss, session_id, file_name, line_no, line, the log lines of a
    library's sessions.
    """
    logs = pending_sessions(lines, cursors, today).select(
        "brain", F.col("file_name").alias("session_file"), F.col("line_no").alias("seq"), F.col("line").alias("text"))
    return compile_context(parse_articles(articles), logs)


def review_inputs(articles: DataFrame, today: str) -> DataFrame:
    """Review sections of every library (see `review_context`)."""
    return review_context(parse_articles(articles), today)


def apply_responses(versions: DataFrame, responses: DataFrame) -> DataFrame:
    """History after the accepted responses; running it again adds nothing."""
    return append_versions(versions, response_edits(responses))


def response_errors(responses: DataFrame) -> DataFrame:
    """What went wrong with responses: unusable texts and edits that may not be applied
    (run_id, stage, message)."""
    parsed = with_blocks(responses)
    unusable = parse_errors(parsed, ["run_id"])
    rejected = rejected_edits(response_edits(responses)).select("run_id", "stage", "message")
    return unusable.unionByName(rejected)


def compile_library(versions: DataFrame, edits: DataFrame) -> DataFrame:
    """Library after the edits: history extended, then the latest version of each path."""
    return latest_version(append_versions(versions, edits))


def promote(articles: DataFrame, shared: DataFrame, contributor: str | None = None) -> DataFrame:
    """Shared store after one sync of the flagged articles."""
    return apply_promotion(union_sources(parse_articles(articles)), shared, contributor)
