"""Edit blocks: parsing, validity, order, and versioned application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.arrays import explode_rows
from loomlog.functions.front_matter import LIBRARY_ROOT, article_stem, display_path, escapes_root, is_generated
from loomlog.functions.titles import strip_blanks
from loomlog.operators.library import parse_articles
from loomlog.plans.ordered import first_per_key, latest_per_key, previous_value

# Block marker and accepted actions of each response kind.
MARKERS = {"compile": "EDIT", "supervise": "SUPERVISE"}
ACTIONS = {"compile": ("create", "update", "skip"), "supervise": ("rewrite", "create", "delete", "skip")}
# A first response and one retry.
MAX_ATTEMPTS = 2
RUNS_PER_CHUNK = 1000

_END = r"(?:^@@@END[^\S\n]*$|\z)"


def _lines(text: Column) -> Column:
    """All line separators as \\n."""
    return F.regexp_replace(text, r"\r\n|[\r\x0b\f\x1c-\x1e\x85\u2028\u2029]", "\n")


def _blocks(text: Column, marker: str) -> Column:
    """Blocks from a marker line to the first @@@END line or the end of the text; marker
    lines inside a block belong to it."""
    return F.regexp_extract_all(text, F.lit(rf"(?md)^@@@(?:{marker}|SUMMARY)[^\S\n]*$[\s\S]*?{_END}"), F.lit(0))


def _header_value(lines: Column, key: str) -> Column:
    """Last `key: value` header line; absent -> empty."""
    hits = F.filter(lines, lambda s: F.contains(s, F.lit(":")) & (F.trim(F.substring_index(s, ":", 1)) == key))
    last = F.try_element_at(hits, F.lit(-1))
    return F.coalesce(strip_blanks(F.substring(last, F.instr(last, ":") + 1, F.length(last))), F.lit(""))


def with_blocks(responses: DataFrame) -> DataFrame:
    """Adds edit_blocks, n_edits, summary and the parse status of each response."""
    by_kind = None
    for kind, marker in MARKERS.items():
        value = _blocks(F.col("_text"), marker)
        by_kind = F.when(F.col("kind") == kind, value) if by_kind is None else by_kind.when(F.col("kind") == kind, value)
    is_summary = lambda b: F.startswith(b, F.lit("@@@SUMMARY"))
    found = (responses.withColumn("_text", _lines(F.col("text"))).withColumn("_blocks", by_kind)
             .withColumn("edit_blocks", F.filter("_blocks", lambda b: ~is_summary(b)))
             .withColumn("_summary", F.try_element_at(F.filter("_blocks", is_summary), F.lit(-1))))
    summary = strip_blanks(F.regexp_extract("_summary", rf"(?md)\A@@@SUMMARY[^\S\n]*\n?([\s\S]*?){_END}", 1))
    return (found.withColumn("summary", F.coalesce(summary, F.lit("")))
            .withColumn("n_edits", F.size("edit_blocks"))
            .withColumn("status", F.when(F.col("n_edits") > 0, "parsed")
                        .when((F.col("kind") == "supervise") & (F.col("summary") != ""), "implicit_skip")
                        .otherwise("unparseable"))
            .drop("_text", "_blocks", "_summary"))


def parse_edits(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Edit rows (keys.., kind, seq, action, path, reason, content); content is NULL without
    a body. A review that holds a summary only is one `skip`."""
    block, implied = F.col("_block"), F.col("status") == "implicit_skip"
    blocks = F.when(implied, F.array(F.lit(""))).otherwise(F.col("edit_blocks"))
    rows = (explode_rows(parsed, [*keys, "kind", "status", "summary"], blocks, "_block", pos="seq")
            .withColumn("_head", F.split(F.regexp_extract(
                block, r"(?md)\A@@@\w+[^\S\n]*\n([\s\S]*?)(?:^@@@(?:BODY|END)[^\S\n]*$|\z)", 1), "\n"))
            .withColumn("_body", F.regexp_extract(
                block, rf"(?md)\A[\s\S]*?^@@@BODY[^\S\n]*$\n?([\s\S]*?){_END}", 1)))
    said = F.concat(F.lit("implicit skip (summary-only response): "), F.col("summary"))
    return rows.select(
        *keys, "kind", "seq",
        F.when(implied, "skip").otherwise(_header_value(F.col("_head"), "action")).alias("action"),
        _header_value(F.col("_head"), "path").alias("path"),
        F.when(implied, said).otherwise(_header_value(F.col("_head"), "reason")).alias("reason"),
        F.when(block.rlike(r"(?md)^@@@BODY[^\S\n]*$"),
               F.concat(F.regexp_replace("_body", r"(?U)[\s\x1c-\x1f]+\z", ""), F.lit("\n"))).alias("content"))


def parse_errors(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Error rows of responses without a usable block, with their whole text."""
    return (parsed.filter(F.col("status") == "unparseable")
            .select(*keys, F.lit("parse").alias("stage"),
                    F.concat(F.lit("no edit blocks found: "), F.col("text")).alias("message")))


def _allowed(parsed: DataFrame, attempts: int | None) -> DataFrame:
    return parsed if attempts is None else parsed.filter(F.col("attempt") <= attempts)


def retry_choice(parsed: DataFrame, key: str = "run_id", attempts: int | None = MAX_ATTEMPTS) -> DataFrame:
    """First parseable one of the first `attempts` responses of a run (None: of all)."""
    usable = _allowed(parsed, attempts).filter(F.col("status") != "unparseable")
    return first_per_key(usable, [key], ["attempt"])


def failed_runs(parsed: DataFrame, key: str = "run_id", attempts: int | None = MAX_ATTEMPTS) -> DataFrame:
    """Runs whose first `attempts` responses all failed."""
    return (_allowed(parsed, attempts).groupBy(key)
            .agg(F.bool_and(F.col("status") == "unparseable").alias("failed"), F.max("attempt").alias("attempts"))
            .filter("failed").drop("failed"))


def classify_edits(edits: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """Adds verdict: ok, outside_root, empty_content or unknown_action. `skip` passes before
    its path is looked at."""
    rel = display_path(F.col("path"), root)
    outside = ~F.startswith(F.col("path"), F.lit(root)) | escapes_root(rel) | is_generated(rel)
    empty = ~F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False))
    action, compiling = F.col("action"), F.col("kind") == "compile"
    known = F.when(compiling, action.isin(*ACTIONS["compile"])).otherwise(action.isin(*ACTIONS["supervise"]))
    verdict = (F.when(action == "skip", "ok").when(outside, "outside_root")
               # Synthesis looks at the content before the action, the review after it.
               .when(compiling & empty, "empty_content")
               .when(~known, "unknown_action")
               .when((action != "delete") & empty, "empty_content").otherwise("ok"))
    return edits.withColumn("verdict", verdict)


def edit_sequence(edits: DataFrame, library: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """Existence of each valid edit's path right before it, as if edits ran one by one.

    After an edit a path exists unless the edit deleted it, so the state before an edit is
    set by the last edit of that path, and by the library for the first one. Hot paths are
    cut into chunks of runs.
    """
    keys = ["brain", "path"]
    valid = classify_edits(edits, root).filter((F.col("verdict") == "ok") & (F.col("action") != "skip"))
    known = library.select(*keys).distinct().withColumn("action", F.lit("create"))
    seen = previous_value(valid, keys, ["run_id", "seq"], "action", "_previous",
                          F.floor(F.col("run_id") / RUNS_PER_CHUNK), known)
    return (seen.withColumn("exists_before", F.coalesce(F.col("_previous") != "delete", F.lit(False)))
            .drop("_previous", "verdict"))


def edit_target_state(edits: DataFrame, library: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """Adds the action that really happens: synthesis turns create/update into what the
    target's state allows; a review's delete of a missing path is `ignored`."""
    effective = (F.when(F.col("kind") == "compile", F.when(F.col("exists_before"), "update").otherwise("create"))
                 .when((F.col("action") == "delete") & ~F.col("exists_before"), "ignored")
                 .otherwise(F.col("action")))
    return edit_sequence(edits, library, root).withColumn("effective", effective)


def new_versions(edits: DataFrame, library: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """Version rows of applied edits; (run_id, seq) orders the history of a path, so no
    counter has to be handed out."""
    return (edit_target_state(edits, library, root).filter(F.col("effective") != "ignored")
            .select("brain", "path", "run_id", "seq", F.col("effective").alias("action"),
                    F.when(F.col("effective") != "delete", F.col("content")).alias("content")))


def append_versions(versions: DataFrame, edits: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """History with the edits applied on top. Runs already in the history add nothing."""
    done = versions.select("brain", "run_id").distinct()
    fresh = edits.join(done, ["brain", "run_id"], "left_anti")
    return versions.unionByName(new_versions(fresh, latest_version(versions), root))


def latest_version(versions: DataFrame) -> DataFrame:
    """Current articles: last version of each path, deleted paths left out."""
    return (latest_per_key(versions, ["brain", "path"], ["run_id", "seq"])
            .filter(F.col("action") != "delete"))


def applied_log(edits: DataFrame, library: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """What a run reports: applied edits with their effective action, and skips."""
    cols = ["brain", "kind", "run_id", "seq"]
    done = (edit_target_state(edits, library, root).filter(F.col("effective") != "ignored")
            .select(*cols, F.col("effective").alias("action"), "path", F.lit(None).cast("string").alias("note")))
    skips = (edits.filter(F.col("action") == "skip")
             .select(*cols, "action", F.lit(None).cast("string").alias("path"),
                     F.coalesce("reason", F.lit("(no reason)")).alias("note")))
    return done.unionByName(skips)


def rejected_edits(edits: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """Error rows of edits that may not be applied."""
    return (classify_edits(edits, root).filter(F.col("verdict") != "ok")
            .select("brain", "run_id", "seq", F.lit("apply").alias("stage"),
                    F.concat_ws(": ", "verdict", "action", "path").alias("message")))


def move_pairs(edits: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """A delete and a create/rewrite of the same stem at another path in one run are a move.
    Targets are summarised per (run, stem) first, so output stays linear in the deletes."""
    keyed = classify_edits(edits, root).filter(F.col("verdict") == "ok").withColumn("stem", article_stem(F.col("path")))
    keys = ["brain", "run_id", "stem"]
    gone = keyed.filter(F.col("action") == "delete").select(*keys, F.col("path").alias("from_path")).distinct()
    # The two least target paths are enough to find one that is not the deleted path itself.
    made = (keyed.filter(F.col("action").isin("create", "rewrite")).groupBy(*keys)
            .agg(F.min("path").alias("_lo"), F.max("path").alias("_hi")))
    target = F.when(F.col("_lo") != F.col("from_path"), F.col("_lo")).otherwise(F.col("_hi"))
    return (gone.join(made, keys).withColumn("to_path", target).drop("_lo", "_hi")
            .filter(F.col("to_path") != F.col("from_path")))


def edit_invariants(versions: DataFrame) -> DataFrame:
    """Broken promises of updates, one row per version and rule: `created` kept, `updated`
    not going back, `sources` only growing, target present before."""
    typed = (parse_articles(versions).withColumn(
        "_meta", F.struct(F.col("created"), F.col("updated"), F.col("sources"), F.col("action").alias("was"))))
    seen = previous_value(typed, ["brain", "path"], ["run_id", "seq"], "_meta", "_before",
                          F.floor(F.col("run_id") / RUNS_PER_CHUNK))
    old, missing = F.col("_before"), F.col("_before").isNull() | (F.col("_before.was") == "delete")
    checks = F.array(
        F.when(missing, F.lit("no_target")),
        F.when(~missing & ~F.col("created").eqNullSafe(old["created"]), F.lit("created_changed")),
        F.when(~missing & (F.col("updated") < old["updated"]), F.lit("updated_went_back")),
        F.when(~missing & (F.size(F.array_except(old["sources"], "sources")) > 0), F.lit("sources_lost")))
    return explode_rows(seen.filter(F.col("action") == "update"), ["brain", "path", "run_id", "seq"],
                        F.array_compact(checks), "violation")
