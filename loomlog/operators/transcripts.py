"""Transcript entries: typing, tool-block filtering, turns and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.arrays import explode_rows
from loomlog.plans.ordered import CHUNK_WIDTH, join_group_value, latest_per_key, running_sum

PLAN_TOOL = "ExitPlanMode"
STRIPPED = "[STRIPPED]"
MODES = ("none", "minimal", "full")

_FALSY_JSON = ("null", "false", "0", "0.0", '""', "[]", "{}")


# ---- typing ----

def parse_entries(lines: DataFrame) -> DataFrame:
    """Type raw JSON lines: (keys.., raw) -> + v, is_entry, entry_type, is_sidechain,
    custom_title, content. Malformed lines and non-objects have is_entry = false."""
    v = F.col("v")
    flag = F.to_json(F.try_variant_get(v, "$.isSidechain", "variant"))
    return (lines
            .withColumn("v", F.when(F.startswith(F.ltrim("raw"), F.lit("{")), F.try_parse_json("raw")))
            .withColumn("is_entry", v.isNotNull())
            .withColumn("entry_type", F.try_variant_get(v, "$.type", "string"))
            .withColumn("is_sidechain", F.coalesce(~flag.isin(*_FALSY_JSON), F.lit(False)))
            .withColumn("custom_title", F.try_variant_get(v, "$.customTitle", "string"))
            .withColumn("content", F.try_variant_get(v, "$.message.content", "variant")))


def is_text_content(content: Column) -> Column:
    return F.coalesce(F.schema_of_variant(content) == "STRING", F.lit(False))


def content_string(content: Column) -> Column:
    """Content given as a plain string, NULL when it is anything else."""
    return F.when(is_text_content(content), F.try_variant_get(content, "$", "string"))


def content_blocks(content: Column) -> Column:
    """Content given as a block array, NULL when it is anything else."""
    return F.try_variant_get(content, "$", "array<variant>")


def block_field(block: Column, name: str) -> Column:
    return F.try_variant_get(block, f"$.{name}", "string")


def _not_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def real_user_content(content: Column) -> Column:
    """True for a prompt typed by a person: non-blank string, or a block array without any
    tool_result and with a non-blank text block."""
    blocks = content_blocks(content)
    has_result = F.exists(blocks, lambda b: F.coalesce(block_field(b, "type") == "tool_result", F.lit(False)))
    has_text = F.exists(blocks, lambda b: F.coalesce(block_field(b, "type") == "text", F.lit(False))
                        & _not_blank(block_field(b, "text")))
    return F.coalesce(F.when(is_text_content(content), _not_blank(content_string(content)))
                      .otherwise(~has_result & has_text), F.lit(False))


def real_user_message(entries: DataFrame) -> DataFrame:
    return entries.withColumn("is_real_user", real_user_content(F.col("content")))


def real_user_message_flat(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The same test where blocks are already rows (keys.., type, body)."""
    return (blocks.groupBy(*keys)
            .agg((~F.bool_or(F.col("type") == "tool_result")
                  & F.bool_or((F.col("type") == "text") & _not_blank(F.col("body")))).alias("is_real_user")))


def main_session_only(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.coalesce("is_sidechain", F.lit(False)))


def entry_type_filter(entries: DataFrame, *kinds: str) -> DataFrame:
    return entries.filter(F.col("entry_type").isin(*kinds))


# ---- tool blocks ----

def effective_mode(mode: str) -> str:
    """Unknown modes fall back to the safest one."""
    return mode if mode in MODES else "none"


def filtered_blocks(blocks: Column, mode: str) -> Column:
    """Tool blocks of an array<variant> dropped (`none`) or hollowed out (`minimal`). Plan
    calls, other block types and non-object members stay."""
    mode = effective_mode(mode)
    if mode == "full":
        return blocks

    def is_call(b):
        return F.coalesce((block_field(b, "type") == "tool_use")
                          & ~F.coalesce(block_field(b, "name") == PLAN_TOOL, F.lit(False)), F.lit(False))

    def is_result(b):
        return F.coalesce(block_field(b, "type") == "tool_result", F.lit(False))

    if mode == "none":
        return F.filter(blocks, lambda b: ~is_call(b) & ~is_result(b))

    def hollow(b):
        def part(name):
            return F.try_variant_get(b, f"$.{name}", "variant")
        call = F.to_variant_object(F.struct(F.lit("tool_use").alias("type"), part("id").alias("id"),
                                            part("name").alias("name"), F.lit(STRIPPED).alias("input")))
        result = F.to_variant_object(F.struct(F.lit("tool_result").alias("type"),
                                              part("tool_use_id").alias("tool_use_id"),
                                              F.lit(STRIPPED).alias("content")))
        return F.when(is_call(b), call).when(is_result(b), result).otherwise(b)

    return F.transform(blocks, hollow)


def filter_tool_blocks(entries: DataFrame, mode: str = "none") -> DataFrame:
    """Adds `sanitized`: the entry as JSON text with its tool blocks filtered by `mode`.

    String content and entries without a block array keep their text. Lines that are no
    JSON object have no safe form: they come out NULL unless the mode is `full`.
    """
    mode = effective_mode(mode)
    if mode == "full":
        return entries.withColumn("sanitized", F.col("raw"))
    top = F.try_variant_get("v", "$", "map<string,variant>")
    rebuilt = F.to_json(F.to_variant_object(F.transform_values(
        top, lambda k, val: F.when(
            k == "message",
            F.to_variant_object(F.transform_values(
                F.try_variant_get(val, "$", "map<string,variant>"),
                lambda k2, val2: F.when(k2 == "content", F.to_variant_object(F.col("_kept"))).otherwise(val2))),
        ).otherwise(val))))
    return (entries
            .withColumn("_kept", filtered_blocks(content_blocks(F.col("content")), mode))
            .withColumn("sanitized", F.when(F.col("_kept").isNotNull(), rebuilt)
                        .when(F.col("is_entry"), F.col("raw")))
            .drop("_kept"))


def filter_block_rows(blocks: DataFrame, mode: str = "none") -> DataFrame:
    """The same rule where blocks are rows (.., type, name, id, body)."""
    mode = effective_mode(mode)
    tool = (F.col("type").isin("tool_use", "tool_result")
            & ~F.coalesce((F.col("type") == "tool_use") & (F.col("name") == PLAN_TOOL), F.lit(False)))
    if mode == "full":
        return blocks
    if mode == "none":
        return blocks.filter(~F.coalesce(tool, F.lit(False)))
    return blocks.withColumn("body", F.when(tool, F.lit(STRIPPED)).otherwise(F.col("body")))


def explode_blocks(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One row per content block (keys.., block_no, type, name, id, body). String content is
    one text block; members that are not objects have no type and their JSON as body."""
    kept = entries.select(*keys, content_string(F.col("content")).alias("_text"), "content")
    blocks = (F.when(F.col("_text").isNotNull(), F.array(F.lit(None).cast("variant")))
              .otherwise(content_blocks(F.col("content"))))
    rows = (explode_rows(kept, [*keys, "_text"], blocks, "_block", pos="block_no")
            .withColumn("type", F.when(F.col("_text").isNotNull(), "text").otherwise(block_field(F.col("_block"), "type")))
            .withColumn("name", block_field(F.col("_block"), "name")))
    b, kind = F.col("_block"), F.col("type")
    body = (F.when(F.col("_text").isNotNull(), F.col("_text"))
            .when(kind == "text", block_field(b, "text"))
            .when((kind == "tool_use") & (F.col("name") == PLAN_TOOL),
                  F.coalesce(F.try_variant_get(b, "$.input.plan", "string"), F.lit("")))
            .when(kind == "tool_use", F.to_json(F.try_variant_get(b, "$.input", "variant")))
            .when(kind == "tool_result", F.to_json(F.try_variant_get(b, "$.content", "variant")))
            .otherwise(F.to_json(b)))
    return rows.select(*keys, "block_no", "type", "name",
                       F.coalesce(block_field(b, "id"), block_field(b, "tool_use_id")).alias("id"), body.alias("body"))


def plan_text(kind: Column, name: Column, body: Column) -> Column:
    """Text a block adds to the narrative: text as it is, a plan call under its heading,
    anything else (and empty text) NULL."""
    return (F.when((kind == "text") & (body != ""), body)
            .when((kind == "tool_use") & (name == PLAN_TOOL) & (body != ""),
                  F.concat(F.lit("**[Plan]**\n\n"), body)))


def tool_usage(blocks: DataFrame) -> DataFrame:
    return (blocks.filter(F.col("type") == "tool_use").groupBy("session_id", "name")
            .agg(F.count(F.lit(1)).alias("n_calls")))


def tool_call_pairs(blocks: DataFrame) -> DataFrame:
    """Each tool call with its result line; calls without one have NULL. The join key holds
    the call id, so a huge session spreads over all tasks; calls without an id have no result
    and are not joined."""
    calls = blocks.filter(F.col("type") == "tool_use").select("session_id", "id", "name", "line_no")
    results = (blocks.filter((F.col("type") == "tool_result") & F.col("id").isNotNull())
               .groupBy("session_id", "id").agg(F.min("line_no").alias("result_line")))
    named = calls.filter("id is not null").join(results, ["session_id", "id"], "left")
    return named.unionByName(calls.filter("id is null").withColumn("result_line", F.lit(None).cast("bigint")))


# ---- turns and titles ----

def latest_title(titles: DataFrame) -> DataFrame:
    """Last non-empty title per session by line order (session_id, line_no, title)."""
    return (latest_per_key(titles.filter(F.coalesce(F.col("title"), F.lit("")) != ""), ["session_id"], ["line_no"])
            .select("session_id", "title"))


def session_titles(entries: DataFrame) -> DataFrame:
    return latest_title(entry_type_filter(entries, "custom-title")
                        .select("session_id", "line_no", F.col("custom_title").alias("title")))


def line_number(entries: DataFrame, out: str = "position", chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """Dense 1-based position of each entry in its session."""
    return running_sum(entries, ["session_id"], ["line_no"], F.lit(1), out,
                       F.floor(F.col("line_no") / chunk_width))


def turn_segment(entries: DataFrame, chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """Number the turns of each session; a real main-session user message opens one."""
    opens = ((F.col("entry_type") == "user") & ~F.col("is_sidechain") & F.col("is_real_user"))
    return running_sum(entries, ["session_id"], ["line_no"], F.coalesce(opens, F.lit(False)).cast("int"),
                       "turn_no", F.floor(F.col("line_no") / chunk_width))


def last_user_line(entries: DataFrame) -> DataFrame:
    return (main_session_only(entry_type_filter(entries, "user")).filter("is_real_user")
            .groupBy("session_id").agg(F.max("line_no").alias("last_user_line")))


def last_turn_pieces(entries: DataFrame, pieces: DataFrame) -> DataFrame:
    """Main-session assistant texts and plans after the last real user message, as ordered rows
    (session_id, line_no, block_no, text).

    `entries`: session_id, line_no, entry_type, is_sidechain, is_real_user. `pieces`:
    session_id, line_no, block_no, entry_type, is_sidechain, text. No window over a session:
    one aggregate finds the cut, and a join by chunks drops everything before it.
    """
    said = (main_session_only(entry_type_filter(pieces, "assistant"))
            .filter(F.coalesce(F.col("text"), F.lit("")) != "")
            .select("session_id", "line_no", "block_no", "text"))
    return (join_group_value(said, last_user_line(entries), ["session_id"], F.floor(F.col("line_no") / CHUNK_WIDTH))
            .filter(F.col("line_no") > F.col("last_user_line")).select("session_id", "line_no", "block_no", "text"))


def last_assistant_turn(entries: DataFrame, pieces: DataFrame) -> DataFrame:
    """The last turn of each session as one text (session_id, text), its pieces parted by a blank
    line. A turn is one document, so it is one value, however the files were split."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "block_no", "text")))
    return (last_turn_pieces(entries, pieces).groupBy("session_id")
            .agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("text")))


def text_pieces(entries: DataFrame) -> DataFrame:
    """Narrative pieces of typed entries (session_id, line_no, block_no, entry_type,
    is_sidechain, text)."""
    keys = ["session_id", "line_no", "entry_type", "is_sidechain"]
    return (explode_blocks(entries, keys)
            .withColumn("text", plan_text(F.col("type"), F.col("name"), F.col("body")))
            .filter(F.col("text").isNotNull())
            .select("session_id", "line_no", "block_no", "entry_type", "is_sidechain", "text"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """One copy per session although every date folder holds a full one."""
    return latest_per_key(snapshots, ["session_id"], ["log_date", "ts"])
