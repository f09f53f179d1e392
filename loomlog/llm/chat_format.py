"""Conversations as training text: a declarative template, a machine over roles, loss flags.

A template names the marks around the turns of each role, the roles whose text is learned, and a finite
state machine over roles. A turn becomes three or five segments (mark, text, mark; roles without marks of
their own also spell out their name), each with its loss flag. Texts are escaped so that no mark can occur
in them: a backslash is doubled, and a mark is broken by a backslash behind its first character. Marks
neither overlap nor hold one another nor a backslash, so taking one backslash out of each pair or mark
undoes it and the formatted text can be parsed again.

The written table holds one row per turn (conv_id, at, segments), sorted: `at` grows along each
conversation. A conversation may be of any size: the sort deals its turns out by range, and the machine
runs over blocks of turns at once, because what a block does to every state is one small table, and two
such tables put together are one again. Only `documents` and the digests of the query gather whole
conversations.

Order: turn, null first; ties by role, null first, then by a hash of the text, so repeated rows are kept
side by side. Nulls: a null text is the empty text; a null role is the empty role, which has no marks of
its own and no move; rows without a conversation id are one conversation of their own. An empty table
gives an empty table. Conversations that break the order of turns are formatted like all others and
reported by `validated`. Columns other than the four named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomlog.llm.common import pick, table
from loomlog.session import fresh_folder

ESCAPE = "\\"
#: Turns that one step of the machine looks at.
BLOCK_BITS = 12


@dataclass(frozen=True)
class Template:
    """`marks`: role to (mark before, mark after); `other`: marks before the name of any other role,
    between name and text, and after the text. `learn`: roles whose text is under the loss mask.
    `moves`: (state, role) to state, from `start`; a conversation is complete in a state of `ends`."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    learn: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    start: str = "start"
    ends: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        marks = self.all_marks()
        if len(set(marks)) < len(marks) or any(len(m) < 2 or ESCAPE in m for m in marks):
            raise ValueError("marks must differ, have two characters at least and no backslash")
        for a in marks:
            if any(a in b for b in marks if a != b):
                raise ValueError(f"the mark {a!r} is part of another")
            if any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a)) for b in marks):
                raise ValueError(f"the mark {a!r} may run into another")

    def all_marks(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)

    def states(self) -> list[str]:
        """All states, the start first."""
        return list(dict.fromkeys([self.start, *(s for s, _ in self.moves), *self.moves.values(), *self.ends]))


DEFAULT = Template()


def escaped(text: Column, template: Template = DEFAULT) -> Column:
    """The text without marks, every backslash doubled."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return reduce(lambda t, m: F.replace(t, F.lit(m), F.lit(m[0] + ESCAPE + m[1:])), template.all_marks(), doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def ordered(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, turn, role, text) sorted over all partitions; `at` is unique and grows along each
    conversation. Equal rows part by their place in the input, so none fills a task."""
    rows = pick(convs, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_hash")] + [F.col("_place")]
    rows = (rows.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("_hash", F.xxhash64("text"))
            .withColumn("_place", F.monotonically_increasing_id()))
    return (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .select("conv_id", F.monotonically_increasing_id().alias("at"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text")))


def segments(role: Column, text: Column, template: Template = DEFAULT) -> Column:
    """Segments (text, loss) of a turn, in order."""
    def part(value: Column, loss: Column | bool = False) -> Column:
        return F.struct(value.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))

    body = part(escaped(text, template), role.isin(*template.learn) if template.learn else False)
    first, middle, last = template.other
    out = F.array(part(F.lit(first)), part(escaped(role, template)), part(F.lit(middle)), body, part(F.lit(last)))
    for name, (before, after) in template.marks.items():
        out = F.when(role == name, F.array(part(F.lit(before)), body, part(F.lit(after)))).otherwise(out)
    return out


def write_chats(convs: DataFrame, path: str, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> None:
    """Format all conversations: (conv_id, at, role, segments), in order."""
    rows = ordered(convs, conv_col, turn_col, role_col, text_col)
    (rows.select("conv_id", "at", "role", segments(F.col("role"), F.col("text"), template).alias("segments"))
     .write.parquet(path))


def _pattern(marks: list[str]) -> str:
    return "|".join("".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in m) for m in marks)


def read_chats(spark: SparkSession, path: str, template: Template = DEFAULT) -> DataFrame:
    """Turns parsed from the formatted text: (conv_id, at, role, text, formatted, learned), `learned`
    being the unescaped text under the loss mask. A turn that is not of the template's form is an error."""
    rows = spark.read.parquet(path)
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    learned = unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    pattern = _pattern(template.all_marks())
    marks, between = F.regexp_extract_all("formatted", F.lit(pattern), F.lit(0)), F.split("formatted", pattern, -1)
    # Nothing stands outside the marks, and the marks are those of one turn.
    role = F.when(F.expr("marks = array({})".format(", ".join(_quoted(m) for m in template.other)))
                  & (F.get("between", F.lit(0)) == "") & (F.get("between", F.lit(3)) == ""), unescaped(F.get("between", F.lit(1))))
    text = F.get("between", F.lit(2))
    for name, pair in template.marks.items():
        fits = (F.expr("marks = array({}, {})".format(*map(_quoted, pair))) & (F.get("between", F.lit(0)) == "")
                & (F.get("between", F.lit(2)) == ""))
        role, text = F.when(fits, F.lit(name)).otherwise(role), F.when(fits, F.get("between", F.lit(1))).otherwise(text)
    parsed = (rows.select("conv_id", "at", formatted.alias("formatted"), learned.alias("learned"))
              .select("*", marks.alias("marks"), between.alias("between")))
    sound = F.coalesce(role, F.raise_error(F.concat(F.lit("not a turn: "), F.col("formatted"))).cast("string"))
    return parsed.select("conv_id", "at", sound.alias("role"), unescaped(text).alias("text"), "formatted", "learned")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def documents(turns: DataFrame) -> DataFrame:
    """(conv_id, text, loss) of `read_chats` rows or the written table: whole conversations as one text, for
    those that fit a row, with the spans (start, end) under the loss mask in code points."""
    pieces = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "segments"))), lambda r: r["segments"]))
    whole = turns.groupBy("conv_id").agg(pieces.alias("p"))
    step = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
                       lambda a, s: F.struct((a["at"] + F.length(s["text"])).alias("at"), F.when(s["loss"], F.concat(a["spans"], F.array(F.struct(
                           a["at"].alias("start"), (a["at"] + F.length(s["text"])).alias("end"))))).otherwise(a["spans"]).alias("spans")),
                       lambda a: a["spans"])
    return whole.select("conv_id", F.array_join(F.transform("p", lambda s: s["text"]), "").alias("text"), step.alias("loss"))


def _put_together(blocks: Column, n_states: int) -> Column:
    """What an ordered array of blocks does, as one block.

    A block is (n, next, bad): its turns, the state it leads each state to (-1: none) and the number of
    the first turn without a move for it (null: none)."""
    def after(a: Column, b: Column) -> Column:
        reached = F.transform(a["next"], lambda s: F.when(s >= 0, F.get(b["next"], s)).otherwise(-1))
        bad = F.transform(F.arrays_zip(a["next"], a["bad"]), lambda z: F.coalesce(
            z["bad"], F.when(z["next"] >= 0, a["n"] + F.get(b["bad"], F.greatest(z["next"], F.lit(0))))))
        return F.struct((a["n"] + b["n"]).alias("n"), reached.alias("next"), bad.alias("bad"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.array(*[F.lit(i) for i in range(n_states)]).alias("next"),
                    F.array_repeat(F.lit(None).cast("long"), n_states).alias("bad"))
    return F.aggregate(blocks, none, after)


def validated(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, n_turns, valid, bad_turn) of turns (conv_id, at, role): `bad_turn` is the first turn, from
    1, that the machine has no move for; a conversation is valid if there is none and it ends in a
    final state.

    Blocks of 4,096 turns, then of as many blocks, are put together before whole conversations are.
    """
    states = template.states()
    number = {s: i for i, s in enumerate(states)}
    nowhere = F.array(*[F.lit(-1)] * len(states))
    step = nowhere
    for role in dict.fromkeys(r for _, r in template.moves):
        to = [number.get(template.moves.get((s, role), ""), -1) for s in states]
        step = F.when(F.col("role") == role, F.array(*[F.lit(i) for i in to])).otherwise(step)
    block = turns.select("conv_id", "at", F.struct(
        F.lit(1).cast("long").alias("n"), step.alias("next"),
        F.transform(step, lambda s: F.when(s < 0, F.lit(1).cast("long"))).alias("bad")).alias("block"))
    for keys in (["conv_id", "at"], ["conv_id", "at"], ["conv_id"]):
        shifted = F.shiftright("at", BLOCK_BITS) if len(keys) > 1 else F.lit(0).cast("long")
        block = (block.select("conv_id", F.col("at").alias("_before"), shifted.alias("at"), "block").groupBy(*keys)
                 .agg(_put_together(F.transform(F.array_sort(F.collect_list(F.struct("_before", "block"))), lambda b: b["block"]),
                                    len(states)).alias("block")))
    reached = F.get("block.next", F.lit(0))
    bad = F.get("block.bad", F.lit(0))
    return block.select("conv_id", F.col("block.n").alias("n_turns"),
                        reached.isin(*[number[s] for s in template.ends]).alias("valid"), bad.alias("bad_turn"))


#: What the query adds to the table: marks as texts.
SAID = "</s>[INST] ok [/INST]"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations written, read back and digested. SHA-256 of a whole conversation needs its text in
    one value, so the digests gather each conversation."""
    convs = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    path = fresh_folder(spark, "chats")
    write_chats(convs.unionByName(more), path)
    turns = read_chats(spark, path)
    said = F.transform(F.array_sort(F.collect_list(F.struct("at", "role", "text", "learned"))),
                       lambda r: F.struct(F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n")).alias("turn"), r["learned"].alias("learned")))
    gathered = turns.groupBy("conv_id").agg(said.alias("said"), F.sum(F.length("formatted")).alias("formatted_chars"))
    turn, learned = F.array_join("said.turn", ""), F.array_join("said.learned", "")
    digests = gathered.select("conv_id", F.sha2(turn, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
                              F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")
    checked = validated(turns).withColumnRenamed("conv_id", "_conv")
    return (digests.join(checked, F.col("conv_id").eqNullSafe(F.col("_conv")))
            .select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "bad_turn"))


def _sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    t = DEFAULT
    text = f"replace(text, {quoted(ESCAPE)}, {quoted(ESCAPE * 2)})"
    role = f"replace(role, {quoted(ESCAPE)}, {quoted(ESCAPE * 2)})"
    for m in t.all_marks():
        broken = quoted(m[0] + ESCAPE + m[1:])
        text, role = f"replace({text}, {quoted(m)}, {broken})", f"replace({role}, {quoted(m)}, {broken})"
    cases = " ".join(f"WHEN {quoted(r)} THEN {sum(map(len, pair))}" for r, pair in t.marks.items())
    learn = ", ".join(map(quoted, t.learn))
    # Each role of the default machine leads to one state, so the role before tells the state.
    into = {r: s for (_, r), s in t.moves.items()}
    after = {s: [r for r, to in into.items() if to == s] for s in t.states()}
    allowed = ", ".join(f"({quoted(b)}, {quoted(r)})" for (s, r) in t.moves for b in (["-"] if s == t.start else after[s]))
    ends = ", ".join(quoted(r) for s in t.ends for r in after[s])
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', {quoted(SAID)} UNION ALL SELECT -1, 1, 'assistant', {quoted(SAID)}),
o AS (SELECT *, row_number() OVER w AS pos, lag(role, 1, '-') OVER w AS before FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role)),
s AS (SELECT *, CASE role {cases} ELSE {sum(map(len, t.other))} + length({role}) END + length({text}) AS chars,
             CASE WHEN (before, role) NOT IN ({allowed}) THEN pos END AS bad FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role IN ({learn})), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role IN ({learn})), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       min(bad) IS NULL AND arg_max(role, pos) IN ({ends}) AS valid, min(bad) AS bad_turn
FROM s GROUP BY conv_id
"""


SQL = _sql()
