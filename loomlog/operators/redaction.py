"""Redaction of whole tables, its audit, and allowlisted findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.arrays import explode_rows, keep_computed
from loomlog.functions.redaction import DEFAULT_RULES, Rule, apply_rule, may_match, redact

# Findings that are no secrets.
ALLOW_PATHS = (r"raw/logs/.*\.jsonl$",)
ALLOW_VALUES = (r"SHA256:[A-Za-z0-9+/]{43}",)


def redact_table(df: DataFrame, cols: Sequence[str], rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Redact the named text columns; pass `DEFAULT_RULES + extra` to add rules."""
    return df.withColumns({c: redact(F.col(c), rules) for c in cols})


def redaction_hits(df: DataFrame, col: str, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Adds `hits`, the matches of each rule in order, each on the text left by earlier rules. Texts without
    any rule's literal are dropped: they cannot count.

    The rules are steps over one (text, hits) value, so the plan grows by one step a rule and no generated
    method holds them all.
    """
    def step(rule: Rule):
        return lambda s: F.struct(apply_rule(s["text"], rule).alias("text"),
                                  F.concat(s["hits"], F.array(F.regexp_count(s["text"], F.lit(rule.java)))).alias("hits"))

    state = F.array(F.struct(F.col(col).alias("text"), F.array().cast("array<int>").alias("hits")))
    for rule in rules:
        state = F.transform(state, step(rule))
    kept = keep_computed(df, may_match(F.col(col), rules), [c for c in df.columns if c != col], [col])
    return kept.withColumn("hits", F.get(state, F.lit(0))["hits"])


def redaction_audit(df: DataFrame, col: str, by: Sequence[str], rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Hits per rule and group (by.., ord, label, hits), zero rows left out."""
    rows = explode_rows(redaction_hits(df, col, rules), list(by), "hits", "_n", pos="_at").filter("_n > 0")
    labels = F.array(*[F.lit(r.label) for r in rules])
    return (rows.groupBy(*by, "_at").agg(F.sum("_n").alias("hits"))
            .select(*by, (F.col("_at") + 1).alias("ord"), F.get(labels, F.col("_at")).alias("label"), "hits"))


def findings(df: DataFrame, col: str, keys: Sequence[str], rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Every match of every rule on the raw text (keys.., label, value)."""
    x = F.col(col)

    def hits(rule):
        all_hits = F.regexp_extract_all(x, F.lit(rule.java), F.lit(0))
        labelled = F.transform(all_hits, lambda v: F.struct(F.lit(rule.label).alias("label"), v.alias("value")))
        return F.when(may_match(x, (rule,)), labelled)

    rows = F.flatten(F.array_compact(F.array(*[hits(r) for r in rules])))
    return (explode_rows(df.filter(may_match(x, rules)), list(keys), rows, "_f")
            .select(*keys, "_f.label", "_f.value"))


def allowlist_filter(found: DataFrame, paths: Sequence[str] = ALLOW_PATHS,
                     values: Sequence[str] = ALLOW_VALUES) -> DataFrame:
    """Findings that no allowlist pattern covers. The lists come from a config file, so each
    is tested as an expression."""
    out = found
    for col, patterns in (("path", paths), ("value", values)):
        for pattern in patterns:
            out = out.filter(~F.coalesce(F.col(col).rlike(pattern), F.lit(False)))
    return out
