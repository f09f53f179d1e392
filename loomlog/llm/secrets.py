"""Secrets in texts, and how widely each is copied: patterns and frequencies as column expressions.

A span is a whole match, in code points, end exclusive. Matches are leftmost and do not overlap
within their kind; those that are too short are dropped after matching. Beside the base kinds the
method marks the value of every `assign` and `access` match once more by its ownership over the whole
corpus: kind `copied` when more than `owners` distinct owners hold it, kind `owned` when fewer do and it
looks live (upper and lower case letters or letters and digits mixed, at least `distinct` different
characters). Frequencies count each owner and each (owner, repository) once, however many rows repeat it.

Nulls: a null text is the empty text; null owners and repositories count as one owner or repository
of their own. Null ids and repeated rows are kept. An empty table gives no rows. Columns other than the
named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomlog.llm.common import pick, table, text_of
from loomlog.session import saved

# Kinds in the order of the contract, pattern, group that is the value, least length.
KINDS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
]
# The same texts as matches of the last two kinds that are long enough: a run that is too short has no
# longer run inside.
LONG = {"access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}


OWNERS, DISTINCT = 2, 8


def pieces(text: Column, kind: str, rank: int, distinct: int) -> Column:
    """Array of one struct per match of a kind, in order; null where there is none.

    split() gives the text between matches, so `gap` and `size` add up to where a match ends. Only
    lengths, a hash of the value and whether it looks live leave the text.
    """
    _, pattern, group, least = next(k for k in KINDS if k[0] == kind)
    pattern = LONG.get(kind, pattern)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.transform(F.sequence(F.lit(1), F.size(whole)), lambda i: F.struct(
        F.lit(rank).alias("rank"), i.alias("pos"), F.element_at(gaps, i).alias("gap"),
        F.length(F.element_at(whole, i)).alias("size"), F.length(F.element_at(value, i)).alias("value_size"),
        F.when(F.length(F.element_at(value, i)) >= least, F.sha2(F.element_at(value, i), 256)).alias("secret"),
        _live(F.element_at(value, i), distinct).alias("live")))
    return F.when(text.rlike(pattern), rows)


def _live(value: Column, distinct: int) -> Column:
    """Looks like a live credential: mixed classes of characters and enough different ones."""
    mixed = (value.rlike("[0-9]") & value.rlike("[A-Za-z]")) | (value.rlike("[a-z]") & value.rlike("[A-Z]"))
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= distinct)


def ownership(candidates: DataFrame) -> DataFrame:
    """(secret, n_owners, n_repos, n_rows) of (secret, owner, repo) rows. Each step sums before it
    shuffles, so a secret that fills the corpus costs a row per task."""
    pairs = candidates.groupBy("secret", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("secret", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("secret").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang",
         owners: int = OWNERS, distinct: int = DISTINCT) -> DataFrame:
    """(doc_id, found) of every row, found an array of (start, rank, end, kind, secret, n_owners,
    n_repos), in order of start, then kind; `secret` is the hash of the value.

    One pass over the texts leaves a narrow table; rows without a match are not shuffled.
    """
    rows = pick(docs, id_col, text_col, owner_col, repo_col).toDF("doc_id", "text", "owner", "repo")
    text = text_of("text")
    empty = F.array().cast("array<struct<rank:int,pos:int,gap:int,size:int,value_size:int,secret:string,live:boolean>>")
    kinds = [F.coalesce(pieces(text, k[0], rank, distinct), empty) for rank, k in enumerate(KINDS)]
    narrow = saved(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", F.concat(*kinds).alias("m")), "secrets")

    each = narrow.filter(F.size("m") > 0).select("row", "doc_id", "owner", "repo", F.explode("m").alias("m")).select("row", "doc_id", "owner", "repo", "m.*")
    so_far = Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = (each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
              .withColumn("start", F.col("end") - F.col("size")))
    long = F.col("secret").isNotNull()
    counts = ownership(each.filter(long).select("secret", "owner", "repo"))
    known = placed.filter(long).join(counts, "secret")
    fields = ["n_owners", "n_repos"]
    base = F.struct("start", "rank", "end", F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("rank") + 1).alias("kind"), "secret", *fields)
    wide = F.col("n_owners") > owners
    more = F.struct((F.col("end") - F.col("value_size")).alias("start"), F.when(wide, len(KINDS) + 1).otherwise(len(KINDS)).alias("rank"), "end",
                    F.when(wide, "copied").otherwise("owned").alias("kind"), "secret", *fields)
    credential = (F.col("rank") != [k[0] for k in KINDS].index("hex")) & (wide | F.col("live"))
    spans = (known.select("row", F.explode(F.when(credential, F.array(base, more)).otherwise(F.array(base))).alias("s"))
             .groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("found")))
    some = narrow.filter(F.size("m") > 0).select("row", "doc_id").join(spans, "row", "left").select("doc_id", "found")
    none = narrow.filter(F.size("m") == 0).select("doc_id", F.lit(None).alias("found"))
    return some.unionByName(none).withColumn("found", F.coalesce("found", F.array().cast(some.schema["found"].dataType)))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base digest and all spans of every document."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["rank"] < len(KINDS))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k[0]) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    def kind(rank: int) -> str:
        name, pattern, group, least = KINDS[rank]
        p = "'" + LONG.get(name, pattern).replace("'", "''") + "'"
        return f"""SELECT r, {rank} AS rank, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS whole, unnest(v) AS val,
            unnest(g[1:len(w)]) AS gap, {least} AS least
            FROM (SELECT r, regexp_extract_all(t, {p}) AS w, regexp_extract_all(t, {p}, {group}) AS v,
                         string_split_regex(t, {p}) AS g FROM d WHERE regexp_matches(t, {p}))"""

    names = ", ".join(f"'{k[0]}'" for k in KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
m AS ({" UNION ALL ".join(kind(i) for i in range(len(KINDS)))}),
p AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY r, rank ORDER BY pos) AS e FROM m),
k AS (SELECT p.*, source, lang FROM p JOIN d USING (r) WHERE length(val) >= least),
o AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) AS n FROM k GROUP BY val),
s AS (SELECT r, rank, [{names}][rank + 1] AS kind, e - length(whole) AS b, e FROM k
      UNION ALL
      SELECT r, CASE WHEN n > {OWNERS} THEN {len(KINDS) + 1} ELSE {len(KINDS)} END, CASE WHEN n > {OWNERS} THEN 'copied' ELSE 'owned' END,
             e - length(val), e FROM k JOIN o USING (val)
      WHERE rank <> 2 AND (n > {OWNERS} OR (len(list_distinct(string_split(val, ''))) >= {DISTINCT}
            AND ((regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]')) OR (regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')))))),
j AS (SELECT r, string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, rank) AS spans,
             coalesce(string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY b, rank) FILTER (rank < {len(KINDS)}), '') AS base,
             count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex
      FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)
"""


SQL = _sql()
