"""Candidate finding for library review: stale, thin, unlinked, duplicated, misfiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import front_matter as fm
from loomlog.functions.arrays import explode_rows, keep_computed
from loomlog.functions.titles import normalize_cwd
from loomlog.plans.key_filter import KeyFilter
from loomlog.session import saved

# Accepted front matter.
TTLS = ("2w", "3mo", "1y", "stable")
ARTICLE_SCOPES = ("private", "work", "both")
REQUIRED = ("title", "scope", "ttl", "created", "updated", "sources")
# Words below which an article is thin: both is strict, work moderate, private lenient.
THIN_WORDS = {"both": 200, "work": 120, "private": 60}
FEW_BULLETS = 3
SHARE_CATEGORIES = ("patterns", "decisions")
MIN_CLUSTER = 3


def _by_brain(values: dict[str, int]) -> Column:
    out = None
    for brain, value in values.items():
        hit = F.col("brain") == brain
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(min(values.values()))


def stale_articles(catalog: DataFrame, today: str) -> DataFrame:
    """Articles whose time to live ran out before `today` (YYYY-MM-DD)."""
    return (catalog.filter(F.col("expires") < F.lit(today).cast("date"))
            .select("brain", "path", "ttl", "updated", "expires", F.lit("needs_review").alias("status")))


def thin_articles(catalog: DataFrame, limits: dict[str, int] = THIN_WORDS) -> DataFrame:
    """Articles with few words for their library, or not more than a few bullets and twice
    that many words."""
    measured = (catalog.withColumn("_body", fm.article_body(F.col("content")))
                .withColumn("words", F.regexp_count("_body", F.lit(r"\S+")))
                .withColumn("bullets", F.regexp_count("_body", F.lit(r"(?m)^[-*] ")))
                .withColumn("_limit", _by_brain(limits)))
    thin = (F.col("words") < F.col("_limit")) | (F.col("bullets").between(1, FEW_BULLETS)
                                                 & (F.col("words") < 2 * F.col("_limit")))
    return keep_computed(measured, thin, ["brain", "path"], ["words", "bullets"])


def person_data_hits(catalog: DataFrame) -> DataFrame:
    """E-mail and phone spans per article; articles without any are left out."""
    counted = (catalog.withColumn("_body", fm.article_body(F.col("content")))
               .withColumn("emails", fm.email_hits(F.col("_body")))
               .withColumn("phones", fm.phone_hits(F.col("_body"))))
    return keep_computed(counted, F.col("emails") + F.col("phones") > 0, ["brain", "path"], ["emails", "phones"])


def share_review(catalog: DataFrame) -> DataFrame:
    """Proposed share decision: strip, confirm, candidate or keep."""
    hits = F.col("_hits") > 0
    counted = (catalog.withColumn("_body", fm.article_body(F.col("content")))
               .withColumn("_hits", fm.email_hits(F.col("_body")) + fm.phone_hits(F.col("_body"))))
    private = F.col("brain") == "private"
    decision = (F.when(F.col("share") & (hits | private), "strip").when(F.col("share"), "confirm")
                .when(F.col("category").isin(*SHARE_CATEGORIES) & ~hits & ~private, "candidate").otherwise("keep"))
    return counted.select("brain", "path", decision.alias("decision"))


def front_matter_lint(catalog: DataFrame) -> DataFrame:
    """One row per broken rule: missing keys, values out of range, bad or reversed dates,
    scope other than the library's, slug not in kebab case."""
    def present(name):
        if name == "sources":
            return F.size("sources") > 0
        return F.col({"created": "created_text", "updated": "updated_text"}.get(name, name)).isNotNull()

    checks = [F.when(~present(k), F.lit(f"missing_{k}")) for k in REQUIRED]
    checks += [
        F.when(~fm.first_word(F.col("ttl")).isin(*TTLS), F.lit("bad_ttl")),
        F.when(~F.col("scope").isin(*ARTICLE_SCOPES), F.lit("bad_scope")),
        F.when(F.col("scope").isin(*ARTICLE_SCOPES) & (F.col("scope") != F.col("brain")), F.lit("scope_not_store")),
        F.when(F.col("created_text").isNotNull() & F.col("created").isNull(), F.lit("bad_created")),
        F.when(F.col("updated_text").isNotNull() & F.col("updated").isNull(), F.lit("bad_updated")),
        F.when(F.col("created") > F.col("updated"), F.lit("created_after_updated")),
        F.when(~fm.slug_valid(F.col("stem")), F.lit("bad_slug")),
    ]
    return explode_rows(catalog, ["brain", "path"], F.array_compact(F.array(*checks)), "violation")


# ---- links ----

def link_edges(catalog: DataFrame) -> DataFrame:
    """Distinct edges (brain, path, target, kind) from `[[slug]]` links and `related` lists."""
    wiki = F.transform(fm.wiki_links(fm.article_body(F.col("content"))),
                       lambda s: F.struct(s.alias("target"), F.lit("wiki").alias("kind")))
    related = F.transform(F.array_distinct("related"),
                          lambda s: F.struct(s.alias("target"), F.lit("related").alias("kind")))
    return (explode_rows(catalog, ["brain", "path"], F.concat(wiki, related), "_e")
            .select("brain", "path", "_e.target", "_e.kind"))


def link_targets(catalog: DataFrame) -> DataFrame:
    """One row per (brain, stem): how many articles bear it and the one a link means."""
    return (catalog.groupBy("brain", F.col("stem").alias("target"))
            .agg(F.count(F.lit(1)).alias("n_articles"), F.min("path").alias("target_path")))


def link_graph(catalog: DataFrame) -> DataFrame:
    """Edges with the article they lead to; target_path NULL marks a dangling link. Targets
    are summarised per stem before the join, so output is one row per edge."""
    return (link_edges(catalog).join(link_targets(catalog), ["brain", "target"], "left")
            .withColumn("n_articles", F.coalesce("n_articles", F.lit(0))))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _run_hashes(words: Column) -> list[Column]:
    """Hashes of all word runs of one, two and three words, as arrays by start; positions too
    near the end hold NULL."""
    rest = F.greatest(F.size(words), F.lit(1))
    ones = F.transform(words, lambda a: F.xxhash64(a))
    twos = F.zip_with(words, F.slice(words, 2, rest), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    threes = F.zip_with(twos, F.slice(words, 3, rest), lambda h, c: F.when(c.isNotNull(), F.xxhash64(h, c)))
    return [ones, twos, threes]


def _title_keys(titles: DataFrame) -> DataFrame:
    """Adds _key: the hash of a title's words, or of its rarest three-word run when it has
    three or more, so that titles with a common beginning do not share a key."""
    ones, twos, threes = _run_hashes(F.split(F.col("title"), " "))
    runs = explode_rows(titles, ["brain", "title"], F.array_distinct(F.array_compact(threes)), "_key")
    shared = runs.groupBy("brain", "_key").agg(F.count(F.lit(1)).alias("n"))
    rarest = (runs.join(shared, ["brain", "_key"]).groupBy("brain", "title")
              .agg(F.min(F.struct("n", "_key")).alias("_r")).select("brain", "title", "_r._key"))
    short = F.coalesce(F.get(twos, F.lit(0)), F.get(ones, F.lit(0)))
    return (titles.withColumn("_short", short).join(rarest, ["brain", "title"], "left")
            .withColumn("_key", F.coalesce("_key", "_short")).drop("_short"))


def _runs_like(titles: DataFrame, words: DataFrame) -> DataFrame:
    """(brain, path, _key) of the word runs of each body that may be a title's key. Only lengths that
    keys have are hashed, and what cannot be a key is dropped within the row: the rows that are shuffled
    grow with what is found, not with the bodies."""
    told = titles.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.least(F.size(F.split("title", " ")), F.lit(3))).alias("lengths")).first()
    keys = KeyFilter(titles, "_key", told["n"])
    runs = [r for n, r in enumerate(_run_hashes(F.col("_w")), 1) if n in told["lengths"]]
    if not runs:
        runs = [F.array().cast("array<bigint>")]
    hits = F.array_distinct(F.filter(F.concat(*runs), keys.may_hold))
    return explode_rows(words, ["brain", "path"], hits, "_key")


def missing_backlinks(catalog: DataFrame) -> DataFrame:
    """Articles that hold another article's title as a run of words but do not link to it.

    Titles are grouped by their words; a title is looked up by a hash of up to three of its
    words among the word runs of every body: an equi-join on a number. What it finds is then
    checked in the text itself. One row per (article, title): brain, path, title,
    n_articles, target_path.
    """
    # Titles and links are read several times, so they are taken out of the texts once.
    narrow = saved(catalog.select(
        "brain", "path", "stem", F.array_join(_tokens(F.col("title")), " ").alias("title"),
        F.concat(fm.wiki_links(fm.article_body(F.col("content"))), "related").alias("targets")), "titles-links")
    named = narrow.filter("title <> ''").select("brain", "path", "stem", "title")
    titles = saved(_title_keys(named.groupBy("brain", "title").agg(F.count(F.lit(1)).alias("n_articles"),
                                                                   F.min("path").alias("target_path"))), "title-keys")
    words = catalog.select("brain", "path", _tokens(fm.article_body(F.col("content"))).alias("_w"))
    found = _runs_like(titles, words).join(titles, ["brain", "_key"]).drop("_key")
    # A link means one article, so it names one title.
    named_by_stem = (named.groupBy("brain", F.col("stem").alias("target"))
                     .agg(F.min(F.struct("path", "title")).alias("_m")).select("brain", "target", "_m.title"))
    links = explode_rows(narrow, ["brain", "path"], F.array_distinct("targets"), "target")
    linked = links.join(named_by_stem, ["brain", "target"]).select("brain", "path", "title")
    own = named.select("brain", "path", "title")
    unlinked = found.join(linked.unionByName(own), ["brain", "path", "title"], "left_anti")
    spaced = words.select("brain", "path", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_s"))
    return (unlinked.join(spaced, ["brain", "path"])
            .filter(F.contains(F.col("_s"), F.concat(F.lit(" "), F.col("title"), F.lit(" ")))).drop("_s"))


# ---- provenance ----

def source_uses(catalog: DataFrame) -> DataFrame:
    """Distinct (brain, path, session_id) from the `sources` lists."""
    return explode_rows(catalog, ["brain", "path"], F.array_distinct("sources"), "session_id")


def article_provenance(catalog: DataFrame, sessions: DataFrame) -> DataFrame:
    """Articles per session: `used`, `unused` (no article cites it) or `orphan` (cited, but no
    such session). Uses are counted before the join."""
    counts = source_uses(catalog).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_articles"))
    known = sessions.select("session_id").distinct().withColumn("_known", F.lit(True))
    state = F.when(F.col("_known").isNull(), "orphan").when(F.col("n_articles").isNull(), "unused").otherwise("used")
    return (counts.join(known, "session_id", "full_outer")
            .select("session_id", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), state.alias("state")))


def project_clusters(catalog: DataFrame, sessions: DataFrame, least: int = MIN_CLUSTER) -> DataFrame:
    """Projects with several articles outside their folder. An article belongs to the projects
    (last folder of the working directory) of the sessions it cites."""
    project = F.substring_index(F.rtrim(normalize_cwd(F.col("cwd")), F.lit("/")), "/", -1)
    homes = sessions.select("session_id", F.lower(project).alias("project")).filter("project <> ''")
    loose = (source_uses(catalog).join(homes, "session_id").select("brain", "path", "project").distinct()
             .filter(~F.contains(F.col("path"), F.concat(F.lit("projects/"), F.col("project"), F.lit("/")))))
    return (loose.groupBy("brain", "project").agg(F.count(F.lit(1)).alias("n_articles"))
            .filter(F.col("n_articles") >= least))
