"""Article catalog, index, table of contents and prompt context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import front_matter as fm
from loomlog.functions.titles import token_estimate
from loomlog.plans.ordered import range_chunks, running_sum

INLINE_CAP = 25
LINK_MARK = "—"

# Fixed texts of the output format: title, note and the text of an empty library.
TITLE = "# Library — curated knowledge index"


def exclude_generated(articles: DataFrame, root: str = fm.LIBRARY_ROOT) -> DataFrame:
    """Drop the index and changelog at the library root; nested files of that name stay."""
    return articles.filter(~fm.is_generated(fm.display_path(F.col("path"), root)))


def parse_articles(articles: DataFrame, root: str = fm.LIBRARY_ROOT, strict_share: bool = False,
                   compat: bool = False) -> DataFrame:
    """Adds the typed front matter of each article (needs path, content).

    `compat` reads title, ttl and updated anywhere in the file and lets an empty value take
    the next line.
    """
    block = F.col("_fm")

    def read(name):
        return fm.field_anywhere(F.col("content"), name) if compat else fm.field(block, name)

    rel = fm.display_path(F.col("path"), root)
    return (articles
            .withColumn("content", fm.unix_newlines(F.col("content")))
            .withColumn("_fm", fm.front_matter(F.col("content")))
            .withColumn("rel", rel)
            .withColumn("category", fm.article_category(F.col("rel")))
            .withColumn("stem", fm.article_stem(F.col("path")))
            .withColumn("title", read("title")).withColumn("ttl", read("ttl"))
            .withColumn("scope", fm.field(block, "scope")).withColumn("status", fm.field(block, "status"))
            .withColumn("created_text", fm.field(block, "created")).withColumn("updated_text", read("updated"))
            .withColumn("created", F.try_to_date(F.col("created_text"), "yyyy-MM-dd"))
            .withColumn("updated", F.try_to_date(F.col("updated_text"), "yyyy-MM-dd"))
            .withColumn("sources", fm.list_field(block, "sources"))
            .withColumn("related", fm.list_field(block, "related"))
            .withColumn("share", fm.share_flag(block, strict_share))
            .withColumn("expires", fm.ttl_expiry(F.col("updated"), F.col("ttl")))
            .drop("_fm"))


def field_defaults(catalog: DataFrame) -> DataFrame:
    """Missing title -> file stem; missing ttl and date -> `?`."""
    return (catalog.withColumn("title", F.coalesce("title", "stem"))
            .withColumn("ttl", F.coalesce("ttl", F.lit("?")))
            .withColumn("updated_text", F.coalesce("updated_text", F.lit("?"))))


def shareable(catalog: DataFrame) -> DataFrame:
    return catalog.filter("share")


def _entry(link: Column, ttl: Column, updated: Column) -> Column:
    return F.concat(link, F.lit(f" {LINK_MARK} ttl:"), ttl, F.lit(", updated:"), updated)


NOTE = "*Machine-maintained. Edit articles, not this file.*"
NOTHING = "_Empty — no articles yet._"


def library_index(catalog: DataFrame, regenerated: str, first_token: bool = False, title: str = TITLE,
                  note: str = NOTE, empty: str = NOTHING, brains: DataFrame | None = None) -> DataFrame:
    """Index documents as ordered lines (brain, part, category, stem, path, line).

    Part 0 is the head, 1 the category headings, 2 the articles below them, 3 the blank line
    after a category; sorted by `INDEX_ORDER` the lines are the document. One line per
    article, so a library of any size is written by a distributed sort. `brains` lists
    libraries that may be empty and still need an index.
    """
    counts = catalog.groupBy("brain").agg(F.count(F.lit(1)).alias("n"))
    return index_heads(counts, regenerated, title, note, empty, brains).unionByName(index_sections(catalog, first_token))


def index_sections(catalog: DataFrame, first_token: bool = False) -> DataFrame:
    """The lines of an index below its head; those of a category depend on its articles only."""
    filled = field_defaults(catalog)
    ttl, updated = F.col("ttl"), F.col("updated_text")
    if first_token:
        ttl, updated = fm.first_word(ttl), fm.first_word(updated)
    link = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("rel"), F.lit(")"))
    items = filled.select("brain", F.lit(2).alias("part"), "category", "stem", "path",
                          _entry(link, ttl, updated).alias("line"))
    none = F.lit("")
    frame = F.array(F.struct(F.lit(1).alias("part"), F.concat(F.lit("## "), F.col("category"), F.lit("\n")).alias("line")),
                    F.struct(F.lit(3).alias("part"), none.alias("line")))
    headings = (catalog.select("brain", "category").distinct().select("brain", "category", F.inline(frame))
                .select("brain", "part", "category", none.alias("stem"), none.alias("path"), "line"))
    return headings.unionByName(items)


def index_heads(counts: DataFrame, regenerated: str, title: str = TITLE, note: str = NOTE, empty: str = NOTHING,
                brains: DataFrame | None = None) -> DataFrame:
    """The head of each index; counts: (brain, n) articles."""
    none = F.lit("")
    if brains is not None:
        counts = (brains.select("brain").distinct().join(counts, "brain", "left")
                  .withColumn("n", F.coalesce("n", F.lit(0))))
    head = F.concat(F.lit(f"{title}\n\n_Last regenerated: {regenerated}_\n_Article count: "),
                    F.col("n").cast("string"), F.lit(f"_\n\n{note}\n"),
                    F.when(F.col("n") == 0, F.lit(f"\n{empty}")).otherwise(""))
    return counts.select("brain", F.lit(0).alias("part"), none.alias("category"), none.alias("stem"),
                         none.alias("path"), head.alias("line"))


# The head has no category and comes first by itself.
INDEX_ORDER = ("category", "part", "stem", "path")


def library_toc(catalog: DataFrame) -> DataFrame:
    """One line per article (brain, path, line); in path order they are the contents list."""
    return field_defaults(catalog).select("brain", "path", _toc_line().alias("line"))


def _toc_line() -> Column:
    link = F.concat(F.lit("- `"), F.col("path"), F.lit(f"` {LINK_MARK} **"), F.col("title"), F.lit("** (ttl:"))
    return F.concat(link, F.col("ttl"), F.lit(", updated:"), F.col("updated_text"), F.lit(")"))


def article_counts(catalog: DataFrame) -> DataFrame:
    """(brain, n_articles); one row per library, and libraries are the configured stores."""
    return catalog.groupBy("brain").agg(F.count(F.lit(1)).alias("n_articles"))


def inline_cap(catalog: DataFrame, cap: int = INLINE_CAP) -> DataFrame:
    """Whether a library is small enough to be put into a prompt in full."""
    return article_counts(catalog).withColumn("inlined", F.col("n_articles") <= cap)


def compile_context(catalog: DataFrame, sessions: DataFrame, cap: int = INLINE_CAP) -> DataFrame:
    """Prompt input as ordered sections (brain, session_file, section, item, text, inlined).

    What all sessions of a library share (contents list, article texts, the notice) is stored
    once with session_file NULL; a session adds only its own section. A prompt is its library's
    shared sections followed by its own: nothing is multiplied by the number of sessions.
    Sections: 1 contents, 2 articles, 3 session. All articles are there; `inlined` is false for
    the texts of libraries over `cap` articles, which a prompt leaves out for the notice.

    sessions: brain, session_file, seq, text (the narrative lines of pending sessions).
    """
    shared_key = F.lit(None).cast("string").alias("session_file")
    counts = inline_cap(catalog, cap)
    f = field_defaults(catalog)
    full = F.concat(F.lit("### "), F.col("path"), F.lit("\n\n"), F.col("content"))
    pair = F.array(F.struct(F.lit(1).alias("section"), F.col("path").alias("item"), _toc_line().alias("text"), F.lit(True).alias("inlined")),
                   F.struct(F.lit(2).alias("section"), F.col("path").alias("item"), full.alias("text"), F.col("inlined")))
    # One row per library: joined where the texts are read, so that no task gets all texts of a library.
    articles = f.join(F.broadcast(counts), "brain").select("brain", shared_key, F.inline(pair))
    state = sessions.select("brain").distinct().join(counts, "brain", "left")
    many = F.concat(F.lit("(This library has "), F.col("n_articles").cast("string"), F.lit(" articles; see them by path.)"))
    said = F.array_compact(F.array(
        F.when(F.col("n_articles").isNull(), F.struct(F.lit(1).alias("section"), F.lit("(the library is empty)").alias("text"))),
        F.when(F.coalesce(~F.col("inlined"), F.lit(True)), F.struct(
            F.lit(2).alias("section"), F.when(F.col("n_articles").isNull(), "(the library is empty)").otherwise(many).alias("text")))))
    notices = state.select("brain", F.inline(said)).select("brain", shared_key, "section", F.lit("").alias("item"), "text", F.lit(True).alias("inlined"))
    own = sessions.select("brain", "session_file", F.lit(3).alias("section"),
                          F.lpad(F.col("seq").cast("string"), 20, "0").alias("item"), "text", F.lit(True).alias("inlined"))
    return articles.unionByName(notices).unionByName(own)


#: Tokens of a chunk of a review.
REVIEW_BUDGET = 60_000


def review_context(catalog: DataFrame, today: str, brains: DataFrame | None = None, budget: int = REVIEW_BUDGET) -> DataFrame:
    """Review input as ordered sections (brain, section, category, chunk, item, text, tokens): 0 head,
    1 contents lines, 2 one row per article in full.

    The texts of a category are cut into chunks of about `budget` tokens by a running sum in
    path order. `brains` names libraries that may have no articles: their head says so.
    """
    none = F.lit("").alias("category")
    full = F.concat(F.lit("### "), F.col("path"), F.lit("\n\n"), F.regexp_replace("content", r"(?U)\s+\z", ""))
    # Only the sizes are put in order, by ranges of all items, so a category may have any share of them.
    sizes = range_chunks(catalog.select("brain", "category", F.col("path").alias("item"), token_estimate(full).alias("tokens")), ["brain", "category", "item"])
    placed = running_sum(sizes, ["brain", "category"], ["item"], F.col("tokens"), "_so_far", F.col("_range"))
    chunks = placed.select("brain", "item", F.lit(2).alias("section"), F.floor((F.col("_so_far") - F.col("tokens")) / budget).alias("chunk"))
    heads = article_counts(sizes)
    if brains is not None:
        heads = brains.select("brain").distinct().join(heads, "brain", "left")
    empty = F.when(F.col("n_articles").isNull(), "\n\n(the library is empty)").otherwise("")
    head = heads.select("brain", F.lit(0).alias("section"), none, F.lit("").alias("item"),
                        F.concat(F.lit(f"# Library state {LINK_MARK} {today}"), empty).alias("text"))
    pair = F.array(F.struct(F.lit(1).alias("section"), F.lit("").alias("category"), F.col("path").alias("item"), _toc_line().alias("text")),
                   F.struct(F.lit(2).alias("section"), F.col("category"), F.col("path").alias("item"), full.alias("text")))
    rows = (head.unionByName(field_defaults(catalog).select("brain", F.inline(pair)))
            .withColumn("tokens", token_estimate(F.col("text"))))
    return (rows.join(chunks, ["brain", "item", "section"], "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)))
            .select("brain", "section", "category", "chunk", "item", "text", "tokens"))


def context_tokens(context: DataFrame) -> DataFrame:
    return context.groupBy("brain").agg(F.sum("tokens").alias("tokens"))


def sort_index(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("category", "stem", "path")
