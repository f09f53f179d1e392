"""Articles that cover the same ground: exact copies and high shingle overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.arrays import explode_rows
from loomlog.functions.front_matter import article_body
from loomlog.plans.key_filter import KeyTable
from loomlog.plans.ordered import latest_per_key
from loomlog.session import saved

THRESHOLD = 0.7


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _shingles(words: Column) -> Column:
    """Distinct hashes of word triples; shorter texts are one shingle."""
    rest = F.greatest(F.size(words), F.lit(1))
    pairs = F.zip_with(words, F.slice(words, 2, rest), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice(words, 3, rest), lambda h, c: F.when(c.isNotNull(), F.xxhash64(h, c)))
    return F.coalesce(F.nullif(F.array_compact(F.array_distinct(triples)), F.array().cast("array<bigint>")),
                      F.array(F.xxhash64(words)))


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def near_duplicate_articles(catalog: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(brain, path, partner, jaccard): every article that has a near-duplicate, with one of them.

    Copies with the same words are grouped first and linked to one member, so any number of
    them costs one row each. The rest is an exact set join: two articles that are alike share
    a shingle among the rarest of each (as many as they may differ in, plus one), so those
    shingles are the buckets, and boilerplate never is one. The place of a shingle in the order by
    rarity bounds what two articles can share from there on: articles that stand too far back for
    even the smallest one that has the shingle are in no bucket, and pairs that cannot reach
    the threshold are not compared. In a bucket the smallest waiting member leads and is compared
    with all others; whoever has a partner waits no more, and each round takes twice as many
    leaders. A bucket of near-copies takes one pass, articles that share a template but nothing else take
    none, no bucket is cut short, and which articles are reported depends on nothing but their texts.
    """
    worded = catalog.select("brain", "path", _words(article_body(F.col("content"))).alias("words"))
    # The one pass over the texts; every later step reads columns of this table.
    signed = saved(worded.select("brain", "path", F.md5(F.array_join("words", " ")).alias("word_key"),
                                 _shingles(F.col("words")).alias("shingles"), F.monotonically_increasing_id().alias("id")), "signatures")
    keyed = signed.select("id", "brain", "path", "word_key").filter(F.col("word_key") != F.md5(F.lit("")))
    groups = saved(keyed.groupBy("brain", "word_key")
                   .agg(F.min("path").alias("first"), F.max("path").alias("last"), F.min_by("id", "path").alias("stays"),
                        F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    grouped = keyed.join(groups, ["brain", "word_key"])
    copies = grouped.select("brain", "path", F.when(F.col("path") == F.col("first"), F.col("last"))
                            .otherwise(F.col("first")).alias("partner"), F.lit(1.0).alias("jaccard"))
    # Only the sets of what may be a copy are shuffled to leave out all but one of a group.
    copied = KeyTable(groups.select(F.xxhash64("brain", "word_key").alias("key")), "key", groups.count())
    worth = signed.filter((F.col("word_key") != F.md5(F.lit(""))) & F.col("brain").isNotNull() & F.col("path").isNotNull())
    word_key = F.xxhash64("brain", "word_key")
    single = copied.holds_not(worth, word_key).unionByName(
        copied.may_hold(worth, word_key).join(grouped.filter("id <> stays").select("id"), "id", "left_anti"))
    edges = _led(saved(_rare(single, threshold), "buckets"), signed, threshold)
    both = edges.unionByName(edges.select(F.col("partner").alias("id"), F.col("id").alias("partner"), "jaccard"))
    names = signed.select("id", "brain", "path")
    found = (both.join(names, "id").join(names.select(F.col("id").alias("partner"), F.col("path").alias("_path")), "partner")
             .select("brain", "path", F.col("_path").alias("partner"), "jaccard"))
    all_found = found.unionByName(copies).withColumn("_closeness", F.col("jaccard"))
    return latest_per_key(all_found, ["brain", "path"], ["_closeness", "partner"]).drop("_closeness")


def _needed(size: Column, other: Column, threshold: float) -> Column:
    """Shingles that two articles of these sizes share at least if they are alike."""
    return F.ceil((size + other) * (threshold / (1 + threshold)) - 1e-9)


def _rare(articles: DataFrame, threshold: float) -> DataFrame:
    """(key, id, _size, _left): the rarest shingles of each article, hashed with its library, of which any
    article alike shares one, and how many shingles it has from there on in the order by rarity. A shingle that
    only one article of about that size holds is left out. Rows are four numbers, as there is one for each
    shingle of the library."""
    keys = F.transform("shingles", lambda s: F.xxhash64(F.col("brain"), s))
    rows = explode_rows(articles.withColumn("_size", F.size("shingles")), ["id", "_size"], keys, "key")
    # One shuffle of all rows by shingle: an article has a shingle once, so no shingle has more rows than there are articles.
    same = Window.partitionBy("key")
    counted = rows.withColumns({"n": F.count(F.lit(1)).over(same), "_least": F.min("_size").over(same),
                                "_less": F.lag("_size").over(same.orderBy("_size")), "_more": F.lead("_size").over(same.orderBy("_size"))})
    # Where neither the next smaller nor the next larger article with the shingle is near enough in size, none is.
    often = (counted.filter((F.col("_less") >= F.col("_size") * threshold - 1e-9) | (F.col("_size") >= F.col("_more") * threshold - 1e-9))
             .drop("_less", "_more"))
    own = Window.partitionBy("id")
    shared = (often.withColumn("_shared", F.count(F.lit(1)).over(own))
              .withColumn("_rank", F.row_number().over(own.orderBy("n", "key"))))
    # The smallest article with the shingle asks for the fewest in common, but not if it is too small itself.
    smallest = F.greatest(F.col("_least"), F.ceil(F.col("_size") * threshold - 1e-9))
    return (shared.withColumn("_left", F.col("_shared") - F.col("_rank") + 1)
            .filter(F.col("_left") >= _needed(F.col("_size"), smallest, threshold)).select("key", "id", "_size", "_left"))


def _sets(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, brain, shingles) of the articles in the pairs, and of few others: a bit table drops the rest before
    any shuffle."""
    ids = pairs.select(F.xxhash64("id").alias("key")).unionByName(pairs.select(F.xxhash64("partner").alias("key"))).distinct()
    paired = KeyTable(ids, "key", ids.count())
    return paired.may_hold(articles.select("id", "brain", "shingles"), F.xxhash64("id"))


def _led(members: DataFrame, articles: DataFrame, threshold: float) -> DataFrame:
    """Pairs that leaders find (id, partner, jaccard). Articles of which one has too few shingles for the
    other, in all or from the place of the common one on, are no pair, whatever they share; so their sets are not
    fetched. That holds for the first shingle in common, and a pair meets at it."""
    waiting, edges, leaders = members, None, 1
    fits = ((F.least("_size", "_partner_size") >= F.greatest("_size", "_partner_size") * threshold - 1e-9)
            & (F.least("_left", "_partner_left") >= _needed(F.col("_size"), F.col("_partner_size"), threshold)))
    while True:
        # Keeps at most `leaders` rows per bucket and map task before the shuffle.
        rank = F.row_number().over(Window.partitionBy("key").orderBy("_size", "id"))
        lead = saved(waiting.withColumn("_rank", rank).filter(F.col("_rank") <= leaders).drop("_rank"), "leaders")
        pairs = saved(members.join(lead.select("key", F.col("id").alias("partner"), F.col("_size").alias("_partner_size"),
                                            F.col("_left").alias("_partner_left")), "key")
                 .filter((F.col("id") != F.col("partner")) & fits).select("id", "partner").distinct(), "pairs")
        sets = _sets(articles, pairs)
        others = sets.select(F.col("id").alias("partner"), F.col("brain").alias("_brain"), F.col("shingles").alias("_other"))
        hits = saved(pairs.join(sets, "id").join(others, "partner").filter("brain = _brain")
                     .select("id", "partner", _jaccard(F.col("shingles"), F.col("_other")).alias("jaccard"))
                     .filter(F.col("jaccard") >= threshold), "hits")
        edges = hits if edges is None else edges.unionByName(hits)
        settled = hits.select("id").unionByName(hits.select(F.col("partner").alias("id"))).distinct()
        waiting = saved(waiting.join(settled, "id", "left_anti").join(lead, ["key", "id"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return edges
        leaders *= 2
