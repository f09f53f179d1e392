"""Prefix trie of conversations: sorted neighbours, union-find over their common prefixes, merged forests.

A node stands for a sequence of turns with which some conversations begin; the root for the empty one.
Conversations are put in the order of their sequences (a hash of 16 bytes a turn) and dealt out by range,
equal sequences by id, so the members of a node are neighbours, and one node never lies in a
partition between two others without filling it. In a partition the edges between neighbours, as deep as
their longest common prefix, are taken in descending depth: every merge of two components makes or widens
a branching node, the unbranched nodes below it are then complete, and so a component is an interval
of conversations and its top. The number of its members, its leaves and the sums below it are
differences of running sums over that interval.

Forests of neighbouring partitions meet in the nodes that both have: prefixes of the last conversation of
the one and the first of the other, as long as the two agree. Only these nodes, contracted to what a
partition adds to them, are merged; all figures but the smallest member add up, because what lies on both
sides of a boundary is counted on its left side. Nodes below point to them by (partition, node), so a node
with a third of all conversations below it is joined partition by partition.

Order of turns: turn, null first; ties by role, then by a hash of the text. Nulls: a null role or text is
empty; rows without a conversation id belong to no conversation and are left out. Repeated rows are turns
of their own. An empty table gives no nodes, not even a root. Columns other than the four named ones are
not read. A conversation's sequence is one value of 16 bytes a turn, and a partition's conversations are
held by its task; their texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomlog.llm.common import pick, table
from loomlog.session import saved

WIDTH = 16
#: Ids of one piece of the list of conversations that end in a node.
PIECE = 8192


def turns_of(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, turn, size): a struct that puts the turns of a conversation in order, the hash of
    the turn and the code points of its text."""
    rows = pick(convs, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text").filter("conv_id is not null")
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    told = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    place = F.struct(F.lit(0).alias("part"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                     "role", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), place.alias("place"),
                       F.unhex(F.substring(told, 1, 2 * WIDTH)).alias("turn"), F.length("text").cast("long").alias("size"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the hashes of the turns of each conversation in order, and their sizes."""
    listed = F.array_sort(F.collect_list(F.struct("place", "turn", "size")))
    return (turns.groupBy("conv_id").agg(listed.alias("t"))
            .select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["turn"])), "")).alias("key"),
                    F.transform("t", lambda t: t["size"]).alias("sizes")))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    step, at = 1024, 0
    while a[at : at + step] == b[at : at + step]:
        at += step
    return (at + int(np.argmax(np.frombuffer(a[at : min(at + step, n)], np.uint8) != np.frombuffer(b[at : min(at + step, n)], np.uint8)))) // WIDTH


def _prefixes(key: bytes, depth: int) -> list[bytes]:
    """Names of the nodes of a sequence down to `depth`."""
    h = xxhash.xxh3_128()
    out = [h.digest()]
    for at in range(0, depth * WIDTH, WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.digest())
    return out


class Forest:
    """The trie of conversations in order, as seen by one partition.

    `left` and `right` are the turns shared with the neighbours on both sides, -1 where there is none.
    """

    def __init__(self, ids: list[int], keys: list[bytes], sizes: list, left: int, right: int) -> None:
        self.ids, self.m, self.left, self.right = ids, len(ids), left, right
        self.depth = [len(k) // WIDTH for k in keys]
        self.lcp = [left, *(common(a, b) for a, b in zip(keys, keys[1:])), right]
        self.sums = [np.concatenate([[0], np.cumsum(np.asarray(s, np.int64))]) for s in sizes]
        whole = np.array([s[-1] for s in self.sums], np.int64)
        new = np.array([s[-1] - s[max(c, 0)] for s, c in zip(self.sums, self.lcp)], np.int64)
        leaf = np.array([after < d for d, after in zip(self.depth, self.lcp[1:])], np.int64)
        self.whole, self.new, self.leaf = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (whole, new, leaf))
        self.names_left, self.names_right = _prefixes(keys[0], max(left, 0)), _prefixes(keys[-1], max(right, 0))
        self.rows: list[list] = []

    def name(self, a: int, b: int, d: int) -> bytes | None:
        """Name of the node of an interval if a neighbouring partition has it too."""
        if a == 0 and self.left >= d:
            return self.names_left[d]
        return self.names_right[d] if b == self.m - 1 and self.right >= d else None

    def nodes(self) -> list[list]:
        """One row per node, see `NODE`."""
        m = self.m
        up = list(range(m))  # union-find: the first conversation of the component
        last, top, least = list(range(m)), list(self.depth), list(self.ids)
        children, below = [0] * m, [[] for _ in range(m)]  # of the top node; `below`: rows that it is the parent of

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def lift(a: int, d: int) -> None:
            """The nodes of a component above depth `d` are complete; its top becomes the node at `d`."""
            waiting, n = below[a], children[a]
            for depth in range(top[a], d, -1):
                waiting = [self._row(a, last[a], depth, least[a], n, waiting)]
                n = int(a > 0 or self.left < depth)  # a child that began further left is counted there
            if top[a] > d:
                top[a], children[a], below[a] = d, n, waiting

        for j in sorted(range(1, m), key=lambda j: -self.lcp[j]):
            d, a, b = self.lcp[j], find(j - 1), find(j)
            lift(a, d)
            lift(b, d)
            up[b], last[a], least[a] = a, last[b], min(least[a], least[b])
            children[a] += children[b]
            below[a].extend(below[b])
            below[b] = []
        lift(0, -1)
        return self.rows

    def _row(self, a: int, b: int, d: int, least: int, n_children: int, below: list[int]) -> int:
        name, at = self.name(a, b, d), len(self.rows)
        for row in below:
            if name is None:
                self.rows[row][5] = least
            else:
                self.rows[row][2] = name
        to = a
        while to <= b and self.depth[to] == d:
            to += 1
        ends = [",".join(map(str, self.ids[i : min(i + PIECE, to)])).encode() for i in range(a, to, PIECE)]
        cut = int(self.sums[a][max(d - 1, 0)])
        first_new = int(self.sums[a][-1] - self.sums[a][max(d - 1, self.lcp[a], 0)])
        sha = hashlib.sha256(b",".join(ends)).hexdigest() if name is None else None
        self.rows.append([name is not None, name, None, least, d, None, b - a + 1, n_children, self.leaf[b + 1] - self.leaf[a],
                          self.whole[b + 1] - self.whole[a] - (b - a + 1) * cut - (self.new[b + 1] - self.new[a + 1] + first_new),
                          sha, ends if name is not None else []])
        return at


NODE = ("part int, open boolean, name binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string, ends array<binary>")
_NODE = pa.schema([("part", pa.int32()), ("open", pa.bool_()), ("name", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()),
                   ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                   ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.list_(pa.binary()))])


def _boundaries(spark: SparkSession, rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each partition the turns that it shares with its neighbours: three numbers a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [-1 if a is None or b is None else common(a, b) for a, b in zip(batch.column("before").to_pylist(), batch.column("first").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(shared, pa.int32())], names=["part", "shared"])

    by_part = Window.orderBy("part")
    outer = rows.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    left = outer.select("part", "first", F.lag("last").over(by_part).alias("before")).mapInArrow(run, "part int, shared int").collect()
    parts = sorted((r.part, r.shared) for r in left)
    return {p: (shared, after) for (p, shared), after in zip(parts, [s for _, s in parts[1:]] + [-1])}


def _digested(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of pieces (name, part, pos, piece): the pieces of a node in order, joined by
    commas, are read once and never held together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            done = []
            for own, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist()):
                if own != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = own, hashlib.sha256(piece)
                else:
                    digest.update(b",")
                    digest.update(piece)
            yield _named(done)
        if name is not None:
            yield _named([(name, digest.hexdigest())])

    def _named(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())],
                                          names=["name", "ends_sha256"])

    return (ends.repartition("name").sortWithinPartitions("name", "part", "pos").select("name", "piece")
            .mapInArrow(run, "name binary, ends_sha256 string"))


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(seqs: DataFrame) -> DataFrame:
    """All nodes of the sequences (conv_id, key, sizes): conv_id its smallest member, depth,
    parent_conv_id that of the parent, n_convs, n_children, n_leaves, saved_tokens (over the subtree, the
    size of each last turn times the members but one) and ends_sha256, the digest of the ids that end here."""
    spark = seqs.sparkSession
    rows = saved(seqs.repartitionByRange("key", "conv_id").select(F.spark_partition_id().alias("part"), "conv_id", "key", "sizes"), "sequences")
    shared = spark.sparkContext.broadcast(_boundaries(spark, rows))

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        ordered = sorted(zip(group.column("key").to_pylist(), group.column("conv_id").to_pylist(), range(group.num_rows)))
        sizes = group.column("sizes")
        forest = Forest([c for _, c, _ in ordered], [k for k, _, _ in ordered], [sizes[i].values.to_numpy() for _, _, i in ordered], *shared.value[part])
        columns = list(zip(*forest.nodes()))
        return pa.Table.from_arrays([pa.array([part] * len(columns[0]), pa.int32()), *[pa.array(c, f.type) for c, f in zip(columns, list(_NODE)[1:])]],
                                    schema=_NODE)

    nodes = saved(rows.groupBy("part").applyInArrow(run, NODE), "nodes")
    split = nodes.filter("open")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    digests = _digested(split.select("name", "part", F.posexplode("ends").alias("pos", "piece")))
    # Every turn of a member counts where the member lies, and is taken off once, where its node begins.
    whole = saved(split.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                            *[F.sum(c).alias(c) for c in sums]), "boundary-nodes")
    above = whole.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    merged = (whole.join(above, "parent", "left").join(digests, "name", "left")
              .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))).select(*RESULT))
    near = split.select("part", F.col("name").alias("parent")).join(above, "parent")
    closed = nodes.filter("not open")
    below = closed.filter("parent is not null").drop("parent_conv_id").join(near, ["part", "parent"]).select(*RESULT)
    return closed.filter("parent is null").select(*RESULT).unionByName(below).unionByName(merged)


def rebuilt(turns: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, key, sizes) of conversations that begin as the first of their hundred does: the first h turns
    of that one, then their own from the (h + 1)th on; h, up to `most`, is a checksum of the id."""
    turns = saved(turns, "turns")
    convs = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1))
    # Each task holds back all but the first rows of a conversation, however long it is.
    first = (turns.withColumn("p", F.row_number().over(Window.partitionBy("conv_id").orderBy("place"))).filter(F.col("p") <= most))
    begun = convs.select(F.col("conv_id").alias("own"), "h", (F.col("conv_id") - F.col("conv_id") % every).alias("conv_id"))
    shared = begun.join(first, "conv_id").filter("p <= h").select(F.col("own").alias("conv_id"), "p", "turn", "size")
    replaced = first.join(convs, "conv_id").filter("p <= h").select("place.row")
    own = turns.withColumn("row", F.col("place.row")).join(replaced, "row", "left_anti")
    heads = shared.select("conv_id", F.struct(F.lit(0).alias("part"), F.lit(False).alias("known"), F.col("p").cast("long").alias("turn"), F.lit("").alias("role"),
                                              F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("row")).alias("place"), "turn", "size")
    tails = own.select("conv_id", F.struct(F.lit(1).alias("part"), "place.known", "place.turn", "place.role", "place.hash", "place.row").alias("place"), "turn", "size")
    found = sequences(heads.unionByName(tails))
    return (convs.select("conv_id").join(found, "conv_id", "left")
            .select("conv_id", F.coalesce("key", F.lit(b"")).alias("key"), F.coalesce("sizes", F.array().cast("array<long>")).alias("sizes")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the rebuilt conversations."""
    return trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS role,
                  coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS tab
        FROM range(256) r(i)),
c AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]),
                                      lambda v, b: xor(v >> 8, tab[(xor(v, b) & 255) + 1])), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t), crc),
s AS (SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h
      UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d FROM s),
x AS (SELECT conv_id, d, length(text) AS size,
             sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM x GROUP BY d, k),
l AS (SELECT conv_id, max(d) AS d FROM x GROUP BY conv_id),
e AS (SELECT x.d, x.k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM x JOIN l USING (conv_id, d) GROUP BY x.d, x.k),
up AS (SELECT n.*, p.k AS pk FROM n LEFT JOIN x p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM up WHERE d > 0 GROUP BY d, pk),
sub AS (SELECT a.d, a.k, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens, count(*) FILTER (kids.k IS NULL) AS n_leaves
        FROM n LEFT JOIN kids USING (d, k) JOIN x a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.k)
SELECT up.conv_id, up.d::BIGINT AS depth, p.conv_id AS parent_conv_id, up.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(ends, '')) AS ends_sha256
FROM up JOIN sub ON sub.d = up.d AND sub.k = up.k LEFT JOIN kids ON kids.d = up.d AND kids.k = up.k LEFT JOIN e ON e.d = up.d AND e.k = up.k
LEFT JOIN n p ON p.d = up.d - 1 AND p.k = up.pk
"""
