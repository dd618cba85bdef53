"""Shards of near equal size by a k-d tree over document metadata.

A node of the tree is split along its widest dimension, measured against the spread of all documents, at the weighted median (of
sizes), until every leaf is one shard of about the target bytes. All nodes of a level are split together. A median is
found by histograms: each round counts bytes per node and bucket in Spark, with partial sums before the shuffle, and
takes the bucket that holds the median apart, until what it holds is too little to matter or is one row. Rows of equal
value are ordered by the hash of their text, then of their id, then by the row's number, so any hot value, source or group of
copies can be split, and equal texts stay together unless a cut has to go through them.

Only the tree (a few numbers per shard) passes through the driver and is handed out; no row does.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.session import staged

BUCKETS = 4096
DEALS = 4096
_TIES = ["t1", "t2", "t3"]  # 48-bit hash of the text, 48-bit hash of the id, number of the row


def points(docs, dims=("lang", "source")):
    """A narrow row per document: doc_id, size, text_crc32, a number per dimension (v0 is the size) and the ties.

    A string counts by the first six bytes after what all strings of its column begin with, which keeps their order; null is
    -1. Written once, so that every round reads the same row numbers.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    short = lambda h: F.shiftrightunsigned(h, 16)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        *[F.col(c).cast("string").alias(f"s{k}") for k, c in enumerate(dims, 1)],
        short(F.xxhash64(text)).alias("t1"),
        short(F.xxhash64(F.lit("id"), F.col("doc_id").cast("long"))).alias("t2"),
        F.monotonically_increasing_id().alias("t3"),
    )
    if dims:
        ends = docs.agg(*[f(F.col(c).cast("string")).alias(f"{n}{k}") for k, c in enumerate(dims, 1)
                          for n, f in (("lo", F.min), ("hi", F.max))]).first()
    values = [F.col("size").alias("v0")]
    for k in range(1, len(dims) + 1):
        lo, hi = ((ends[f"{n}{k}"] or "").encode() for n in ("lo", "hi"))
        same = next((i for i, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
        after = F.substring(F.hex(F.substring(F.encode(f"s{k}", "UTF-8"), same + 1, 6)), 1, 12)
        number = F.conv(F.rpad(after, 12, "0"), 16, 10).cast("long")
        values.append(F.coalesce(number, F.lit(-1)).cast("long").alias(f"v{k}"))
    return staged(rows.select("doc_id", "size", "text_crc32", *values, *_TIES), "points")


class _Split:
    """A node while its median is looked for, and afterwards the least row of its right side."""

    def __init__(self, node, shards, first, goal, dim):
        self.node, self.shards, self.first, self.goal, self.dim = node, shards, first, goal, dim
        self.fixed, self.low, self.shift, self.before, self.cut = [], None, None, 0, None

    def span(self, low, high):
        """Look between two values of the column at hand."""
        self.low, self.shift = low, max(0, (high - low).bit_length() - BUCKETS.bit_length() + 1)

    def narrow(self, bucket, weight, rows, before, slack):
        """Take in the bucket that holds the median; the cut is set once it need not be narrowed."""
        low = self.low + (bucket << self.shift)
        before = self.before + before
        if weight <= slack or rows == 1:
            far = self.goal - before > before + weight - self.goal
            self.cut = (*self.fixed, low + ((1 << self.shift) if far else 0))
            self.cut += (-(1 << 62),) * (4 - len(self.cut))
        elif self.shift:
            self.before = before
            self.span(low, low + (1 << self.shift) - 1)
        else:
            self.before = before
            self.fixed.append(low)
            self.low = None
            if len(self.fixed) < 3:
                self.span(0, (1 << 48) - 1)


def _key(rows, dim, n_dims):
    value = F.col("v0")
    for k in range(1, n_dims):
        value = F.when(dim == k, F.col(f"v{k}")).otherwise(value)
    return value


def _table(spark, rows, schema):
    return F.broadcast(spark.createDataFrame(rows, schema))


def _route(rows, cuts, n_dims):
    """Send rows one level down: ``cuts`` has (node, dim, c0..c3, left, right)."""
    schema = "node long, dim int, c0 long, c1 long, c2 long, c3 long, below long, above long"
    rows = rows.join(_table(rows.sparkSession, cuts, schema), "node", "left")
    at = F.struct(_key(rows, F.col("dim"), n_dims).alias("c0"), *[F.col(t).alias(f"c{k}") for k, t in enumerate(_TIES, 1)])
    left = at < F.struct("c0", "c1", "c2", "c3")
    node = F.when(F.col("dim").isNull(), F.col("node")).when(left, F.col("below")).otherwise(F.col("above"))
    return rows.withColumn("node", node).drop("dim", "c0", "c1", "c2", "c3", "below", "above")


def _search(rows, splits, slack, n_dims):
    """Find the cuts of all ``splits``, a job per round for all of them."""
    spark = rows.sparkSession
    while todo := [s for s in splits if s.cut is None]:
        for s in todo:
            if s.low is None:  # only the row numbers are left, whose range is the node's own
                s.low, s.shift = 0, 64 - BUCKETS.bit_length()
        state = [
            (s.node, s.dim, len(s.fixed), *(s.fixed + [0, 0, 0])[:3], s.low, s.shift) for s in todo
        ]
        schema = "node long, dim int, upto int, f0 long, f1 long, f2 long, low long, shift int"
        at = rows.join(_table(spark, state, schema), "node")
        columns = [_key(at, F.col("dim"), n_dims), *[F.col(t) for t in _TIES]]
        here = columns[0]
        for k in range(1, 4):
            here = F.when(F.col("upto") == k, columns[k]).otherwise(here)
        inside = F.lit(True)
        for k in range(3):
            inside = inside & ((F.col("upto") <= k) | (columns[k] == F.col(f"f{k}")))
        bucket = F.expr("shiftright(here - low, shift)")
        counted = (
            at.where(inside).withColumn("here", here).withColumn("bucket", bucket)
            .where(f"here >= low and bucket < {BUCKETS}")
            .groupBy("node", "bucket").agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
        )
        w = Window.partitionBy("node").orderBy("bucket")
        summed = counted.withColumn("upto", F.sum("weight").over(w))
        goals = _table(spark, [(s.node, s.goal - s.before) for s in todo], "node long, goal long")
        hit = summed.join(goals, "node").where("upto >= goal").groupBy("node").agg(
            F.min(F.struct("bucket", "weight", "n", (F.col("upto") - F.col("weight")).alias("before"))).alias("b")
        )
        found = {r.node: r.b for r in hit.collect()}
        for s in todo:
            b = found[s.node]
            s.narrow(b.bucket, b.weight, b.n, b.before, slack)


def kd_tree(rows, shards, n_dims, fine=1000):
    """The cuts of every level: lists of (node, dim, c0..c3, left, right); leaves are -1 - shard.

    A node of n shards gives n // 2 of them, and as much of its bytes, to its left. A cut misses its median by at most a
    ``fine``-th of a shard, or by half a row.
    """
    levels, nodes, routed = [], {0: (shards, 0)}, rows.withColumn("node", F.lit(0).cast("long"))
    whole, slack = None, 0
    while nodes:
        stats = routed.where("node >= 0").groupBy("node").agg(
            F.sum("size").alias("bytes"),
            *[f(f"v{k}").alias(f"{n}{k}") for k in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))],
        ).collect()
        if whole is None:
            if not stats:
                return []
            whole = [max(1, stats[0][f"hi{k}"] - stats[0][f"lo{k}"]) for k in range(n_dims)]
            slack = stats[0].bytes // (shards * fine)
        splits = []
        for r in stats:
            n, first = nodes[r.node]
            if n > 1:
                wide = [(r[f"hi{k}"] - r[f"lo{k}"]) / whole[k] for k in range(n_dims)]
                dim = max(range(n_dims), key=lambda k: (wide[k], -k))
                split = _Split(r.node, n, first, max(1, r.bytes * (n // 2) // n), dim)
                split.span(r[f"lo{dim}"], r[f"hi{dim}"])
                splits.append(split)
        _search(routed, splits, slack, n_dims)
        cuts, below = [], {}
        for s in splits:
            sides = []
            half = s.shards // 2
            for n, first, child in ((half, s.first, 2 * s.node + 1), (s.shards - half, s.first + half, 2 * s.node + 2)):
                sides.append(child if n > 1 else -1 - first)
                if n > 1:
                    below[child] = (n, first)
            cuts.append((s.node, s.dim, *s.cut, *sides))
        if cuts:
            levels.append(cuts)
            routed = _route(routed, cuts, n_dims)
        nodes = below
    return levels


def shard(docs, shards=8, dims=("lang", "source"), fine=1000):
    """Shard and slot of every document of ``docs`` (doc_id, text and the string columns ``dims``).

    Gives doc_id, size (bytes of the text and one more), text_crc32, shard (0 to ``shards`` - 1) and slot (gapless from 0
    within its shard). The bytes of shards are near equal: each of the tree's levels misses its median by at most a
    ``fine``-th of a shard, or by half a document. Null texts are empty, null metadata comes first, null and repeated ids are rows like
    any other; rows alike in everything may lie in different shards. An empty table has no rows; extra columns are ignored.
    """
    rows = points(docs, dims)
    n_dims = len(dims) + 1
    placed = rows.withColumn("node", F.lit(0 if shards > 1 else -1).cast("long"))
    if shards > 1:
        for cuts in kd_tree(rows, shards, n_dims, fine):
            placed = _route(placed, cuts, n_dims)
    placed = placed.select("doc_id", "size", "text_crc32", "t1", "t2", "t3", (-1 - F.col("node")).cast("int").alias("shard"))
    placed = staged(placed.withColumn("deal", F.pmod(F.xxhash64("t1", "t2"), F.lit(DEALS)).cast("int")), "placed")
    before = Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("shard", "deal").count().select(
        "shard", "deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "deal").orderBy("t2", "t1", "t3"))
    ranked = placed.withColumn("rank", rank).join(shifts, ["shard", "deal"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))
