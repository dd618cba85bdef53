"""Connected components of an edge list by alternating star contractions."""

from pyspark.sql import functions as F

from courtflow.session import staged


def components(edges, a="a", b="b"):
    """Label the nodes of ``edges`` with the smallest node reachable: columns node, root.

    Each round links the neighbours of a node to the least of them, first the larger ones, then the
    smaller ones, until nothing changes; the number of rounds grows with the logarithm of the longest chain. Every
    round is written to the shared folder. Loops, repeated edges and nulls are ignored.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(f"{a} is not null and {b} is not null and u > v")
        .distinct()
    )
    pairs = staged(pairs, "components")
    before = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        pairs = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        pairs = staged(pairs.union(linked.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = pairs.select(
            F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")
        ).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
