"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the number of copies each of its documents gets on average. The whole part is given to
all; the fractional part is a probability, rounded document by document so that the words taken stay as near
the target as they can: two documents at a time, probability mass (in words) moves from one to the other, in a random
direction that keeps both expectations, until one of them is settled at none or all of its words. What is left of the other
meets the next document.

Documents are dealt into leaves of about ``LEAF`` by hash, each leaf is folded to at most one unsettled document, and those are
folded again, level by level, until each source has one. A source with a third of all rows has a third of the leaves. The last
document of a source takes as many of its words as the mass left over says, so the words taken meet the target.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.session import staged

LEAF = 128
WEIGHTS = (5, 2, 1)
_UNIT = "struct<doc_id:bigint,size:bigint,n:bigint,a:double,m:double,u:double>"


def word_count(text):
    """Number of runs of other than ASCII white space; null has none."""
    even = F.trim(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", " " * 5))
    return F.when(even == "", 0).otherwise(F.size(F.split(even, " +"))).cast("long")


def _sized(docs):
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    )


def targets(sizes, share=1.5, most=2.0, weights=WEIGHTS):
    """source, source_size, target from ``sizes`` (source, source_size), one row per source.

    Sources are ranked by code point, null last, and weigh ``weights`` in turn. No source exceeds ``most`` times its size;
    what it cannot take is shared again by weight until none is above.
    """
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = staged(
        ranged.withColumn("inside", inside)
        .join(parts, "part")
        .withColumn("weight", F.get(cycle, ((F.col("before") + F.col("inside") - 1) % len(weights)).cast("int")))
        .withColumn("cap", most * F.col("source_size"))
        .select("source", "source_size", "weight", "cap"),
        "sources",
    )
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, over = 0.0, F.lit(False)
    while True:
        held = ranked.agg(
            F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("caps"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        if not held.weights:
            break
        now = (total - held.caps) / held.weights
        if now <= level:
            break
        level, over = now, F.col("weight") * F.lit(now) > F.col("cap")
    return ranked.select(
        "source", "source_size", F.when(over, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target")
    )


def _fold(units):
    """One leaf: an array of units becomes the settled ones and at most one that is not."""
    none = F.lit(None).cast(_UNIT)
    start = F.struct(none.alias("open"), F.array().cast(f"array<{_UNIT}>").alias("done"))

    def unit(x, mass):
        return F.struct(x.doc_id, x.size, x.n, x.a, mass.alias("m"), x.u)

    def settled(x):
        return (x.m == 0) | (x.m == x.a)

    def meet(state, y):
        x = state.open
        room_x, room_y = x.a - x.m, y.a - y.m
        to_x, to_y = F.least(room_x, y.m), F.least(x.m, room_y)
        # the larger a step would be, the rarer it is taken: expectations stay
        give = y.u * (to_x + to_y) < to_y
        new_x = F.when(give, F.when(room_x <= y.m, x.a).otherwise(x.m + y.m)).otherwise(
            F.when(x.m <= room_y, 0.0).otherwise(x.m - room_y)
        )
        new_y = F.when(give, F.when(room_x <= y.m, y.m - room_x).otherwise(0.0)).otherwise(
            F.when(x.m <= room_y, y.m + x.m).otherwise(y.a)
        )
        both = F.array(unit(x, new_x), unit(y, new_y))
        return F.when(x.isNull(), F.struct(y.alias("open"), state.done.alias("done"))).otherwise(
            F.struct(
                F.get(F.filter(both, lambda z: ~settled(z)), F.lit(0)).alias("open"),
                F.concat(state.done, F.filter(both, settled)).alias("done"),
            )
        )

    return F.aggregate(units, start, meet)


def _uniform(level, seed):
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), 11)
    return bits / F.lit(float(1 << 53))


def rounded(units, seed=1):
    """Settle ``units`` (source, doc_id, size, n, a, m): source, doc_id, size and the extra words of each of its n rows.

    ``a`` is a unit's size in words and ``m`` its mass, between 0 and a. Masses of a source keep their sum.
    """
    decided, level = [], 0
    while True:
        per = units.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("units"))
        most = per.agg(F.max("units")).first()[0] or 0
        leaf = F.when(F.col("units") <= 2 * LEAF, 0).otherwise(
            F.expr(f"pmod(xxhash64(doc_id, size, {level}L), cast(ceil(units / {LEAF}) as bigint))")
        )
        dealt = units.join(per, F.col("source").eqNullSafe(F.col("of"))).select(
            "source",
            leaf.cast("long").alias("leaf"),
            F.struct(
                _uniform(level, seed).alias("at"),
                F.struct("doc_id", "size", "n", "a", "m", _uniform(level, seed + 1).alias("u")).alias("unit"),
            ).alias("unit"),
        )
        leaves = dealt.groupBy("source", "leaf").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = leaves.select("source", _fold(F.col("units.unit")).alias("state"))
        folded = staged(folded.select("source", "state.open", "state.done"), "mixing")
        decided.append(folded.select("source", F.explode("done").alias("z")).select("source", "z.*"))
        units = folded.where("open is not null").select("source", "open.*")
        level += 1
        if most <= 2 * LEAF:
            break
    for more in decided:
        units = units.unionByName(more)
    return units.select("source", "doc_id", "size", F.round(F.col("m") / F.col("n")).cast("long").alias("extra"))


def mix(docs, share=1.5, most=2.0, weights=WEIGHTS, seed=1):
    """doc_id, source, size, source_size, target and taken (words) for each row of ``docs`` (doc_id, text, source).

    Sizes are in words, null and empty texts have none and take none. A null source is a source. Rows that are equal in
    doc_id, source and size are rounded as one and share the outcome. The same rows give the same mix whatever
    their order. ``seed`` gives another mix. Other columns are not read.
    """
    sized = staged(_sized(docs), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = staged(targets(sources, share, most, weights), "targets")
    goals = goals.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goals = goals.withColumn("whole", F.floor("ratio")).withColumn("part", F.col("ratio") - F.col("whole"))
    aimed = goals.withColumnRenamed("source", "of")
    units = sized.where("size > 0").groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    units = units.join(aimed, F.col("source").eqNullSafe(F.col("of"))).where("part > 0")
    units = units.select(
        "source", "doc_id", "size", "n", (F.col("size") * F.col("n")).cast("double").alias("a"), "part"
    ).withColumn("m", F.col("a") * F.col("part"))
    extra = rounded(units.drop("part"), seed)
    extra = extra.select(
        F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), "extra"
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    )
    return (
        sized.join(aimed, F.col("source").eqNullSafe(F.col("of")))
        .join(extra, same, "left")
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("whole") * F.col("size") + F.coalesce("extra", F.lit(0))).cast("long").alias("taken"),
        )
    )


def copies(docs, share=1.5, most=2.0, weights=WEIGHTS, seed=1):
    """The mixed documents: each row of ``docs`` as often as the mix takes it, all columns unchanged.

    Rows with no words stay once. A document of which the mix takes a part counts as taken when that is half of it or more.
    """
    names = docs.columns
    mixed = mix(docs, share, most, weights, seed)
    times = mixed.select(
        F.col("doc_id").alias("d"),
        F.col("source").alias("s"),
        F.col("size").alias("z"),
        F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias("times"),
    ).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col("doc_id").cast("long").alias("i"),
        F.col("source").cast("string").alias("o"),
        word_count(F.col("text")).alias("w"),
    )
    same = F.col("i").eqNullSafe(F.col("d")) & F.col("o").eqNullSafe(F.col("s")) & (F.col("w") == F.col("z"))
    taken = rows.join(times, same).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
