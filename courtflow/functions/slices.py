"""Ordered computation per key without ever gathering a whole key in one task.

A game may hold a third of all rows, so no window here is partitioned by the
game alone.  A key's rows are cut into *slices* of its order column, and

* ``halo`` copies the few rows next to a border into the neighbour slice, which
  makes bounded look-back and look-ahead exact inside a slice;
* ``running`` computes unbounded running aggregates as slice-local windows plus a
  carry that is scanned in levels: over one pre-aggregated row per slice inside a group of
  ``SLICES`` slices, and over one row per group;
* ``per_slice`` hands a key's own values (its size, its last frame) to each of its slices, so that
  they can be joined without hashing all rows by the key;
* ``row_blocks`` numbers rows and cuts them into blocks of a fixed row count with
  a fixed number of warm-up rows, for look-back measured in rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

SLICE = 4096
SLICES = 1024


# How the pre-aggregated values of slices are merged, where the name differs.
_MERGE = {"count": "sum", "prevmax": "max"}


def slice_of(order, size=SLICE):
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def dealt(work, per_task):
    """Number of tasks for ``work`` rows to come at about ``per_task`` each, however few bytes they are made from."""
    return max(1, -(-int(work) // per_task))


def halo(df, order="frame", before=0, after=0, size=SLICE, name="slice"):
    """Give every slice the rows up to ``before`` ahead of it and ``after`` behind it.

    Adds ``name`` and the flag ``own``; keep ``own`` rows once the windows are done.
    """
    lo = F.floor((F.col(order) - F.lit(after)) / F.lit(size)).cast("bigint")
    hi = F.floor((F.col(order) + F.lit(before)) / F.lit(size)).cast("bigint")
    spread = df.withColumn(name, F.explode(F.sequence(lo, hi)))
    return spread.withColumn("own", F.col(name) == slice_of(order, size))


def own(df):
    return df.where("own").drop("own")


def per_slice(df, keys, order, size=SLICE, name="slice", **values):
    """``values`` aggregated per ``keys``, one row for each slice of the key's ``order``."""
    of = df.groupBy(*keys).agg(
        *[v.alias(k) for k, v in values.items()], F.min(order).alias("__lo"), F.max(order).alias("__hi")
    )
    every = F.sequence(slice_of("__lo", size), slice_of("__hi", size))
    return of.withColumn(name, F.explode(every)).drop("__lo", "__hi")


_COMBINE = {
    "count": lambda local, carry: F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)),
    "sum": lambda local, carry: F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)),
    "min": lambda local, carry: F.least(local, carry),
    "max": lambda local, carry: F.greatest(local, carry),
    "last": lambda local, carry: F.coalesce(local, carry),
    "prev": lambda local, carry: F.coalesce(local, carry),
    "prevmax": lambda local, carry: F.greatest(local, carry),
    "bit_xor": lambda local, carry: F.coalesce(local, F.lit(0)).bitwiseXOR(F.coalesce(carry, F.lit(0))),
}


def running(df, keys, order, specs, unit=("slice",)):
    """Running aggregates per ``keys`` along ``order``, computed slice by slice.

    ``specs`` maps an output name to ``(kind, column)``; kinds are count, sum, min,
    max, bit_xor, last (latest non-null value so far), prev and prevmax (last and max of the rows
    before).
    ``unit`` names the columns that cut a key into bounded, ordered slices.
    """
    keys, order, unit = list(keys), list(order), list(unit)
    cell = keys + unit
    # Spelled out for both branches below, so that they can share one exchange.
    df = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cell))
    here = Window.partitionBy(*cell).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])

    def local(kind, c):
        if kind == "last":
            return F.last(c, ignorenulls=True).over(upto)
        if kind == "prev":
            return F.last(c, ignorenulls=True).over(before)
        if kind == "prevmax":
            return F.max(c).over(before)
        return getattr(F, kind)(c).over(upto)

    def partial(kind, c):
        if kind in ("last", "prev"):
            return F.max_by(c, F.when(c.isNotNull(), at))
        return getattr(F, _MERGE.get(kind, kind))(c) if kind != "count" else F.count(c)

    def merged(kind, c):
        if kind in ("last", "prev"):
            return F.max_by(c, F.when(c.isNotNull(), F.col(unit[-1])))
        return getattr(F, _MERGE.get(kind, kind))(c)

    def carried(kind, c, by, along):
        w = Window.partitionBy(*by).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
        if kind in ("last", "prev"):
            return F.last(c, ignorenulls=True).over(w)
        return getattr(F, _MERGE.get(kind, kind))(c).over(w)

    def both(kind, near, far):
        return F.when(near.isNotNull() | far.isNotNull(), _COMBINE[kind](near, far))

    top = unit[:-1] + ["__top"]
    parts = df.groupBy(*cell).agg(*[partial(k, c).alias(f"__{n}") for n, (k, c) in specs.items()])
    parts = parts.withColumn("__top", slice_of(unit[-1], SLICES))
    groups = parts.groupBy(*keys, *top).agg(*[merged(k, F.col(f"__{n}")).alias(f"__{n}") for n, (k, _) in specs.items()])
    above = groups.select(
        *keys, *top, *[carried(k, F.col(f"__{n}"), keys, top).alias(f"__t_{n}") for n, (k, _) in specs.items()]
    )
    beside = parts.select(
        *cell, "__top",
        *[carried(k, F.col(f"__{n}"), keys + top, [unit[-1]]).alias(f"__{n}") for n, (k, _) in specs.items()],
    )
    carry = beside.join(above, keys + top).select(
        *cell, *[both(k, F.col(f"__{n}"), F.col(f"__t_{n}")).alias(f"__{n}") for n, (k, _) in specs.items()]
    )
    # A slice with nothing to inherit needs no carry row; that leaves very few for short keys.
    held = F.lit(False)
    for n in specs:
        held = held | F.col(f"__{n}").isNotNull()
    carry = carry.where(held)
    rows = df.select("*", *[local(k, c).alias(f"__l_{n}") for n, (k, c) in specs.items()])
    out = rows.join(carry, cell, "left")
    return out.select(
        *df.columns,
        *[_COMBINE[k](F.col(f"__l_{n}"), F.col(f"__{n}")).alias(n) for n, (k, _) in specs.items()],
    )


def numbered(df, keys, order="frame", name="idx", size=SLICE):
    """``row_number`` (from 1) per key along a unique integer order column."""
    sliced = df.withColumn("__slice", slice_of(order, size))
    return running(
        sliced, keys, [order], {name: ("count", F.lit(1))}, unit=["__slice"]
    ).drop("__slice")


def row_blocks(df, keys, order="frame", before=0, size=SLICE, name="block"):
    """Number the rows of a key and cut them into blocks of ``size`` rows.

    The last ``before`` rows of a block are also handed to the next one (``own`` is
    false there), so a look-back of that many rows is exact and no block is larger
    than ``size + before``.  Adds ``idx`` (from 0).
    """
    rows = numbered(df, keys, order, "idx", size).withColumn("idx", F.col("idx") - 1)
    return halo(rows, "idx", before=before, size=size, name=name)
