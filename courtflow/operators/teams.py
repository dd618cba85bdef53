"""Numbers, teams and colours of tracked players."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import d
from ..functions.slices import own, row_blocks
from ..session import staged
from .gates import digit_read_gate

# Fixed values of the colour features and votes.
CONFIRM_READS = 2
HUE_BINS, SAT_BINS, HUE_STEP, SAT_STEP = 18, 5, 10, 51
HIST_BINS = 128
DARK, GLARE, MIN_SAMPLES = 20, 245, 25
VOTE_WINDOW = 15
WOOD_H, WOOD_S, WOOD_V, WOOD_SHARE = (10, 30), (30, 180), (120, 240), 0.15


def jersey_lock(reads, confirm=CONFIRM_READS):
    """First number that a player was read with ``confirm`` times.

    ``row_number`` with a limit lets Spark drop all later reads of a number before the
    shuffle, however often one player was read.
    """
    w = Window.partitionBy("game", "tid", "num").orderBy("ord")
    rows = digit_read_gate(reads).select("game", "tid", "num", "ord", "frame")
    nth = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= confirm)
    nth = nth.where(F.col("rn") == confirm)
    return nth.groupBy("game", "tid").agg(
        F.min_by("num", "ord").alias("num"),
        F.min("ord").alias("lock_ord"),
        F.min_by("frame", "ord").alias("lock_frame"),
    )


def dominant_bin(samples):
    """Centre of each player's fullest hue-saturation bin; players with few samples drop out."""
    kept = samples.where(F.col("v").between(DARK, GLARE))
    hb = F.least(F.floor(F.col("h") / HUE_STEP), F.lit(HUE_BINS - 1))
    sb = F.least(F.floor(F.col("s") / SAT_STEP), F.lit(SAT_BINS - 1))
    per_bin = kept.groupBy("tid", (hb * SAT_BINS + sb).alias("bin")).agg(F.count("*").alias("n"))
    per = per_bin.groupBy("tid").agg(
        F.sum("n").alias("samples"), F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin")
    )
    return per.where(F.col("samples") >= MIN_SAMPLES).select(
        "tid",
        "samples",
        (F.floor(F.col("bin") / SAT_BINS) * HUE_STEP + 5).alias("hue"),
        (F.col("bin") % SAT_BINS * SAT_STEP + 25).alias("sat"),
    )


def color_histogram(samples, hue_bins=16, sat_bins=8):
    """Sparse 128-cell hue-saturation histogram per player, scaled to unit length."""
    hb = F.floor(F.col("h") * hue_bins / 180)
    sb = F.floor(F.col("s") * sat_bins / 256)
    cells = samples.groupBy("tid", (hb * sat_bins + sb).alias("bin")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("tid")).cast("double"))
    return cells.select("tid", "bin", (F.col("n") / norm).alias("value"))


def histogram_vectors(cells, bins=HIST_BINS):
    """``color_histogram``'s cells (tid, bin, value) as one array of all bins per track."""
    filled = F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), "value")))
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("m")[b], d(0)))
    return cells.groupBy("tid").agg(filled.alias("m")).select("tid", every.alias("histogram"))


def range_ratio(samples):
    """Share of floor-coloured samples, and whether it suffices to call the court visible."""
    hit = (
        F.col("h").between(*WOOD_H) & F.col("s").between(*WOOD_S) & F.col("v").between(*WOOD_V)
    )
    per = samples.groupBy("tid").agg(F.avg(hit.cast("double")).alias("share"))
    return per.withColumn("visible", F.col("share") >= WOOD_SHARE)


def team_kmeans(features, columns=("hue", "sat"), seed=7, starts=10, rounds=100):
    """Two teams from colour features: the best of ``starts`` k-means runs, clusters in the order of their centres.

    All runs go side by side: a round is one pass over the features, which sums them per run and centre before anything
    is shuffled, for the runs whose centres still move. First centres are drawn by hashes of ``seed`` and the features: any row, and one by its squared
    distance from it. A run that finds an empty cluster keeps that centre; rounds end when no centre moves, or after
    ``rounds``. ``columns`` are numbers, or one array of numbers (a histogram); rows with a null in them have no team.
    """
    one = len(columns) == 1 and dict(features.dtypes)[columns[0]].startswith("array")
    vector = F.col(columns[0]).cast("array<double>") if one else F.array(*[F.col(c).cast("double") for c in columns])
    rows = staged(features.withColumn("__x", vector), "team-features")
    known = rows.where("__x is not null and forall(__x, v -> v is not null)").select("__x")
    centers = _first_centers(known, seed, starts)
    if not centers:
        return features.withColumn("team", F.lit(None).cast("int"))
    live = list(range(len(centers)))
    for _ in range(rounds):
        before, now = [centers[k] for k in live], _moved(known, [centers[k] for k in live])
        for k, pair in zip(live, now):
            centers[k] = pair
        least = 1e-9 * max(abs(v) for pair in centers for c in pair for v in c)
        step = lambda a, b: max(abs(p - q) for c, e in zip(a, b) for p, q in zip(c, e))
        live = [k for k, a, b in zip(live, before, now) if not step(a, b) <= least]
        if not live:
            break
    best = min(_costs(known, centers))[1]
    pair = sorted(centers[best])
    team = F.when(_apart(pair[0]) <= _apart(pair[1]), 0).when(_apart(pair[1]).isNotNull(), 1)
    return rows.withColumn("team", team.cast("int")).drop("__x")


def _apart(center):
    """Squared distance of ``__x`` from a centre."""
    at = F.array(*[F.lit(float(v)) for v in center])
    return F.aggregate(F.zip_with("__x", at, lambda a, b: (a - b) * (a - b)), d(0), lambda s, v: s + v)


def _first_centers(known, seed, starts):
    """Two centres per run: the row of the least hash, and the one that wins a race at the rate of its squared distance."""
    draw = lambda k, side: F.xxhash64(F.lit(seed + k), F.lit(side), "__x")
    first = known.agg(*[F.min_by("__x", draw(k, 0)).alias(f"c{k}") for k in range(starts)]).first()
    if first["c0"] is None:
        return []
    chance = lambda k: (F.pmod(draw(k, 1), F.lit(1 << 52)) + 1) / float(1 << 52)
    race = lambda k: F.when(_apart(first[f"c{k}"]) > 0, -F.ln(chance(k)) / _apart(first[f"c{k}"]))
    second = known.agg(*[F.min_by("__x", race(k)).alias(f"c{k}") for k in range(starts)]).first()
    return [[list(first[f"c{k}"]), list(second[f"c{k}"] or first[f"c{k}"])] for k in range(starts)]


def _moved(known, centers):
    """The centres of all runs after one round: means of the rows nearest to each, the first one on a tie."""
    size = len(centers[0][0])

    def apart(x, center):
        total = np.zeros(x.shape[1])
        for i, v in enumerate(center):  # summed in the order of ``_apart``
            total += (x[i] - v) * (x[i] - v)
        return total

    def sums(frames):
        n, total = np.zeros((len(centers), 2), dtype="int64"), np.zeros((len(centers), 2, size))
        for pdf in frames:
            if len(pdf):
                x = np.ascontiguousarray(np.stack(pdf["__x"].to_numpy()).T)
                for k, (a, b) in enumerate(centers):
                    near, far = apart(x, a), apart(x, b)
                    first = (near <= far) | np.isnan(far)  # nothing is greater than nan
                    for side, mine in enumerate((first, ~first)):
                        n[k, side] += mine.sum()
                        total[k, side] += x[:, mine].sum(axis=1)
        yield pd.DataFrame(
            [(k, side, int(n[k, side]), total[k, side].tolist()) for k in range(len(centers)) for side in (0, 1) if n[k, side]],
            columns=["run", "side", "n", "total"],
        )

    parts = known.select("__x").mapInPandas(sums, "run int, side int, n bigint, total array<double>")
    means = [(F.sum(F.col("total")[i]) / F.sum("n")).alias(f"m{i}") for i in range(size)]
    out = [[list(c) for c in pair] for pair in centers]
    for r in parts.groupBy("run", "side").agg(*means).collect():
        out[r.run][r.side] = [r[f"m{i}"] for i in range(size)]
    return out


def _costs(known, centers):
    """(cost, run) of each run."""
    sums = known.agg(*[F.sum(F.least(_apart(a), _apart(b))).alias(f"c{k}") for k, (a, b) in enumerate(centers)]).first()
    return [(sums[f"c{k}"], k) for k in range(len(centers))]


def team_rolling_vote(votes, window=VOTE_WINDOW):
    """Majority of each player's last 15 votes (teams 0/1); a tie goes to the oldest vote."""
    rows = row_blocks(
        votes.where("team IS NOT NULL").select("game", "frame", "tid", "team"),
        ["game", "tid"],
        before=window - 1,
    )
    w = Window.partitionBy("game", "tid", "block").orderBy("idx").rowsBetween(1 - window, 0)
    ones, n, oldest = F.sum("team").over(w), F.count("*").over(w), F.first("team").over(w)
    label = F.when(ones * 2 > n, 1).when(ones * 2 < n, 0).otherwise(oldest).cast("bigint")
    return own(rows.withColumn("voted", label)).select("game", "frame", "tid", "voted")


def sample_cap(samples, per_track, total):
    """First ``per_track`` samples of a track, until ``total`` samples have been taken.

    The total is checked between frames, so the frame that reaches it is still taken
    whole: that is ``rank() <= total``.  Both limits are applied before the shuffle.
    """
    track = Window.partitionBy("game", "tid").orderBy("frame", "seq")
    rows = samples.withColumn("rn", F.row_number().over(track)).where(F.col("rn") <= per_track)
    game = Window.partitionBy("game").orderBy("frame")
    return rows.drop("rn").withColumn("rk", F.rank().over(game)).where(F.col("rk") <= total).drop("rk")


def class_centers(vectors):
    """Mean vector per label, as one row holding all k centres in label order."""
    at = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
    cell = at.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    per = cell.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
    per = per.select("label", F.col("c.v").alias("c"))
    return per.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("centers"))


def nearest_center(vectors, centers):
    """Nearest of the k centres by Euclidean distance, the first one on a tie.

    The k centres reach the scan as one scalar value, so no join is needed.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    gap = lambda c: F.sqrt(
        F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), d(0), lambda s, v: s + v)
    )
    rows = vectors.withColumn("centers", centers.scalar())
    best = F.array_min(
        F.transform("centers", lambda c: F.struct(gap(c["c"]).alias("gap"), c["label"].alias("center")))
    )
    return rows.select("vec_id", best["center"].alias("center"), best["gap"].alias("gap"))
