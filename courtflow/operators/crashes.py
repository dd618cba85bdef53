"""Which players go for the rebound after a shot, and for which team."""

from pyspark.sql import functions as F

from ..functions.geometry import distance, rounded
from ..functions.slices import slice_of

# Fixed values of the crash rules (frames, pixels).
WINDOW = 90
ZONE, FAR_START = 200, 270
EFFORT = 40
UNDER, UNDER_MOVE = 65, 15


def players_after_shot(shots, players, window=WINDOW):
    """Player rows in [peak, peak + window] of each shot.

    An interval join keyed by frame bins as wide as the interval: a shot lies in at
    most two bins, and a bin holds a bounded number of player rows.
    """
    width = window + 1
    span = shots.select(
        "game",
        "peak_frame",
        F.col("peak_hoop_x").alias("hoop_x"),
        F.col("peak_hoop_y").alias("hoop_y"),
        F.explode(
            F.sequence(
                F.floor(F.col("peak_frame") / width).cast("bigint"),
                F.floor((F.col("peak_frame") + window) / width).cast("bigint"),
            )
        ).alias("bin"),
    )
    rows = players.withColumn("bin", slice_of("frame", width))
    return (
        rows.join(span, ["game", "bin"])
        .where(F.col("frame").between(F.col("peak_frame"), F.col("peak_frame") + window))
        .drop("bin")
    )


def team_majority(rows, keys=("game", "peak_frame", "tid")):
    """Most frequent team among the votes; on a tie the one voted first."""
    keys = list(keys)
    votes = rows.where("team IS NOT NULL").groupBy(*keys, "team").agg(
        F.count("*").alias("votes"), F.min("frame").alias("first")
    )
    return votes.groupBy(*keys).agg(
        F.max_by("team", F.struct("votes", -F.col("first"))).alias("team")
    )


def board_crashes(shots, players):
    """Players that crash the boards: (game, peak_frame, tid, bucket, distances)."""
    rows = players_after_shot(shots, players)
    shot_player = ["game", "peak_frame", "tid"]
    # votes and end points come out of one pass: first per team voted for, then per player
    per_vote = rows.groupBy(*shot_player, "team").agg(
        F.count("*").alias("votes"),
        F.min("frame").alias("first"),
        F.max("frame").alias("last"),
        # column by column, as numbers can be aggregated by hashing
        *[F.min_by(c, "frame").alias(f"a_{c}") for c in ("cx", "cy", "hoop_x", "hoop_y")],
        *[F.max_by(c, "frame").alias(f"b_{c}") for c in ("cx", "cy")],
    )
    a = F.struct(*[F.col(f"a_{c}").alias(c) for c in ("cx", "cy", "hoop_x", "hoop_y")])
    b = F.struct(*[F.col(f"b_{c}").alias(c) for c in ("cx", "cy")])
    rank = F.when(F.col("team").isNotNull(), F.struct("votes", -F.col("first")))
    ends = per_vote.groupBy(*shot_player).agg(
        F.min_by(a, "first").alias("a"),
        F.max_by(b, "last").alias("b"),
        F.max_by("team", rank).alias("team"),
    )
    start = distance("a.cx", "a.cy", "a.hoop_x", "a.hoop_y")
    end = distance("b.cx", "b.cy", "a.hoop_x", "a.hoop_y")
    ends = ends.select(
        "game",
        "peak_frame",
        "tid",
        "team",
        start.alias("start_dist"),
        (start - end).alias("moved"),
        F.col("a.cx").alias("start_x"),
        F.col("a.cy").alias("start_y"),
    )
    crash = ends.where(
        (F.col("start_dist") <= FAR_START)
        & ~((F.col("start_dist") < UNDER) & (F.col("moved") < UNDER_MOVE))
        & ((F.col("start_dist") <= ZONE) | (F.col("moved") >= EFFORT))
    )
    bucket = F.when(
        F.col("team").isin(0, 1), F.concat(F.lit("team_"), F.col("team").cast("string"))
    ).otherwise(F.lit("unknown"))
    return crash.select(
        "game",
        "peak_frame",
        "tid",
        bucket.alias("bucket"),
        rounded("start_dist", 1).alias("initial_dist"),
        rounded("moved", 1).alias("displacement"),
        "start_x",
        "start_y",
    )


def crash_counts(crashes):
    """Crashers per shot and bucket, as columns."""
    wide = (
        crashes.groupBy("game", "peak_frame")
        .pivot("bucket", ["team_0", "team_1", "unknown"])
        .agg(F.count(F.lit(1)))
    )
    return wide.na.fill(0, ["team_0", "team_1", "unknown"])
