"""Team clustering against a plain loop; locks that outlast any silence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtflow.operators import teams
from courtflow.plans.inputs import Inputs
from courtflow.streaming import stateful
from courtflow.streaming.runner import drain


def plain_kmeans(x, centers):
    """(cost, centres) of one run from its first centres."""
    centers = np.array(centers, float)
    for _ in range(100):
        gaps = ((x[:, None] - centers[None]) ** 2).sum(2)
        side = (gaps[:, 0] > gaps[:, 1]).astype(int)
        new = np.array([x[side == k].mean(0) if (side == k).any() else centers[k] for k in (0, 1)])
        if np.allclose(new, centers, rtol=0, atol=1e-12):
            break
        centers = new
    return ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum(), centers


@pytest.mark.parametrize("seed, dims", [(1, 2), (2, 2), (3, 5)])
def test_kmeans_is_the_best_of_all_runs(spark, seed, dims):
    rnd = random.Random(seed)
    spots = [[rnd.uniform(0, 100) for _ in range(dims)] for _ in range(3)]
    x = [[rnd.gauss(v, 12) for v in rnd.choice(spots)] for _ in range(150)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "tid long, v array<double>").repartition(4)
    known = rows.select(F.col("v").alias("__x"))
    first = teams._first_centers(known, 7, 10)
    runs = [plain_kmeans(np.array(x), c) for c in first]
    cost, centers = min(runs, key=lambda r: r[0])
    centers = sorted(centers.tolist())
    got = {r.tid: r.team for r in teams.team_kmeans(rows, columns=("v",)).collect()}
    want = {i: int(sum((p - q) ** 2 for p, q in zip(v, centers[0])) > sum((p - q) ** 2 for p, q in zip(v, centers[1])))
            for i, v in enumerate(x)}
    assert got == want and len({tuple(map(tuple, c)) for c in first}) > 1 and cost > 0


def test_kmeans_odd_rows(spark):
    some = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, 1.0, 2.0)], "tid long, hue double, sat double")
    assert sorted((r.tid, r.team) for r in teams.team_kmeans(some).collect()) == [(1, 0), (2, None), (3, 0)]
    assert teams.team_kmeans(some.limit(0)).count() == 0
    assert [r.team for r in teams.team_kmeans(some.where("tid = 2")).collect()] == [None]


def test_histograms_have_all_bins(spark, sf):
    samples = Inputs(spark, sf).color_samples
    rows = teams.histogram_vectors(teams.color_histogram(samples)).collect()
    assert {len(r.histogram) for r in rows} == {128} and len(rows) == samples.select("tid").distinct().count()
    assert all(abs(sum(v * v for v in r.histogram) - 1) < 1e-9 for r in rows)


def test_a_lock_outlasts_any_silence(spark):
    reads = [(1, 1, f, "7") for f in (1, 2)] + [(1, 1, f, "8") for f in (300_001, 300_002)] + [(1, 2, f, "9") for f in (1, 300_002)]
    given = spark.createDataFrame(reads, "game bigint, tid bigint, frame bigint, num string")
    closing = given.limit(1).withColumns({"frame": F.lit(10**6).cast("bigint"), "tid": F.lit(99).cast("bigint")})
    got = drain(given, lambda s: stateful.jersey_lock(s, 2), "stream-locks", closing=closing, parts=3)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "7", 2), (1, 2, "9", 300_002)]


def test_votes_outlast_any_silence(spark):
    votes = [(1, f, 5, 1) for f in (1, 2, 3)] + [(1, f, 5, 0) for f in (300_001, 300_002)]
    given = spark.createDataFrame(votes, "game bigint, frame bigint, tid bigint, team bigint")
    closing = given.limit(1).withColumns({"frame": F.lit(10**6).cast("bigint"), "tid": F.lit(99).cast("bigint")})
    got = drain(given, lambda s: stateful.team_vote(s, 15), "stream-votes", closing=closing, parts=3)
    assert sorted((r.frame, r.voted) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (300_001, 1), (300_002, 1)]
