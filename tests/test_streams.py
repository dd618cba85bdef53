"""Chained keyed streams against plain loops, fed out of order, and what is left of their state."""

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from courtflow.functions import steps
from courtflow.operators import ball, teams, tracks
from courtflow.streaming import stateful, takeover
from courtflow.streaming.runner import drain
from tests.test_rules import brute_reid

DET = "game bigint, frame bigint, seq bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


@pytest.mark.parametrize("seed", [1, 2])
def test_take_over_by_number_and_distance(spark, seed):
    rnd, rows = random.Random(seed), []
    for tid in range(30):
        start, x, y = rnd.randrange(0, 2500), rnd.randrange(0, 1200), rnd.randrange(0, 700)
        for f in range(start, start + rnd.randrange(3, 60)):
            if rnd.random() < 0.8:
                rows.append((0, f, tid + 1, tid, x, y, x + 40, y + 80))
                x += rnd.randrange(-9, 10)
    last = max(r[1] for r in rows)
    locks, reads = {}, []
    for tid in range(0, 30, 2):
        locks[tid] = (str(tid % 4), rnd.randrange(1, 2500))
        reads += [(0, tid, f, locks[tid][0]) for f in (locks[tid][1] - 1, locks[tid][1], locks[tid][1] + 3)]
    dets = spark.createDataFrame(rows, DET)
    worn = spark.createDataFrame(reads, "game bigint, tid bigint, frame bigint, num string")
    ends = dets.select("game", "tid").union(worn.select("game", "tid")).distinct()
    ends = ends.withColumn("frame", F.lit(last + 700).cast("bigint"))
    closing = dets.limit(1).withColumns({"frame": F.lit(10**6).cast("bigint"), "tid": F.lit(99).cast("bigint")})
    held = []
    given = takeover.events(dets, worn, ends)
    got = drain(
        given,
        lambda s: takeover.reid(s, tracks.REID_DIST, tracks.REID_FRAMES, teams.CONFIRM_READS),
        "stream-take-over",
        closing=takeover.events(closing, worn.limit(0), ends.limit(0)),
        parts=3,
        watch=lambda q: held.append([s["numRowsTotal"] for s in q.lastProgress["stateOperators"]]),
    )
    want = brute_reid(rows, locks, last)
    assert sorted(tuple(r)[:4] for r in got.collect()) == want and len(want) > 5
    # when the game is over, only the closing row's own track is left
    assert sum(held[-1]) <= 6 < max(map(sum, held[:-1]))


def test_take_over_of_blinking_tracks(spark):
    """Tracks lost again and again all over the place, and beyond its border: each meets many more entries than there are tracks."""
    rnd, rows, reads = random.Random(8), [], []
    for f in range(900):
        for tid in range(f // 90, 9 + f // 150):
            if rnd.random() < 0.15:
                x, y = rnd.randrange(-900, 2200), rnd.randrange(-300, 1000)
                rows.append((0, f, tid + 1, tid, x, y, x + 40, y + 80))
    locks = {tid: (str(tid % 3), 40 + 70 * tid) for tid in range(0, 12, 2)}
    reads = [(0, tid, frame - late, num) for tid, (num, frame) in locks.items() for late in (3, 0)]
    last = max(r[1] for r in rows)
    dets = spark.createDataFrame(rows, DET)
    worn = spark.createDataFrame(reads, "game bigint, tid bigint, frame bigint, num string")
    ends = dets.select("game", "tid").distinct().withColumn("frame", F.lit(last + 1).cast("bigint"))
    given = takeover.events(dets, worn, ends)
    build = lambda s: takeover.reid(s, tracks.REID_DIST, tracks.REID_FRAMES, teams.CONFIRM_READS)
    got = drain(given, build, "stream-blinking", closing=closing_row(given.where("kind = 'd'")), parts=4)
    want = brute_reid(rows, locks, last)
    assert sorted(tuple(r)[:4] for r in got.collect()) == want and len(want) > 9


def closing_row(rows, frame=10**6):
    return rows.orderBy(F.desc("frame")).limit(1).withColumn("frame", F.lit(frame).cast("bigint"))


def test_kalman_slices_equal_one_walk_over_a_long_gap(spark):
    rnd, rows, x, y = random.Random(5), [], 300.0, 300.0
    frames = [f for f in range(900) if rnd.random() < 0.8] + [f for f in range(300_500, 300_900) if rnd.random() < 0.5]
    for f in frames:
        x, y = (rnd.uniform(0, 1280), rnd.uniform(0, 720)) if rnd.random() < 0.02 else (x + rnd.gauss(2, 9), y + rnd.gauss(0, 9))
        rows.append((0, f, x, y))
    state, want = None, {}
    for _, f, cx, cy in rows:
        state = steps.kalman_step(state, f, cx, cy, 50)
        want[f] = state[:4]
    given = spark.createDataFrame(rows, "game bigint, frame bigint, cx double, cy double")
    got = drain(given, lambda s: stateful.kalman(s, 50, size=128), "stream-filter", closing=closing_row(given))
    got = {r.frame: r for r in got.collect()}
    assert set(got) == set(want)
    assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for f, w in want.items() for a, b in zip(got[f][2:], w))


def test_kalman_slice_that_no_tried_start_leads_into(spark):
    """A ball that gets too fast for a filter that starts anew at a border, but not for one that knows its speed."""
    rows, x, state, want = [], 0.0, None, {}
    for f in range(0, 1000, 2):
        x += min(f / 2, 80) + f % 7 / 10
        rows.append((0, f, x, 300.0))
        state = steps.kalman_step(state, f, x, 300.0, 50)
        want[f] = state[:4]
    assert max(b[2] - a[2] for a, b in zip(rows, rows[1:])) > 50 and min(w[1] for f, w in want.items() if f > 200) > 35
    given = spark.createDataFrame(rows, "game bigint, frame bigint, cx double, cy double")
    got = drain(given, lambda s: stateful.kalman(s, 50, size=128), "stream-fast", closing=closing_row(given))
    got = {r.frame: r for r in got.collect()}
    assert set(got) == set(want)
    assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for f, w in want.items() for a, b in zip(got[f][2:], w))


@pytest.mark.parametrize("hoops", [0.0, 0.3, 1.0])
def test_validation_slices_equal_one_walk(spark, hoops):
    rnd, rows = random.Random(int(10 * hoops)), []
    frames = [f for f in range(500) if rnd.random() < 0.9] + list(range(300_600, 300_700))
    for f in frames:
        for seq in range(rnd.randrange(1, 4)):
            top = (float(rnd.randrange(50, 300)), float(rnd.randrange(0, 1280))) if rnd.random() < hoops else (None, None)
            rows.append((0, f, seq, 0.5, rnd.uniform(200, 500), rnd.uniform(0, 400), float(rnd.randrange(9)), *top))
    schema = "game bigint, frame bigint, seq bigint, conf double, cx double, cy double, area double, hoop_top double, hoop_x double"
    step, state, want = ball.export_step(60), list(steps.NOWHERE), []
    row = namedtuple("Row", ball.CANDIDATE)
    for f in frames:
        state, out = step(state, f, [row(*r) for r in rows if r[1] == f])
        want += out
    given = spark.createDataFrame(rows, schema)
    build = lambda s: stateful.ball_validate(s, 60, size=40)
    got = drain(given, build, "stream-checks", closing=closing_row(given))
    assert sorted(map(tuple, got.collect())) == sorted(want) and 0 < len(want) < len(rows)
