"""What a task holds or does follows the work, not the bytes read: results by small and large tasks, and how much is written."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.functions import slices
from courtflow.operators import ball, shots, teams, tracks
from courtflow.plans.inputs import Inputs
from courtflow.session import grouped_in_order
from courtflow.sources import tracking
from courtflow.streaming.held import BLOCK, in_frames, in_order, packs, unpacked
from courtflow.streaming.runner import time_of
from courtflow.streaming.stateful import ColumnWalk, Walk, ghost_step, vote_step
from courtflow.streaming.takeover import Meetings, TrackEvents
from tests.test_rules import brute_reid

DET = "game bigint, frame bigint, seq bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"


def blinking(spark, frames=4000, tids=6):
    """Tracks that are lost again and again: every sighting is an entry, met by all others."""
    rnd = random.Random(3)
    rows = []
    for f in range(frames):
        seen = [t for t in range(tids) if rnd.random() < 0.2]
        rows += [(0, f, k + 1, t, 100 + t, 100, 140 + t, 180) for k, t in enumerate(seen)]
    return rows, spark.createDataFrame(rows, DET)


def test_candidates_are_dealt_by_pairs(spark, sf, monkeypatch):
    dets = Inputs(spark, sf).track_dets
    lost = tracks.lost_registry(dets)
    whole = tracks.reid_candidates(dets, lost)
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(tracks, "PAIRS_PER_TASK", 200)
    few = tracks.reid_candidates(dets, lost)
    assert few.rdd.getNumPartitions() > 4 * whole.rdd.getNumPartitions()
    assert sorted(map(tuple, few.collect())) == want and len(want) > 100


def test_match_writes_no_contact_that_cannot_count(spark, monkeypatch):
    rows, dets = blinking(spark)
    written, staged = [], tracks.staged

    def watched(df, name):
        out = staged(df, name)
        if name == "contacts":
            written.append(out.count())
        return out

    monkeypatch.setattr(tracks, "staged", watched)
    got = tracks.reid_match(dets, tracks.lost_registry(dets)).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute_reid(rows, {}, max(r[1] for r in rows))
    assert 0 < sum(written) < len(rows)  # all of them: 4.9 times the detections


def test_ghosts_are_dealt_by_rows_to_come(spark, monkeypatch):
    _, dets = blinking(spark, frames=1200)
    want = sorted(map(tuple, tracks.ghost_tracks(dets).collect()))
    monkeypatch.setattr(tracks, "GHOSTS_PER_TASK", 1000)
    some = tracks.ghost_tracks(dets)
    sizes = [n for n in some.groupBy(F.spark_partition_id()).count().toPandas()["count"]]
    assert len(sizes) > 3 and sorted(map(tuple, some.collect())) == want


def test_kalman_guesses_hold_and_blocks_are_dealt(spark, monkeypatch):
    rnd, rows = random.Random(2), []
    for f in range(3000):
        x, y = 200 + f % 700 + rnd.randrange(9), 300 + rnd.randrange(9)
        rows.append((0, f, x, y, x + 10, y + 10))
    boxes = spark.createDataFrame(rows, "game bigint, frame bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    walked, staged = [], ball.staged

    def watched(df, name):
        out = staged(df, name)
        if name == "filtered":
            walked.append((out.count(), out.select(F.input_file_name()).distinct().count()))
        return out

    monkeypatch.setattr(ball, "staged", watched)
    monkeypatch.setattr(ball, "SIGHTINGS_PER_TASK", 500)
    assert ball.kalman_smooth(boxes, size=300).count() == 3000
    assert len(walked) == 1 and walked[0][0] == 10 and walked[0][1] > 2  # one walk, in several tasks


def test_settled_runs_are_left_alone(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(0, 1, (40, 3)), rnd.normal(3, 1, (40, 3))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "tid bigint, v array<double>")
    asked, moved = [], teams._moved

    def watched(known, centers):
        asked.append(len(centers))
        return moved(known, centers)

    monkeypatch.setattr(teams, "_moved", watched)
    teams.team_kmeans(rows, columns=("v",)).count()
    assert asked[0] == 10 and asked[-1] < 10


def test_rows_are_walked_and_given_in_bounded_blocks():
    n = 3 * BLOCK + 5
    pdf = pd.DataFrame({"frame": np.arange(n)[::-1] * 40, "tid": 1, "game": 0, "x1": 1, "y1": 1, "x2": 2, "y2": 2, "at": 0})
    step, state, sizes = ghost_step(30), None, []
    for block in in_order(pdf, ["frame"], list(pdf.columns)):
        assert len(block) <= BLOCK
        state, out = step(state, block)
        sizes += [len(part) for part in in_frames(out, ["game", "frame", "tid", "x1", "y1", "x2", "y2", "age"])]
    assert sum(sizes) == 30 * (n - 1) and max(sizes) <= 10_000 and Walk is not None


def test_documents_cross_one_exchange_and_come_back_whole(spark, tmp_path):
    """Objects move once, are grouped in the order of that sort, and are read back without lambdas."""
    box = "x1 double, y1 double, x2 double, y2 double"
    balls = spark.createDataFrame([(0, f, 10.0, 20.0, 13.0, 21.0) for f in range(0, 90, 2)], f"game bigint, frame bigint, {box}")
    hoops = [(g, f, i, 1.0 + i, 2.0, 3.0, 4.0) for g in (0, 1, None) for f in range(0, 90, 3) for i in (1, 0, 0)]
    players = [(1, f, t, 5.5, 6.0, 7.0, -8.5, t if t else None) for f in range(90) for t in (12, 0, 7)]
    hoops = spark.createDataFrame(hoops, f"game bigint, frame bigint, idx bigint, {box}")
    players = spark.createDataFrame(players, f"game bigint, frame bigint, tid bigint, {box}, team bigint")
    records = tracking.frame_records(balls, hoops, players, stretch=16)
    with grouped_in_order(spark):
        plan = tracking.documents(records)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("SortAggregate") == 2 and "HashAggregate" not in plan
        assert plan.count("Sort [") == 1  # the second grouping uses the order of the first
    assert spark.conf.get("spark.sql.execution.replaceHashWithSortAgg") == "false"
    path = str(tmp_path / "docs")
    tracking.write_documents(records, path)
    objects = tracking.read_objects(spark, path)
    assert "lambda" not in objects._jdf.queryExecution().executedPlan().toString()
    got = sorted((int(r.video[-1]), *r[1:]) for r in objects.where("video IS NOT NULL").collect())
    want = [(0, f, "ball", 0, 11, 20, 10, 20, 13, 21, None) for f in range(0, 90, 2)]
    for g in (0, 1):
        for f in range(0, 90, 3):
            want += [(g, f, "hoop", k, 2, 3, 1 + i, 2, 3, 4, None) for k, i in enumerate((0, 0, 1))]
    want += [(1, f, "player", t, 6, -1, 5, 6, 7, -8, t or None) for f in range(90) for t in (0, 7, 12)]
    assert got == sorted(want) and objects.where("video IS NULL").count() == 90
    assert spark.read.json(path).count() == 3 * 6  # a document per part


def test_flight_steps_go_through_slices_once(spark, monkeypatch):
    """Flights over many slices, with and without hoops, against windows over whole flights."""
    monkeypatch.setattr(slices, "SLICES", 3)
    monkeypatch.setattr(shots, "SLICES", 3)
    rnd, rows = random.Random(9), []
    for game in (0, 1, 2, None):
        frame = 1000 * (game or 0)
        for _ in range(14):
            hooped = rnd.random()
            for _ in range(rnd.choice((1, 3, 30, 150))):
                hoop = 100.0 if rnd.random() < hooped else None
                rows.append((game, frame, float(rnd.randrange(200)), float(rnd.randrange(200)), hoop, hoop))
                frame += rnd.choice((1, 1, 2, 9))
            frame += rnd.choice((11, 60, 400))
    points = spark.createDataFrame(rows, "game bigint, frame bigint, cx double, cy double, hoop_x double, hoop_y double")
    read, staged = [], shots.staged

    def watched(df, name):
        read.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, name)

    monkeypatch.setattr(shots, "staged", watched)
    got = shots.flight_steps(points, size=16, keep=True)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # before: slices computed four times
    assert [n for n, _ in read] == ["flight-pieces", "slice-ends", "flight-carries"] and read[0][1].count("Exchange") == 1
    whole = shots.flight_points(points, size=16)
    w = Window.partitionBy("game", "flight").orderBy("frame")
    near = F.when(F.col("dist").isNotNull(), F.struct("dist", "n", "frame"))
    want = whole.withColumns(
        {
            "near": F.min(near).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "dist_prev": F.last("dist", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    far = F.coalesce((F.col("near.dist") < 40) & (F.col("dist") > F.col("near.dist") + 35), F.lit(False))
    want = want.withColumn("stop", far)
    assert sorted(got.columns) == sorted(want.columns)
    lines = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    want = staged(want, "want")
    wanted = lines(want)
    assert want.where("game = 2 AND stop").count() > 0
    assert lines(got) == wanted and len(wanted) == sum(r[0] is not None for r in rows)
    assert lines(shots.flight_steps(points, size=16)) == wanted
    best = lambda df: df.groupBy("game", "flight").agg(
        F.coalesce(F.min_by("near", F.when(F.col("stop"), F.col("n"))), F.min("near")).alias("b")
    ).select("game", "flight", "b.*")
    named = [F.col("best_dist").alias("dist"), F.col("best_n").alias("n"), F.col("peak_frame").alias("frame")]
    assert lines(shots.flights(got).select("game", "flight", *named)) == lines(best(want))


def test_a_frame_given_twice_has_a_closest_approach(spark):
    """Columns that nobody asks for are not computed: no speed between two points of one frame."""
    rows = [(0, f, 10.0 * f, 5.0, 100.0, 5.0) for f in range(12) for _ in (0, 1)]
    points = spark.createDataFrame(rows, "game bigint, frame bigint, cx double, cy double, hoop_x double, hoop_y double")
    found = shots.flights(shots.flight_steps(points)).select("points", "best_dist", "peak_frame").collect()
    assert [tuple(r) for r in found] == [(24, 0.0, 10)]


class Kept:
    """A list, value or map of a state store."""

    def __init__(self):
        self.values = []
        self.map = {}

    def exists(self):
        return bool(self.values or self.map)

    def get(self):
        return self.values[0] if isinstance(self.values, tuple) else iter(self.values)

    def update(self, value):
        self.values = (value,)

    def appendValue(self, value):
        self.values = [*self.values, value]

    def clear(self):
        self.values = []

    def iterator(self):
        return iter(list(self.map.items()))

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)


class Handle:
    def __getattr__(self, name):
        return (lambda *_: None) if name == "registerTimer" else (lambda *_: Kept())


class At:
    def __init__(self, frame):
        self.frame = frame

    def getCurrentWatermarkInMs(self):
        return time_of(self.frame)


def test_stream_contacts_end_when_a_track_must_have_taken_over(spark):
    """As many contacts of a track as there are tracks decide; events reach the next step as a few packed rows."""
    rows, _ = blinking(spark, frames=3000, tids=8)
    tracks = {t: TrackEvents(300, 600, 2) for t in range(8)}
    for step in tracks.values():
        step.init(Handle())
    places, contacts, passed = {}, 0, 0
    for upto in (1000, 2000, 3000):
        events = []
        for tid, step in tracks.items():
            mine = [(f, "d", seq, (x1 + x2) / 2.0, (y1 + y2) / 2.0, None, time_of(f)) for _, f, seq, t, x1, y1, x2, y2 in rows
                    if t == tid and upto - 1000 <= f < upto]
            pdf = pd.DataFrame(mine, columns=["frame", "kind", "seq", "x", "y", "num", "at"])
            list(step.handleInputRows((0, tid), iter([pdf]), At(upto)))
            events += list(step.handleExpiredTimer((0, tid), At(upto), None))
        events = pd.concat(events)
        passed += len(events)
        for place, some in events.groupby("place"):
            if place not in places:
                places[place] = Meetings(300, 600)
                places[place].init(Handle())
            contacts += sum(len(p) for p in places[place].handleInputRows((0, place), iter([some]), At(upto)))
    assert 8 <= contacts <= 8 * 2 * 8  # before: every track with every entry, more than the rows
    assert passed < len(rows) / 3


def test_votes_reach_the_stateful_step_packed_by_track():
    """A row per track and stretch goes through the step, not one per vote; what comes later than the watermark is dropped."""
    rnd, rows = random.Random(4), []
    for tid in (0, 1, None):
        rows += [(0, tid, f, rnd.randrange(2)) for f in range(600) if rnd.random() < 0.7]
    rnd.shuffle(rows)
    frames = pa.array([r[2] for r in rows])
    table = pa.table({
        "game": pa.array([r[0] for r in rows]), "tid": pa.array([r[1] for r in rows], pa.int64()), "frame": frames,
        "team": pa.array([r[3] for r in rows]), "at": pa.array([time_of(r[2]) for r in rows]),
        "event_time": pa.array([time_of(r[2]) * 1000 for r in rows], pa.timestamp("us", "UTC")),
    })
    given = [b.to_pylist() for b in packs(["game", "tid"], ["game", "tid", "frame", "team", "at"], size=400)(table.to_batches(max_chunksize=150))]
    assert sum(map(len, given)) <= 3 * len(given) < len(rows) / 30
    for tid in (0, 1, None):
        mine = [r for part in given for r in part if r["tid"] == tid]
        assert sorted(f for r in mine for f in unpacked(r["rows"])["frame"]) == sorted(r[2] for r in rows if r[1] == tid)
        assert all(r["upto"] == unpacked(r["rows"])["at"].max() == r["event_time"].timestamp() * 1000 for r in mine)
        walk = ColumnWalk(vote_step(15), ["frame"], ["game", "tid", "frame", "team", "at"], ["game", "frame", "tid", "voted"], None)
        walk.init(Handle())
        list(walk.handleInputRows((0, tid), iter([pd.DataFrame(mine)]), At(-1)))
        got = [r for upto in (40, 300, 700) for out in walk.handleExpiredTimer((0, tid), At(upto), None) for r in out.itertuples(index=False)]
        list(walk.handleInputRows((0, tid), iter([pd.DataFrame(mine)]), At(550)))
        late = [r for out in walk.handleExpiredTimer((0, tid), At(700), None) for r in out.itertuples(index=False)]
        assert sorted(r.frame for r in late) == sorted(r[2] for r in rows if r[1] == tid and r[2] > 550)
        votes, want = [], []
        for _, _, frame, team in sorted((r for r in rows if r[1] == tid), key=lambda r: r[2]):
            votes = (votes + [team])[-15:]
            want.append((0, frame, tid, 1 if 2 * sum(votes) > len(votes) else 0 if 2 * sum(votes) < len(votes) else votes[0]))
        assert [(r.game, r.frame, None if pd.isna(r.tid) else r.tid, r.voted) for r in got] == want
