"""Rule boundaries on hand-written rows, and sequential operators against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from courtflow.functions import steps
from courtflow.operators import ball, gates, labels, shots, teams, tracks
from courtflow.plans.inputs import Inputs
from courtflow.plans.registry import QUERIES
from courtflow.plans.streams import late
from courtflow.sources import labels as label_files
from courtflow.streaming import stateful
from courtflow.streaming.runner import drain


def points(spark, rows):
    return spark.createDataFrame(rows, "game bigint, frame bigint, cx double, cy double, hoop_x double, hoop_y double")


# ---- flights and shots --------------------------------------------------------------


def test_flight_gap(spark):
    rows = [(0, f, 1.0, 1.0, None, None) for f in (1, 11, 22, 30)]
    got = shots.flight_points(points(spark, rows), size=8).orderBy("frame").collect()
    assert [r.flight for r in got] == [1, 1, 22, 22]


@pytest.mark.parametrize("size", [64, 300])
def test_small_slices_change_nothing(spark, sf, size):
    src = Inputs(spark, sf)
    cols = ["game", "flight", "points", "best_k", "peak_frame", "verdict", "release_frame"]
    want = shots.shot_candidates(src.ball_points).select(*cols).collect()
    got = shots.shot_candidates(src.ball_points, size=size).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_flight_over_many_slices(spark):
    """A flight of 3000 points in 47 slices; its minimum comes before the rebound stops it."""
    rows = []
    for f in range(3000):
        d = abs(1500 - f) + 5.0 if f < 1600 else 20.0
        rows.append((0, f, 600.0 + d, 300.0, 600.0, 300.0))
    got = shots.flights(shots.flight_steps(points(spark, rows), size=64)).collect()
    assert len(got) == 1 and got[0].points == 3000
    assert got[0].best_k == 1500 and got[0].best_dist == 5.0


@pytest.mark.parametrize("size", [5, 40, 2048])
def test_kalman_blocks_equal_one_walk(spark, size):
    """Blocks too short to forget their start, resets and a long gap; x, speed and both games to 1e-9."""
    rnd, rows, want = random.Random(size), [], {}
    for game in (1, 2):
        state, x, y, f = None, 400.0, 300.0, 0
        for _ in range(160):
            f += rnd.choice([1, 1, 1, 2, 4, 7]) if rnd.random() > 0.01 else 300_000
            x, y = (rnd.uniform(0, 1280), rnd.uniform(0, 720)) if rnd.random() < 0.04 else (x + rnd.gauss(3, 8), y + rnd.gauss(0, 8))
            box = (int(x) - 4, int(y) - 4, int(x) + 4, int(y) + 4)
            state = steps.kalman_step(state, f, (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, ball.TELEPORT["strict"])
            rows.append((game, f, *box))
            want[game, f] = state[:4]
    boxes = spark.createDataFrame(rows, "game bigint, frame bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint").repartition(3)
    smoothed = ball.kalman_smooth(boxes, size=size)
    assert not re.search("Python|Pandas|Arrow", smoothed._jdf.queryExecution().toString())
    got = {(r.game, r.frame): (r.sx, r.svx, r.sy, r.svy) for r in smoothed.collect()}
    assert set(got) == set(want)
    assert all(abs(a - b) <= 1e-7 * max(1, abs(b)) for k, w in want.items() for a, b in zip(got[k], w))


def test_cooldown_over_slices_and_groups(spark):
    """One game of close candidates over many slices and groups of slices, one with long silences, against a loop."""
    rnd, rows, want = random.Random(8), [], set()
    for game, span, often in ((1, 30_000, 0.2), (2, 300_000, 0.004), (3, 260_000, 0.03)):
        peaks = [p for p in range(span) if rnd.random() < often and not (game == 3 and 70_000 < p < 205_000)]
        rows += [(p, f"x{p}", game) for p in peaks]
        last = None
        for p in peaks:
            if last is None or p - last >= 60:
                last = p
                want.add((game, p))
    shuffled = spark.createDataFrame(rows, "peak_frame bigint, other string, game bigint").repartition(5)
    got = shots.cooldown(shuffled, size=64)
    assert got.columns == ["peak_frame", "other", "game", "accepted"] and got.count() == len(rows)
    assert {(r.game, r.peak_frame) for r in got.where("accepted").collect()} == want


def test_cooldown(spark):
    peaks = [(0, p) for p in (100, 159, 160, 219, 220, 400, 459, 518)] + [(1, 5), (1, 64), (1, 65)]
    got = shots.cooldown(spark.createDataFrame(peaks, "game bigint, peak_frame bigint"))
    kept = sorted((r.game, r.peak_frame) for r in got.where("accepted").collect())
    assert kept == [(0, 100), (0, 160), (0, 220), (0, 400), (0, 518), (1, 5), (1, 65)]


# ---- labels -------------------------------------------------------------------------


LABEL = "ord bigint, game bigint, frame bigint, frame_path string, visibility bigint, x double, y double"


def label_table(spark, rows):
    data = [(o, 0, f, f"data/x/game_01/frame_{f:06d}.jpg", v, x, y) for o, f, v, x, y in rows]
    return spark.createDataFrame(data, LABEL)


def test_audit_distance_and_confidence(spark):
    rows = label_table(spark, [(1, 1, 1, 200.0, 200.0), (2, 2, 1, 200.0, 200.0), (3, 3, 0, -1.0, -1.0), (4, 4, 1, 200.0, 200.0)])
    preds = spark.createDataFrame(
        [(0, 1, 115.0, 100.0, 0.5), (0, 2, 115.1, 100.0, 0.9), (0, 3, 1.0, 1.0, 0.5), (0, 4, 100.0, 100.0, 0.49)],
        "game bigint, frame bigint, pred_x double, pred_y double, conf double",
    )
    got = {r.ord: r.category for r in labels.audit(rows, preds).collect()}
    assert got == {2: labels.PM, 3: labels.FN, 4: labels.FP}


FIX = "folder string, stem string, category string, pred_x double, pred_y double, pred_conf double, distance_px double, fix_ord bigint"


def test_patch_priority_and_fall_through(spark):
    rows = gates.frame_keys(label_table(spark, [(1, 10, 1, 5.0, 5.0), (2, 90, 1, 5.0, 5.0), (3, 20, 0, -1.0, -1.0)]))
    stem = "frame_{:06d}".format
    fixes = spark.createDataFrame(
        [
            ("game_01", stem(10), labels.FP, None, None, None, None, 1),
            ("game_01", stem(10), labels.PM, 7.0, 7.0, None, 30.0, 1),
            ("game_01", stem(90), labels.FP, None, None, None, None, 2),
            ("game_01", stem(90), labels.PM, 1.0, 1.0, None, 30.0, 2),
            ("game_01", stem(90), labels.PM, 7.26, 8.0, None, 15.0, 3),
            ("game_01", stem(20), labels.FN, 3.0, 4.0, 0.5, None, 4),
        ],
        FIX,
    )
    got = {r.ord: r for r in labels.label_patch(rows, fixes, max_fp=50, scale_x=2.0).collect()}
    assert got[1].action == "removed" and got[1].x == -1.0
    assert got[2].action == "repositioned" and got[2].skipped_fp and (got[2].x, got[2].y) == (14.5, 8.0)
    assert got[3].action == "added" and got[3].visibility == 1 and got[3].x == 6.0
    off = {r.ord: r.action for r in labels.label_patch(rows, fixes, False, False, max_fp=50).collect()}
    assert off == {1: "removed", 2: None, 3: None}


def test_split_tail_keeps_at_least_one(spark):
    rows = label_table(spark, [(i, i, 1, 1.0, 1.0) for i in range(1, 4)])
    got = {r.ord: r.split for r in labels.split_tail(rows).collect()}
    assert got == {1: "train", 2: "train", 3: "val"}


def test_triplets_stop_at_gaps_and_folders(spark):
    rows = label_table(spark, [(i, f, 1, 1.0, 1.0) for i, f in enumerate((1, 2, 3, 5, 6, 7), 1)])
    assert sorted(r.ord for r in labels.frame_triplets(rows).collect()) == [3, 6]


def test_review_readers(spark, tmp_path):
    for game, stem in (("game_01", "frame_000001"), ("game_02", "frame_000002")):
        folder = tmp_path / "tree" / "false_positives" / game
        folder.mkdir(parents=True)
        (folder / f"{stem}.jpg").write_bytes(b"x")
        (folder / "note.txt").write_text("no image")
    got = label_files.read_review_tree(spark, str(tmp_path / "tree")).collect()
    assert sorted(tuple(r) for r in got) == [
        ("false_positives", "game_01", "frame_000001"), ("false_positives", "game_02", "frame_000002")]
    listed = tmp_path / "list.txt"
    listed.write_text("# note\n\ngame_01\\frame_000001.png\na/game_02/frame_000002\nbare\n")
    got = label_files.read_review_list(spark, str(listed)).collect()
    assert sorted(tuple(r) for r in got) == [("game_01", "frame_000001"), ("game_02", "frame_000002")]


def test_polygon_files(spark, tmp_path):
    (tmp_path / "frame_0001_jpg.rf.a.txt").write_text("1 0.1 0.1 0.2 0.2\n0 0.5\n0 0.1 0.2 0.3 0.4\n0 0.9 0.9 0.9 0.9\n")
    rows = label_files.read_polygons(spark, str(tmp_path))
    assert rows.count() == 4
    text = rows.select("file", "line_no", F.concat_ws(" ", F.col("cls").cast("string"), F.col("coords").cast("array<string>")).alias("line"))
    got = gates.polygon_centroid(text).collect()
    assert [r.file for r in got] == ["frame_0001_jpg.rf.a.jpg"]
    assert math.isclose(got[0].x, 0.2 * 640) and math.isclose(got[0].y, 0.3 * 360)


# ---- teams --------------------------------------------------------------------------


def test_sample_cap_may_overshoot(spark):
    rows = [(0, f, s, s) for f in range(10) for s in range(3)]
    got = teams.sample_cap(spark.createDataFrame(rows, "game bigint, frame bigint, seq bigint, tid bigint"), 5, 4)
    assert sorted((r.frame, r.seq) for r in got.collect()) == [(f, s) for f in (0, 1) for s in range(3)]


def test_lock_needs_two_equal_reads(spark):
    reads = [(i, 0, i, 7, t) for i, t in enumerate(["05", "12", " 5", "100", "0", "12"])]
    got = teams.jersey_lock(spark.createDataFrame(reads, "ord bigint, game bigint, frame bigint, tid bigint, text string"))
    assert [(r.num, r.lock_ord) for r in got.collect()] == [("5", 2)]


# ---- gates --------------------------------------------------------------------------


def test_court_edges(spark):
    rows = [(166.0, 633.0, True), (165.0, 633.0, False), (640.0, 136.0, True), (640.0, 135.9, False), (640.0, 633.5, False)]
    from courtflow.functions.geometry import in_court

    got = spark.createDataFrame(rows, "x double, y double, want boolean").select("want", in_court("x", "y").alias("got"))
    assert all(r.want == r.got for r in got.collect())


# ---- sequential operators against plain loops ---------------------------------------


def random_boxes(spark, seed=5, n=1500):
    rnd, frame, rows = random.Random(seed), 0, []
    for _ in range(n):
        frame += rnd.choice([1, 1, 1, 2, 3, 7, 15])
        x, y = 600 + 200 * math.sin(frame / 40) + rnd.gauss(0, 8), 300 + rnd.gauss(0, 8)
        rows.append((0, frame, int(x) - 15, int(y) - 15, int(x) + 15, int(y) + 15))
    return rows, spark.createDataFrame(rows, "game bigint, frame bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")


def test_kalman_blocks_equal_one_pass(spark):
    rows, boxes = random_boxes(spark)
    state, want = None, {}
    for _, f, x1, y1, x2, y2 in rows:
        state = steps.kalman_step(state, f, (x1 + x2) / 2.0, (y1 + y2) / 2.0, 50.0)
        want[f] = state[0]
    got = {r.frame: r.sx for r in ball.kalman_smooth(boxes, size=300).collect()}
    assert len(got) == len(want) and all(math.isclose(got[f], want[f], abs_tol=1e-9) for f in want)


def test_kalman_ahead_equals_single_steps():
    state = (10.0, 1.5, 20.0, -2.0, 30.0, 4.0, 5.0, 0)
    one = state
    for _ in range(7):
        one = steps.kalman_ahead(one, 1)
    assert all(math.isclose(a, b) for a, b in zip(one, steps.kalman_ahead(state, 7)))


def box_gap(a, b):
    return math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def spiky_boxes(spark):
    rnd, rows = random.Random(9), []
    for f in range(600):
        if rnd.random() < 0.35:
            continue
        jump = 150 if f % 23 in (5, 6) or f % 31 in (3, 4, 5) or f % 17 == 2 else 0
        rows.append((0, f, 300 + f + jump, 200, 330 + f + jump, 230))
    return rows, spark.createDataFrame(rows, "game bigint, frame bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")


@pytest.mark.parametrize("in_order", [False, True])
def test_spikes_against_passes_over_a_dense_list(spark, in_order):
    rows, boxes = spiky_boxes(spark)
    dense = {f: box for _, f, *box in rows}
    for run in (1, 2, 3):
        doomed = set()
        for f in list(dense):
            seen = {k: v for k, v in dense.items() if k not in doomed} if in_order else dense
            line = [seen.get(f + k) for k in range(run)]
            if None in line or any(box_gap(p, q) > 250 * 1280 / 1920 * 0.3 for p, q in zip(line, line[1:])):
                continue
            before = next((seen[f - k] for k in range(1, 8) if f - k in seen), None)
            reach = 8 if run == 1 else 9
            after = next((seen[f + run - 1 + k] for k in range(1, reach) if f + run - 1 + k in seen), None)
            if before is None or after is None:
                continue
            a, b = box_gap(line[0], before), box_gap(line[-1], after)
            if max(a, b) > 3 * box_gap(before, after) + 20 and a > 30 and b > 30:
                doomed |= {f + k for k in range(run)}
        dense = {f: v for f, v in dense.items() if f not in doomed}
    how = (lambda t: ball.spike_reject_in_order(t, size=50)) if in_order else ball.spike_reject
    got = {r.frame for r in how(boxes).collect()}
    assert got == set(dense) and len(got) < len(rows)


def brute_reid(rows, locks, last):
    """Frame-by-frame loop with a lost table, as the rule is stated."""
    by_frame, lost, remap, out = {}, {}, {}, []
    for r in rows:
        by_frame.setdefault(r[1], []).append(r)
    seen = {}
    for f in range(last + 1):
        lost = {t: e for t, e in lost.items() if f - e[0] <= 600}
        for _, _, seq, tid, x1, y1, x2, y2 in sorted(by_frame.get(f, []), key=lambda r: r[2]):
            if tid in remap:
                continue
            x, y = (x1 + x2) / 2, (y1 + y2) / 2
            num = locks.get(tid)
            worn = [t for t in lost if num and num[1] < f and locks.get(t) and locks[t][0] == num[0] and locks[t][1] < f]
            pick = min(worn, key=lambda t: (lost[t][0], t)) if worn else None
            if pick is None:
                near = [(math.hypot(x - e[1], y - e[2]), e[0], t) for t, e in lost.items()]
                near = [n for n in near if n[0] < 300]
                pick = min(near)[2] if near else None
            if pick is not None:
                remap[tid] = pick
                del lost[pick]
                out.append((0, tid, f, pick))
        now = {r[3] for r in by_frame.get(f, [])}
        for tid in [t for t, s in seen.items() if s[0] == f - 1 and t not in now]:
            lost[tid] = (f, seen[tid][1], seen[tid][2])
        for _, _, _, tid, x1, y1, x2, y2 in by_frame.get(f, []):
            seen[tid] = (f, (x1 + x2) / 2, (y1 + y2) / 2)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reid_against_loop(spark, seed):
    rnd, rows = random.Random(seed), []
    for tid in range(40):
        start, x, y = rnd.randrange(0, 4000), rnd.randrange(0, 1200), rnd.randrange(0, 700)
        for f in range(start, start + rnd.randrange(3, 60)):
            if rnd.random() < 0.8:
                rows.append((0, f, tid + 1, tid, x, y, x + 40, y + 80))
                x += rnd.randrange(-9, 10)
    last = max(r[1] for r in rows)
    locks = {t: (str(t % 6), rnd.randrange(0, 4000)) for t in range(0, 40, 2)}
    dets = spark.createDataFrame(rows, "game bigint, frame bigint, seq bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    worn = spark.createDataFrame([(0, t, n, f) for t, (n, f) in locks.items()], "game bigint, tid bigint, num string, lock_frame bigint")
    got = tracks.reid_match(dets, tracks.lost_registry(dets), worn).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute_reid(rows, locks, last)


def test_stream_reid_equals_batch(spark, sf):
    src = Inputs(spark, sf)
    locks = teams.jersey_lock(src.reads)
    want = tracks.reid_match(src.track_dets, tracks.lost_registry(src.track_dets), locks).collect()
    got = QUERIES["stream_reid"](spark, sf).select("game", "tid", "frame", "old_tid").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r)[:4] for r in want) and got


def boxes_at(spark, rows):
    """Boxes of 40x80 from (frame, tid, x)."""
    full = [(0, f, t, t, x, 100, x + 40, 180) for f, t, x in rows]
    return spark.createDataFrame(
        full, "game bigint, frame bigint, seq bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint"
    )


def test_number_and_distance_contacts_of_one_entry_count_once(spark):
    """Two tracks meet two entries; the one that comes second still gets the other entry."""
    rows = [(f, 1, 100) for f in range(3)] + [(f, 4, 110) for f in range(3)] + [(f, 9, 5000) for f in range(30)]
    rows += [(f, 5, 100) for f in range(5, 25)] + [(f, 3, 100) for f in range(5, 25)]
    dets = boxes_at(spark, rows)
    numbers = [(0, 1, "7", 1), (0, 5, "7", 6), (0, 3, "7", 6)]
    worn = spark.createDataFrame(numbers, "game bigint, tid bigint, num string, lock_frame bigint")
    got = tracks.reid_match(dets, tracks.lost_registry(dets), worn).collect()
    full = [(0, f, t, t, x, 100, x + 40, 180) for f, t, x in rows]
    want = brute_reid(full, {t: (n, f) for _, t, n, f in numbers}, 29)
    assert sorted(tuple(r)[:4] for r in got) == want and {r[1] for r in want} == {3, 5}


def test_identities_follow_chains_back_in_time(spark):
    schema = "game bigint, tid bigint, frame bigint, old_tid bigint, lost_frame bigint"
    # 2 took 1, 3 took 2, 1 came back and took 3: it stands for itself again; 9 took 8 before 8 took 7
    rows = [(0, 2, 20, 1, 11), (0, 3, 40, 2, 31), (0, 1, 60, 3, 51), (0, 9, 20, 8, 10), (0, 8, 30, 7, 5)]
    matches = spark.createDataFrame(rows, schema)
    assert {(r.tid, r.identity) for r in tracks.identities(matches).collect()} == {(2, 1), (3, 1), (1, 1), (9, 8), (8, 7)}
    dets = boxes_at(spark, [(19, 2, 0), (20, 2, 0), (45, 3, 0), (5, 4, 0)])
    got = {(r.frame, r.tid): r.identity for r in tracks.apply_identities(dets, matches).collect()}
    assert got == {(19, 2): 2, (20, 2): 1, (45, 3): 1, (5, 4): 4}


def test_applied_identities_equal_a_walk(spark, sf):
    src = Inputs(spark, sf)
    dets = src.track_dets
    matches = tracks.reid_match(dets, tracks.lost_registry(dets), teams.jersey_lock(src.reads)).collect()
    since = {(m.game, m.tid): m for m in matches}

    def stands_for(game, tid, frame):
        m = since.get((game, tid))
        return tid if m is None or frame < m.frame else stands_for(game, m.old_tid, m.lost_frame - 1)

    got = QUERIES["reid_applied"](spark, sf).collect()
    assert len(got) == dets.count() and matches
    assert all(r.identity == stands_for(r.game, r.tid, r.frame) for r in got)


def test_an_exit_gives_a_detection_one_identity(spark, sf):
    for folder in (sf, sf.replace("sf0.001", "sf0.01")):
        got = QUERIES["exit_match"](spark, folder).collect()
        assert len({(r.game, r.frame, r.new_tid) for r in got}) == len(got) > 0


def test_poses_without_a_near_head_break_the_lock(spark):
    det = "game bigint, frame bigint, seq bigint, conf double, x1 bigint, y1 bigint, x2 bigint, y2 bigint"
    dets = spark.createDataFrame([(0, f, 0, 0.9, 600 + f, 300, 630 + f, 330) for f in range(60)], det)
    none = spark.createDataFrame([], "game bigint, frame bigint, idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    near = [f for f in range(60) if not 10 <= f < 15]
    heads = spark.createDataFrame([(0, f, 1, 2.0, 3.0) for f in near], "game bigint, frame bigint, tid bigint, dx double, dy double")
    posed = spark.createDataFrame([(0, f) for f in range(60)], "game bigint, frame bigint")
    lost = lambda **how: min(set(range(2, 60)) - {r.frame for r in ball.ball_validate(dets, none, "strict", heads, **how).collect()})
    assert lost(posed=posed) == 34  # the 20th call in a row after the head was away
    assert lost() == 26  # without any pose on 10-14 the history is kept


def test_a_snapshot_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "ord bigint, stem string")
    for snapshot in ("v1", "v2", "v2"):
        label_files.write_snapshot(rows, path, snapshot)
    kept = label_files.read_snapshots(spark, path, "ord bigint, stem string, snapshot string")
    assert kept.count() == 4 and label_files.latest_snapshot(kept).count() == 2
    assert label_files.read_latest_snapshot(spark, path, "ord bigint, stem string").count() == 2


def test_stream_kalman_carries_on_over_long_gaps(spark):
    frames = [*range(0, 60), 3000, 3001, *range(5200, 5206)]
    boxes = spark.createDataFrame(
        [(0, f, 900 + f % 7, 300, 930 + f % 7, 330) for f in frames],
        "game bigint, frame bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint",
    )
    want = {r.frame: (r.sx, r.svx, r.sy, r.svy) for r in ball.kalman_smooth(boxes).collect()}
    rows = boxes.selectExpr("game", "frame", "(x1 + x2) / 2D AS cx", "(y1 + y2) / 2D AS cy")
    out = drain(rows, lambda s: stateful.kalman(s, ball.TELEPORT["strict"]), "kalman-gaps", closing=late(rows))
    got = {r.frame: (r.sx, r.svx, r.sy, r.svy) for r in out.collect()}
    assert got == want


def test_stream_rows_out_of_order_give_the_batch_answer_and_leave_no_state(spark):
    """Sightings arrive in any order within the watermark; silent keys are given up."""
    frames = [f for f in range(400) if f % 5 not in (2, 3)]
    boxes = spark.createDataFrame(
        [(0, f, 0, 0.9, 600 + f % 9, 300, 630 + f % 9, 330) for f in frames],
        "game bigint, frame bigint, seq bigint, conf double, x1 bigint, y1 bigint, x2 bigint, y2 bigint",
    )
    rows = boxes.select("game", "frame", "x1", "y1", "x2", "y2")
    teleport, kept = ball.TELEPORT["export"] * ball.SCALE, []
    watch = lambda q: kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    build = lambda s: stateful.gap_fill(s, teleport, ball.MAX_FILL, ball.LINEAR_FILL)
    closing = late(rows).unionByName(late(late(rows)))
    out = drain(rows, build, "fill-disorder", closing=closing, parts=4, disorder=100, watch=watch)
    # a seen frame is never filled, a missing one once
    assert sorted(r.frame for r in out.collect()) == [f for f in range(400) if f % 5 in (2, 3)]
    assert kept[-1] == 2  # one value per sentinel; the state of the game's slice is given up


def test_strict_validation_needs_support_and_rejects_locked_heads(spark):
    det = "game bigint, frame bigint, seq bigint, conf double, x1 bigint, y1 bigint, x2 bigint, y2 bigint"
    rows = [(0, f, 0, 0.9, 600 + f, 300, 630 + f, 330) for f in range(60)]
    none = spark.createDataFrame([], "game bigint, frame bigint, idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    dets = spark.createDataFrame(rows, det)
    got = sorted(r.frame for r in ball.ball_validate(dets, none, "strict").collect())
    assert got == list(range(2, 60))  # the third sighting is the first with enough support
    heads = spark.createDataFrame([(0, f, 1, 2.0, 3.0) for f in range(60)], "game bigint, frame bigint, tid bigint, dx double, dy double")
    got = sorted(r.frame for r in ball.ball_validate(dets, none, "strict", heads).collect())
    # accepted from 2 on; the 20th call in a row (frame 21) is locked and all starts anew
    assert got == [f for f in range(60) if 2 <= f < 21 or 24 <= f < 43 or 46 <= f]


def test_hot_frame_pairs_come_out_once(spark):
    rows = [(0, 5, i, i, 10 * (i % 6), 10 * (i % 4), 10 * (i % 6) + 300, 10 * (i % 4) + 200) for i in range(60)]
    boxes = spark.createDataFrame(rows, "game bigint, frame bigint, seq bigint, tid bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    got = tracks.pair_overlap(boxes).collect()
    assert len({(r.seq_a, r.seq_b) for r in got}) == len(got) == 60 * 59 // 2


def random_candidates(spark, seed, n=900):
    """A ball path with decoys and few gaps, so that state matters across slice borders."""
    rnd, frame, rows, heads = random.Random(seed), 0, [], []
    for _ in range(n):
        frame += rnd.choice([1, 1, 1, 1, 2, 3])
        x, y = int(640 + 250 * math.sin(frame / 30)), int(320 + 200 * math.cos(frame / 45))
        rows.append((0, frame, 0, rnd.random(), x - 15, y - 15, x + 15, y + 15))
        if rnd.random() < 0.5:
            dx, dy = rnd.choice([-260, -90, 60, 120, 240]), rnd.choice([-90, 0, 90])
            rows.append((0, frame, 1, rnd.random(), x + dx - 16, y + dy - 16, x + dx + 16, y + dy + 16))
        if (frame // 50) % 2:
            heads.append((0, frame, 1, 4.0 + rnd.random(), 12.0))
    hoops = [(0, f, 0, 850, 200, 910, 240) for f in range(frame + 1)]
    box = "x1 bigint, y1 bigint, x2 bigint, y2 bigint"
    return (
        spark.createDataFrame(rows, f"game bigint, frame bigint, seq bigint, conf double, {box}"),
        spark.createDataFrame(hoops, f"game bigint, frame bigint, idx bigint, {box}"),
        spark.createDataFrame(heads, "game bigint, frame bigint, tid bigint, dx double, dy double"),
    )


@pytest.mark.parametrize("profile,size", [("export", 5), ("export", 40), ("strict", 40)])
def test_validation_in_slices_equals_one_walk(spark, profile, size):
    """Slices shorter than the memory of the checks must be repaired, not just guessed."""
    dets, hoops, heads = random_candidates(spark, 11, n=50 if size == 5 else 300)
    want = ball.ball_validate(dets, hoops, profile, heads, size=100000)
    got = ball.ball_validate(dets, hoops, profile, heads, size=size)
    a, b = ({(r.frame, r.seq) for r in t.collect()} for t in (got, want))
    assert a == b and len(a) > 10
