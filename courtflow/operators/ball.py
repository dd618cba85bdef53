"""The ball: best detection, validation, spike removal, gap filling, smoothing."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import steps
from ..functions.geometry import (
    FRAME_H,
    FRAME_W,
    center_x,
    center_y,
    d,
    distance,
    in_court_column,
    trunc,
)
from ..functions.settle import settle
from ..functions.slices import dealt, halo, numbered, own, row_blocks, running, slice_of
from ..session import staged

# Fixed values of the ball rules; pixel values hold for a 1920 wide frame and are scaled.
SCALE = FRAME_W / 1920.0
TELEPORT = {"strict": 50.0, "export": 250.0}
LOOK = 7
MAX_FILL, LINEAR_FILL = 8, 3
HEAD_NEAR, HEAD_SPREAD, KP_CONF = 80.0, 6.0, 0.30
SUPPORT_RADIUS = 80.0
HOOP_MARGIN = 0.08
FALLBACK_REACH, FALLBACK_LOST, FALLBACK_EVERY, FALLBACK_CONF = 400, 60, 5, 0.20


def best_detection(dets, by="conf"):
    """One detection per frame: highest confidence or largest area, the first on a tie."""
    value = F.col("conf") if by == "conf" else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rest = [c for c in dets.columns if c not in ("game", "frame")]
    best = dets.groupBy("game", "frame").agg(
        F.max_by(F.struct(*rest), F.struct(value, -F.col("seq"))).alias("best")
    )
    return best.select("game", "frame", "best.*")


def neighbor_asof(boxes, look=LOOK):
    """Frames of the nearest sightings within ``look`` frames before and after."""
    w = Window.partitionBy("game", "slice").orderBy("frame")
    near = lambda c: F.when(F.abs(c - F.col("frame")) <= look, c)
    rows = halo(boxes.select("game", "frame"), before=look, after=look)
    return own(
        rows.withColumns(
            {"before": near(F.lag("frame").over(w)), "after": near(F.lead("frame").over(w))}
        )
    ).drop("slice")


def _hoops_of_frame(hoops):
    """The few hoops of each frame as one array in listed order."""
    hoop = F.struct("idx", "x1", "y1", "x2", "y2", center_x().alias("hx"), center_y().alias("hy"))
    return hoops.groupBy("game", "frame").agg(F.array_sort(F.collect_list(hoop)).alias("hoops"))


def _first_near_hoop(x="cx", y="cy", margin=FRAME_W * HOOP_MARGIN):
    near = F.filter(
        "hoops",
        lambda h: (F.abs(F.col(x) - h["hx"]) < margin) & (F.abs(F.col(y) - h["hy"]) < margin),
    )
    return F.get(near, 0)


def near_hoop_asof(points, hoops, memory=steps.HOOP_MEMORY):
    """The latest hoop that the ball was near within the ``memory`` frames before."""
    rows = points.join(_hoops_of_frame(hoops), ["game", "frame"], "left")
    rows = rows.select("game", "frame", _first_near_hoop().alias("hoop"))
    rows = rows.withColumn("seen", F.when(F.col("hoop").isNotNull(), F.struct("frame", "hoop")))
    w = Window.partitionBy("game", "slice").orderBy("frame").rangeBetween(-memory, -1)
    rows = halo(rows, before=memory).withColumn("seen", F.last("seen", ignorenulls=True).over(w))
    return own(rows).where("seen IS NOT NULL").select(
        "game", "frame", F.col("seen.frame").alias("hoop_frame"),
        *[F.col(f"seen.hoop.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")],
    )


# ---- heads --------------------------------------------------------------------------


def nearest_keypoint(points, keypoints, reach=HEAD_NEAR * SCALE):
    """Per frame and player the nearest sure head keypoint within reach of the ball."""
    kp = keypoints.where((F.col("conf") >= KP_CONF) & ~((F.col("x") == 0) & (F.col("y") == 0)))
    kp = kp.where(F.col("kp") <= 4).select("game", "frame", "tid", "kp", "x", "y")
    gap = distance("cx", "cy", "x", "y")
    rows = points.select("game", "frame", "cx", "cy").join(kp, ["game", "frame"])
    rows = rows.withColumn("gap", gap).where(F.col("gap") < reach)
    best = rows.groupBy("game", "frame", "tid").agg(
        F.min(F.struct("gap", "kp", (F.col("cx") - F.col("x")).alias("dx"), (F.col("cy") - F.col("y")).alias("dy"))).alias("b")
    )
    return best.select("game", "frame", "tid", "b.kp", "b.gap", "b.dx", "b.dy")


def head_lock(points, keypoints, rows_back=steps.LOCK_ROWS, limit=HEAD_SPREAD * SCALE):
    """Frames at which the ball kept one offset to a head over 20 candidates in a row."""
    calls = numbered(points.select("game", "frame"), ["game"], "frame", "call")
    near = nearest_keypoint(points, keypoints).join(calls, ["game", "frame"])
    rows = halo(near, "call", before=rows_back - 1)
    order = Window.partitionBy("game", "tid", "slice").orderBy("call")
    w = order.rowsBetween(1 - rows_back, 0)
    full = F.lag("call", rows_back - 1).over(order) == F.col("call") - (rows_back - 1)
    sx, sy = F.stddev_pop("dx").over(w), F.stddev_pop("dy").over(w)
    rows = own(rows.withColumns({"full": full, "spread": F.sqrt(sx * sx + sy * sy)}))
    return rows.where("full").select(
        "game", "frame", "tid", "spread", (F.col("spread") < limit).alias("locked")
    )


# ---- validation ---------------------------------------------------------------------


def temporal_support(best, slots=steps.RECENT_SLOTS, radius=SUPPORT_RADIUS * SCALE):
    """How many candidates of the last five frames lie around each candidate, itself included."""
    rows = best.select("game", "frame", center_x().alias("cx"), center_y().alias("cy"))
    rows = halo(rows, before=slots - 1)
    w = Window.partitionBy("game", "slice").orderBy("frame").rangeBetween(1 - slots, 0)
    rows = own(rows.withColumn("recent", F.collect_list(F.struct("cx", "cy")).over(w)))
    gap = lambda p: distance(p["cx"], p["cy"], "cx", "cy")
    near = F.filter("recent", lambda p: gap(p) <= radius)
    return rows.select("game", "frame", F.size(near).cast("bigint").alias("support"))


def court_candidates(dets, hoops):
    """Detections in the court column with centre, size and the hoop they are near to."""
    rows = dets.withColumns(
        {"cx": center_x(), "cy": center_y(),
         "area": (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))}
    ).where(in_court_column("cx", "cy"))
    rows = rows.join(_hoops_of_frame(hoops), ["game", "frame"], "left")
    keep = ["game", "frame", "seq", "conf", "cx", "cy", "area"]
    return rows.select(*keep, _first_near_hoop().alias("hoop")).select(
        *keep, F.col("hoop.y1").cast("double").alias("hoop_top"), F.col("hoop.hx").alias("hoop_x")
    )


CANDIDATE = ["game", "frame", "seq", "conf", "cx", "cy", "area", "hoop_top", "hoop_x"]
VALID = "game bigint, frame bigint, seq bigint, cx double, cy double, conf double"


def ball_validate(dets, hoops, profile="export", heads=None, size=4096, posed=None):
    """Plausible ball detections, decided frame by frame on what was accepted before.

    ``export`` keeps every detection that passes the column, teleport and backboard
    checks; ``strict`` keeps at most the surest one, asks for support by recent frames
    when it is not continuing a track, and rejects balls that are locked to a head
    (``heads`` from ``nearest_keypoint``).  A frame with poses (``posed``: game, frame; by
    default those in ``heads``) but no head near the ball breaks every lock; a frame without
    any pose leaves them as they are.
    """
    rows = court_candidates(dets, hoops)
    jump = TELEPORT[profile] * SCALE
    if profile == "export":
        return settle(
            rows.select(*CANDIDATE), lambda: list(steps.NOWHERE), export_step(jump), age_core,
            VALID, ["frame", "seq"], size,
        )
    offsets = "array<struct<tid:bigint,dx:double,dy:double>>"
    if heads is None:
        rows = rows.withColumns({"heads": F.lit(None).cast(offsets), "posed": F.lit(False)})
    else:
        per = heads.groupBy("game", "frame").agg(
            F.array_sort(F.collect_list(F.struct("tid", "dx", "dy"))).alias("heads")
        )
        shown = (heads if posed is None else posed).select("game", "frame").distinct()
        rows = rows.join(per, ["game", "frame"], "left")
        rows = rows.join(shown.withColumn("posed", F.lit(True)), ["game", "frame"], "left")
        rows = rows.withColumn("posed", F.coalesce("posed", F.lit(False)))
    return settle(
        rows.select(*CANDIDATE, "heads", "posed"), blank_strict, strict_step(jump), age_strict,
        VALID, ["frame", "seq"], size,
    )


def _hoop(row):
    missing = row.hoop_top is None or row.hoop_top != row.hoop_top
    return (None, None) if missing else (float(row.hoop_top), float(row.hoop_x))


def _plausible(state, rows, frame, jump):
    return [
        row for row in rows
        if steps.plausible(state, frame, row.cx, row.cy, jump, FRAME_W, FRAME_H)
    ]


def _accept(state, frame, best):
    return list(steps.accept(tuple(state), frame, (float(best.cx), float(best.cy), *_hoop(best))))


def _out(row, frame):
    return (row.game, frame, row.seq, row.cx, row.cy, row.conf)


def age_core(state, frame):
    """Drop a position too old for the teleport check and a hoop too old for the backboard one."""
    x, y, last, hoop_frame, top, hoop_x = state
    if last is None or frame - last > steps.GRACE:
        x = y = last = None
    if hoop_frame is None or frame - hoop_frame > steps.HOOP_MEMORY:
        hoop_frame = top = hoop_x = None
    return [x, y, last, hoop_frame, top, hoop_x]


def export_step(jump):
    """All plausible detections of a frame; the largest becomes the reference."""

    def step(state, frame, rows):
        valid = _plausible(state, rows, frame, jump)
        if valid:
            state = _accept(state, frame, max(valid, key=lambda row: row.area))
        return state, [_out(row, frame) for row in valid]

    return step


def blank_strict():
    return {"core": list(steps.NOWHERE), "recent": [None] * steps.RECENT_SLOTS, "call": None, "heads": {}}


def _fill_slots(state, frame):
    """Frames without a candidate fill slots of the recent ones, too."""
    idle = 0 if state["call"] is None else min(steps.RECENT_SLOTS, frame - state["call"] - 1)
    return (state["recent"] + [None] * idle)[-steps.RECENT_SLOTS:]


def age_strict(state, frame):
    recent = _fill_slots(state, frame)
    seen = any(r is not None for r in recent)
    return {
        "core": age_core(state["core"], frame), "recent": recent,
        "call": frame - 1 if seen else None, "heads": state["heads"],
    }


def strict_step(jump):
    """At most the surest plausible detection, if supported and not locked to a head."""

    def step(state, frame, rows):
        core, heads = state["core"], {int(t): v for t, v in state["heads"].items()}
        valid = _plausible(core, rows, frame, jump)
        best = max(valid, key=lambda row: row.conf) if valid else None
        seen = None if best is None else [float(best.cx), float(best.cy)]
        recent = (_fill_slots(state, frame) + [seen])[-steps.RECENT_SLOTS:]
        new = lambda core, recent: {
            "core": core, "recent": recent, "call": frame, "heads": {str(t): v for t, v in heads.items()}
        }
        if best is None:
            return new(core, recent), []
        gap = None if core[0] is None else frame - core[2]
        going = gap is not None and gap <= steps.GRACE and (
            math.sqrt((best.cx - core[0]) ** 2 + (best.cy - core[1]) ** 2) <= jump * gap
        )
        if not going and not steps.supported(recent, best.cx, best.cy, SUPPORT_RADIUS * SCALE):
            return new(core, recent), []
        near = [] if best.heads is None else best.heads
        offsets = {int(h["tid"]): [float(h["dx"]), float(h["dy"])] for h in near}
        if best.posed and steps.head_locked(heads, offsets, HEAD_SPREAD * SCALE):
            heads = {}
            return new([None, None, None] + core[3:], [None] * steps.RECENT_SLOTS), []
        return new(_accept(core, frame, best), recent), [_out(best, frame)]

    return step


# ---- repair -------------------------------------------------------------------------


def spike_reject(boxes, profile="export"):
    """Drop jumps of one, two or three frames that leave and return to the ball's path.

    Each of the three passes looks at the rows the pass before left, all at once.  The
    three reach at most 24 frames back and 26 ahead, so one halo serves them all.
    """
    coherent = TELEPORT[profile] * SCALE * 0.3
    w = Window.partitionBy("game", "slice").orderBy("frame")
    rows = halo(boxes.withColumns({"cx": center_x(), "cy": center_y()}), before=40, after=40)
    for run in (1, 2, 3):
        at = F.col("frame")
        point = lambda k: [
            (F.lag if k < 0 else F.lead)(c, abs(k)).over(w) if k else F.col(c)
            for c in ("frame", "cx", "cy")
        ]
        gap = lambda p, q: distance(p[1], p[2], q[1], q[2])
        # look-ahead is one row longer behind a run than behind a single spike
        ahead = LOOK if run == 1 else LOOK + run
        before, after = point(-1), point(run)
        ok = (at - before[0] <= LOOK) & (after[0] - at <= ahead)
        for k in range(1, run):
            ok = ok & (point(k)[0] == at + k) & (gap(point(k - 1), point(k)) <= coherent)
        to_before, to_after = gap(point(0), before), gap(point(run - 1), after)
        spike = (
            ok
            & (F.greatest(to_before, to_after) > gap(before, after) * 3 + 20)
            & (to_before > 30)
            & (to_after > 30)
        )
        rows = rows.withColumn("spike", F.coalesce(spike, F.lit(False)))
        gone = F.col("spike")
        for k in range(1, run):
            led = F.lag("spike", k).over(w) & (F.lag("frame", k).over(w) == at - k)
            gone = gone | F.coalesce(led, F.lit(False))
        rows = rows.withColumn("gone", gone).where("NOT gone").drop("spike", "gone")
    return own(rows).drop("slice", "cx", "cy")


def spike_reject_in_order(boxes, profile="export", size=4096):
    """``spike_reject`` where each removal is seen by the rows after it in the same pass.

    What lies ahead of a row is looked up natively; only the last row that stayed is state.
    """
    coherent = TELEPORT[profile] * SCALE * 0.3
    names = boxes.columns
    ddl = ", ".join(f"{n} {t}" for n, t in boxes.dtypes)
    w = Window.partitionBy("game", "slice").orderBy("frame")
    rows = boxes
    for run in (1, 2, 3):
        ahead = LOOK if run == 1 else LOOK + run
        part = halo(rows.withColumns({"cx": center_x(), "cy": center_y()}), after=ahead, size=size)
        at = lambda k, c: F.lead(c, k).over(w) if k else F.col(c)
        gap = lambda k: distance(at(k, "cx"), at(k, "cy"), at(k + 1, "cx"), at(k + 1, "cy"))
        ok = F.lead("frame", run).over(w) - F.col("frame") <= ahead
        for k in range(1, run):
            ok = ok & (at(k, "frame") == F.col("frame") + k) & (gap(k - 1) <= coherent)
        part = part.withColumns(
            {
                "ok": F.coalesce(ok, F.lit(False)),
                "ex": at(run - 1, "cx"), "ey": at(run - 1, "cy"), "nx": at(run, "cx"), "ny": at(run, "cy"),
            }
        )
        rows = settle(
            own(part).drop("slice"), lambda: [None, None, None, None], _spike_step(run, names), _age_spike,
            ddl, ["frame"], size,
        )
    return rows


def _age_spike(state, frame):
    last, x, y, until = state
    if last is None or frame - last > LOOK:
        last = x = y = None
    return [last, x, y, until if until is not None and until >= frame else None]


def _spike_step(run, names):
    def step(state, frame, rows):
        last, x, y, until = state
        row = rows[0]
        if until is not None and frame <= until:
            return state, []
        if row.ok and last is not None and frame - last <= LOOK:
            to_before = math.sqrt((row.cx - x) ** 2 + (row.cy - y) ** 2)
            to_after = math.sqrt((row.ex - row.nx) ** 2 + (row.ey - row.ny) ** 2)
            apart = math.sqrt((x - row.nx) ** 2 + (y - row.ny) ** 2)
            if max(to_before, to_after) > apart * 3 + 20 and to_before > 30 and to_after > 30:
                return [last, x, y, frame + run - 1], []
        kept = tuple(getattr(row, n) for n in names)
        return [frame, float(row.cx), float(row.cy), None], [kept]

    return step


def gap_fill(boxes, profile="export", most=MAX_FILL):
    """Fill gaps of up to 8 frames: straight for short ones, along an arc for longer ones."""
    teleport = TELEPORT[profile] * SCALE
    sides = ["x1", "y1", "x2", "y2"]
    w = Window.partitionBy("game", "slice").orderBy("frame")
    rows = halo(boxes.select("game", "frame", *sides), after=most + 1)
    rows = own(rows.withColumn("n", F.lead(F.struct("frame", *sides)).over(w)))
    gap = F.col("n.frame") - F.col("frame") - 1
    jump = distance(center_x(), center_y(), center_x("n."), center_y("n."))
    holes = rows.withColumns({"gap": gap, "jump": jump}).where(
        F.col("gap").between(1, most) & (F.col("jump") <= teleport * (F.col("gap") + 1))
    )
    holes = holes.withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("gap"))))
    t = F.col("j") / (F.col("gap") + 1)
    rise = F.least(F.abs(center_x("n.") - center_x()) * d(0.3), F.col("gap") * d(15))
    lift = F.when(F.col("gap") > LINEAR_FILL, -rise * d(4) * t * (d(1) - t)).otherwise(d(0))
    line = lambda c: F.col(c) + (F.col(f"n.{c}") - F.col(c)) * t
    filled = holes.select(
        "game",
        (F.col("frame") + F.col("j")).alias("frame"),
        *[trunc(line(c) + lift if c[0] == "y" else line(c)).alias(c) for c in sides],
        F.lit("INTERP").alias("provenance"),
    )
    seen = boxes.select("game", "frame", *sides, F.lit("SEEN").alias("provenance"))
    return seen.unionByName(filled)


SIGHTINGS_PER_TASK = 32_768
_STATE = ["x", "vx", "y", "vy", "p00", "p01", "p11"]


def _kalman_taken(state, z, jump):
    """``steps.kalman_step`` as a column: the state (a struct, its frame null before the first sighting) after sighting ``z``."""
    q, r = d(steps.KALMAN_Q), d(steps.KALMAN_R)
    gap = (z["frame"] - state["frame"]).cast("double")
    fresh = F.struct(
        z["cx"].alias("x"), d(0).alias("vx"), z["cy"].alias("y"), d(0).alias("vy"),
        d(steps.KALMAN_P0).alias("p00"), d(0).alias("p01"), d(steps.KALMAN_P0).alias("p11"), z["frame"].alias("frame"),
    )
    off = lambda c: z[f"c{c}"] - (state[c] + (gap - 1) * state[f"v{c}"])
    jumped = (gap <= steps.KALMAN_RESET) & (F.sqrt(off("x") * off("x") + off("y") * off("y")) > d(jump))

    def ahead(m, k):
        """``steps.kalman_ahead``; speeds stay as they are."""
        return F.struct(
            (m["x"] + k * state["vx"]).alias("x"), (m["y"] + k * state["vy"]).alias("y"),
            (m["p00"] + 2 * k * m["p01"] + k * k * m["p11"]
             + q * (k * (k - 1) * (k - 2) / 3 + k * (k - 1) / 2 + k)).alias("p00"),
            (m["p01"] + k * m["p11"] + q * k * (k - 1) / 2).alias("p01"),
            (m["p11"] + k * q).alias("p11"),
        )

    def taken(m):
        s = m["p00"] + r
        k0, k1 = m["p00"] / s, m["p01"] / s
        new = {
            "x": m["x"] + k0 * (z["cx"] - m["x"]), "vx": state["vx"] + k1 * (z["cx"] - m["x"]),
            "y": m["y"] + k0 * (z["cy"] - m["y"]), "vy": state["vy"] + k1 * (z["cy"] - m["y"]),
            "p00": (1 - k0) * m["p00"], "p01": (1 - k0) * m["p01"], "p11": m["p11"] - k1 * m["p01"],
        }
        return F.struct(*[new[c].alias(c) for c in _STATE], z["frame"].alias("frame"))

    # a one-element array stands for a name: what is predicted is computed once
    named = F.transform(F.array(ahead(state, gap - 1)), lambda m: ahead(m, d(1)))
    return F.when(state["frame"].isNull() | jumped, fresh).otherwise(F.transform(named, taken)[0])


def kalman_smooth(boxes, profile="strict", size=512, warm=128, tolerance=1e-9):
    """Constant-velocity Kalman filter over the sightings of each game, in column expressions.

    Each block of ``size`` sightings is walked on its own, from a guess: what the last ``warm`` sightings before it lead to. A
    block that did not start from what the block before really ended with, within ``tolerance``, is walked again from
    there, until all blocks agree; as a filter forgets, the guess is mostly right, but nothing relies on it. Blocks are
    dealt to tasks by sightings, as walking costs far more than reading.
    """
    jump = TELEPORT[profile]
    rows = boxes.select("game", "frame", center_x().alias("cx"), center_y().alias("cy"))
    rows = row_blocks(rows, ["game"], before=warm, size=size)
    z = F.struct("frame", "cx", "cy")
    blocks = rows.groupBy("game", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("own"), z))).alias("zs"),
        F.array_sort(F.collect_list(F.when(~F.col("own"), z))).alias("ahead"),
    ).where(F.size("zs") > 0)
    blocks = staged(blocks, "sightings")
    tasks = dealt(blocks.agg(F.sum(F.size("zs"))).first()[0] or 0, SIGHTINGS_PER_TASK)
    kind = "struct<" + ",".join(f"{c}:double" for c in _STATE) + ",frame:bigint>"

    def walked(some, turn):
        some = some.repartition(tasks, "game", "block")
        walk = F.aggregate(
            "zs",
            F.struct("start", F.array().cast(f"array<{kind}>").alias("states")),
            lambda acc, z: F.transform(
                F.array(_kalman_taken(acc["start"], z, jump)),
                lambda s: F.struct(s.alias("start"), F.concat(acc["states"], F.array(s)).alias("states")),
            )[0],
            lambda acc: acc["states"],
        )
        out = some.select("game", "block", "start", walk.alias("states"), F.lit(turn).alias("turn"))
        return staged(out, "filtered")

    blank = F.struct(*[F.lit(None).cast("double").alias(c) for c in _STATE], F.lit(None).cast("bigint").alias("frame"))
    guess = F.aggregate("ahead", blank, lambda state, z: _kalman_taken(state, z, jump))
    done = walked(blocks.withColumn("start", guess), 0)
    turn, before = 0, Window.partitionBy("game").orderBy("block")
    while True:
        latest = F.max_by(F.struct("start", F.element_at("states", -1).alias("end"), "turn"), "turn").alias("b")
        states = done.groupBy("game", "block").agg(latest).select("game", "block", "b.*")
        told = states.withColumn("truth", F.lag("end").over(before)).where("truth IS NOT NULL")
        same = F.col("start.frame").eqNullSafe(F.col("truth.frame"))
        for c in _STATE:
            same = same & (F.abs(F.col(f"start.{c}") - F.col(f"truth.{c}")) <= tolerance)
        wrong = told.where(~F.coalesce(same, F.lit(False))).select("game", "block", F.col("truth").alias("start"))
        if wrong.isEmpty():
            break
        turn += 1
        done = done.unionByName(walked(blocks.join(wrong, ["game", "block"]), turn))
    if turn:
        done = done.join(states.select("game", "block", "turn"), ["game", "block", "turn"], "left_semi")
    rows = done.select("game", F.explode("states").alias("s"))
    named = {"x": "sx", "vx": "svx", "y": "sy", "vy": "svy"}
    return rows.select("game", "s.frame", *[F.col(f"s.{c}").alias(n) for c, n in named.items()])


def box_recenter(boxes, smoothed):
    """Boxes of unchanged size around the smoothed centres."""
    rows = boxes.join(smoothed, ["game", "frame"])
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return rows.select(
        "game",
        "frame",
        trunc(F.col("sx") - w / d(2)).alias("x1"),
        trunc(F.col("sy") - h / d(2)).alias("y1"),
        trunc(F.col("sx") + w / d(2)).alias("x2"),
        trunc(F.col("sy") + h / d(2)).alias("y2"),
    )


def velocity_history(boxes, rows_back=5, short=3, long=10):
    """Mean of the last five one-step velocities of the raw centre.

    Steps over more than ``short`` frames add nothing, one over more than ``long`` frames
    starts anew.
    """
    w = Window.partitionBy("game", "slice").orderBy("frame")
    rows = boxes.select("game", "frame", center_x().alias("cx"), center_y().alias("cy"))
    rows = halo(rows, before=long)
    gap = F.col("frame") - F.lag("frame").over(w)
    step = lambda c: F.when(gap <= short, (F.col(c) - F.lag(c).over(w)) / gap)
    rows = own(
        rows.withColumns(
            {"fresh": F.coalesce(gap > long, F.lit(True)), "vx": step("cx"), "vy": step("cy")}
        )
    )
    rows = running(
        rows,
        ["game"],
        ["frame"],
        {"island": ("last", F.when(F.col("fresh"), F.col("frame"))), "at": ("count", F.col("vx"))},
    )
    steps_ = halo(
        rows.where("vx IS NOT NULL").select("game", "island", "at", "vx", "vy"),
        "at", before=rows_back - 1, name="block",
    )
    last = Window.partitionBy("game", "island", "block").orderBy("at").rowsBetween(1 - rows_back, 0)
    mean = own(
        steps_.withColumns(
            {"mean_vx": F.avg("vx").over(last), "mean_vy": F.avg("vy").over(last), "n": F.count("*").over(last)}
        )
    ).select("game", "island", "at", "mean_vx", "mean_vy", "n")
    return rows.select("game", "frame", "island", "at").join(mean, ["game", "island", "at"], "left").select(
        "game", "frame", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "mean_vx", "mean_vy"
    )


def source_fallback(primary, second):
    """Primary sightings, and secondary ones on frames that have none.

    While the ball was lost for less than 60 frames a secondary sighting must lie within
    400 px of the last primary one; after that any surer one counts on every 5th frame.
    """
    first = primary.select("game", "frame", "cx", "cy", "conf", F.lit("primary").alias("source"))
    more = second.join(primary.select("game", "frame"), ["game", "frame"], "left_anti")
    rows = first.unionByName(
        more.select("game", "frame", "cx", "cy", "conf", F.lit("secondary").alias("source"))
    )
    main = F.col("source") == "primary"
    w = Window.partitionBy("game", "slice").orderBy("frame").rangeBetween(-FALLBACK_LOST, -1)
    rows = halo(rows, before=FALLBACK_LOST)
    rows = own(
        rows.withColumn("last", F.last(F.when(main, F.struct("cx", "cy")), ignorenulls=True).over(w))
    )
    close = (F.abs(F.col("cx") - F.col("last.cx")) <= FALLBACK_REACH) & (
        F.abs(F.col("cy") - F.col("last.cy")) <= FALLBACK_REACH
    )
    free = (F.col("conf") >= FALLBACK_CONF) & (F.col("frame") % FALLBACK_EVERY == 0)
    return rows.where(
        main | F.when(F.col("last").isNotNull(), close).otherwise(free)
    ).select("game", "frame", "cx", "cy", "conf", "source")
