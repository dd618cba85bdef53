"""Ball flights, shot classification with an explained reject reason, and reports.

A flight (a run of ball points whose frame gaps stay within ``GAP``) is named by
the frame it starts at.  Points are handled slice by slice (see
``functions.slices``); everything that is decided per flight comes out of partially
aggregated groups or out of the at most 151 points before the closest approach, so
neither a long game nor a long flight has to fit into one task.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import d, distance, rounded
from ..functions.slices import SLICES, halo, numbered, own, row_blocks, running, slice_of
from ..session import staged

# Fixed values of the shot rules (pixels, frames).
GAP = 10
MIN_POINTS = 8
MIN_SPEED = 1.0
MAX_HOOP_DIST = 600
COOLDOWN = 60
FAR_TRAVEL, FAR_RELEASE, ARC_HEIGHT = 80, 180, 25
REACH = 80
RECENT_POINTS = 40
RELEASE_POINTS = 150
OVERLAY = 90
PROB_KEEP, PROB_NEW = 0.85, 0.15

KEY = ["game", "flight"]
NEAR = ["dist", "n", "frame"]


def ball_trajectory(balls, hoops):
    """Ball points with the first listed hoop of their frame, if it has one."""
    first = hoops.where("idx = 0").select(
        "game",
        "frame",
        ((F.col("x1") + F.col("x2")) / d(2)).alias("hoop_x"),
        ((F.col("y1") + F.col("y2")) / d(2)).alias("hoop_y"),
    )
    return balls.join(first, ["game", "frame"], "left")


def _motion(points, size):
    """Points of each slice with their one-step motion; ``start`` begins a flight, ``arc`` marks the upward-to-level turn."""
    w = Window.partitionBy("game", "slice").orderBy("frame")
    dt = F.col("frame") - F.lag("frame").over(w)
    rows = halo(
        points.select("game", "frame", "cx", "cy", "hoop_x", "hoop_y"),
        before=4 * GAP,
        after=2 * GAP,
        size=size,
    )
    rows = rows.withColumn("dt", dt).withColumn("start", F.col("dt").isNull() | (F.col("dt") > GAP))
    step = lambda c: F.when(~F.col("start"), (F.col(c) - F.lag(c).over(w)) / F.col("dt"))
    rows = rows.withColumns(
        {
            "vx": step("cx"),
            "vy": step("cy"),
            "dist": distance("cx", "cy", "hoop_x", "hoop_y"),
        }
    )
    vy1, vy2, ahead = F.lag("vy", 1).over(w), F.lag("vy", 2).over(w), F.lead("vy", 1).over(w)
    rows = rows.withColumns(
        {
            "speed": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")),
            "vy_prev": vy1,
            "arc": F.coalesce(
                ((vy2 + vy1) / d(2) < -0.8) & ((F.col("vy") + ahead) / d(2) > -0.2), F.lit(False)
            ),
        }
    )
    return own(rows).withColumn("vy_prev", F.when(~F.col("start"), F.col("vy_prev")))


def flight_points(points, size=4096):
    """Points with their flight, their number ``n`` in the game and one-step motion.

    ``n`` counts points of the game and ``hn`` those with a hoop, so differences of
    them are positions inside a flight.
    """
    return running(
        _motion(points, size),
        ["game"],
        ["frame"],
        {
            "flight": ("last", F.when(F.col("start"), F.col("frame"))),
            "n": ("count", F.lit(1)),
            "hn": ("count", F.col("dist")),
        },
    )


def _pieces(points, size):
    """What a slice says of its own points: ``piece``, the flight if it starts in the slice, and running values of the
    slice (``n``, ``hn``) and of the piece (``near``, ``dist_prev``). ``ends`` marks the last point of a slice."""
    w = Window.partitionBy("game", "slice").orderBy("frame")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = _motion(points, size).where("game IS NOT NULL AND slice IS NOT NULL").withColumns(
        {
            "piece": F.last(F.when(F.col("start"), F.col("frame")), ignorenulls=True).over(upto),
            "n": F.count(F.lit(1)).over(upto),
            "hn": F.count("dist").over(upto),
            "ends": F.lead(F.lit(True), 1, False).over(w) == F.lit(False),
        }
    )
    inside = Window.partitionBy("game", "slice", "piece").orderBy("n")
    here = F.when(F.col("dist").isNotNull(), F.struct("dist", "n", "frame"))
    return rows.withColumns(
        {
            "near": F.min(here).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            "dist_prev": F.last("dist", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )


def _counted(near, before):
    """``near`` with its point counted from the begin of the game instead of the slice."""
    return F.when(near.isNotNull(), F.struct(near["dist"].alias("dist"), (near["n"] + before).alias("n"), near["frame"].alias("frame")))


def _handed_on(pieces):
    """What each slice takes over, from the last point of each slice: points so far, the flight that goes on and its
    closest approach and last hoop distance so far."""
    c = F.col
    ends = pieces.where("ends").select(
        "game", "slice", "piece", "n", "hn", "near", F.coalesce("dist", "dist_prev").alias("dist"), slice_of("slice", SLICES).alias("top")
    )
    ends = staged(ends, "slice-ends")  # asked for several times below, found by one look at all points
    specs = {"n_all": ("sum", c("n")), "hn_all": ("sum", c("hn")), "flight": ("prev", c("piece"))}
    ends = running(ends, ["game"], ["slice"], specs, unit=["top"])
    ends = ends.withColumns({"n_before": c("n_all") - c("n"), "hn_before": c("hn_all") - c("hn")})
    # a flight's slices in order; each first asks what the ones before have left, then adds its own
    both = F.array(
        F.struct(F.lit(0).alias("at"), c("flight").alias("of"), F.lit(None).alias("near"), F.lit(None).alias("dist")),
        F.struct(
            F.lit(1).alias("at"), F.coalesce("piece", "flight").alias("of"), _counted(c("near"), c("n_before")).alias("near"), c("dist").alias("dist")
        ),
    )
    turns = ends.select("game", "slice", "top", "n_before", "hn_before", F.inline(both))
    specs = {"near_before": ("min", c("near")), "dist_before": ("last", c("dist"))}
    turns = running(turns, ["game", "of"], ["slice", "at"], specs, unit=["top"]).where("at = 0")
    return turns.select("game", "slice", c("of").alias("flight"), "n_before", "hn_before", "near_before", "dist_before")


def flight_steps(points, size=4096, keep=False):
    """Flight points plus the running closest approach and the previous hoop distance.

    What slices hand on is one small row each, written here. With ``keep`` the slices themselves are written too,
    for several consumers; without, one consumer computes the columns it asks for.
    """
    pieces = _pieces(points, size)
    if keep:
        pieces = staged(pieces, "flight-pieces")
    handed = staged(_handed_on(pieces), "flight-carries")
    c = F.col
    on = c("piece").isNull()
    before = lambda name: F.coalesce(name, F.lit(0))
    near = _counted(c("near"), before("n_before"))
    rows = pieces.join(handed, ["game", "slice"], "left")
    rows = rows.withColumns(
        {
            "flight": F.coalesce("piece", "flight"),
            "near": F.when(on, F.least(near, c("near_before"))).otherwise(near),
            "dist_prev": F.coalesce("dist_prev", F.when(on, c("dist_before"))),
            "n": c("n") + before("n_before"),
            "hn": c("hn") + before("hn_before"),
        }
    ).drop("piece", "ends", "n_before", "hn_before", "near_before", "dist_before")
    rebound = (F.col("near.dist") < 40) & (F.col("dist") > F.col("near.dist") + 35)
    return rows.withColumn("stop", F.coalesce(rebound, F.lit(False)))


def flights(steps):
    """One row per flight of ``flight_steps`` rows: its kinematics and its first close
    approach to a hoop."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    stops = F.when(F.col("stop"), F.col("n"))
    per = steps.groupBy(*KEY).agg(
        F.min("n").alias("n0"),
        F.count("*").alias("points"),
        F.max("hn").alias("hn_last"),
        F.count("dist").alias("hoop_points"),
        F.max("frame").alias("last_frame"),
        F.min_by("cx", "frame").alias("x_first"),
        F.max_by("cx", "frame").alias("x_last"),
        F.min_by("cy", "frame").alias("y_first"),
        F.avg("speed").alias("avg_speed"),
        one(F.col("dist") <= F.col("dist_prev")).alias("closing"),
        one(F.col("vy") >= F.col("vy_prev")).alias("vy_rising"),
        F.min_by("dist", F.when(F.col("dist").isNotNull(), F.col("frame"))).alias("dist_first"),
        F.min("dist").alias("dist_min"),
        F.max("dist").alias("dist_max"),
        F.min("cy").alias("y_min"),
        F.avg("cy").alias("y_avg"),
        F.max((F.col("vy_prev") < -1.5) & (F.col("vy") > -1)).alias("vy_turn"),
        F.min(F.when(F.col("arc"), F.col("n"))).alias("arc_n"),
        # field by field, as numbers can be aggregated by hashing: at the first stop, and at the last point
        *[F.min_by(F.col("near")[f], stops).alias(f"near_stop_{f}") for f in NEAR],
        *[F.max_by(F.col("near")[f], "n").alias(f"near_all_{f}") for f in NEAR],
    )
    best = {f: F.coalesce(f"near_stop_{f}", f"near_all_{f}") for f in NEAR}
    return per.select(
        *[c for c in per.columns if not c.startswith("near_")],
        (best["n"] - F.col("n0")).alias("best_k"),
        best["n"].alias("best_n"),
        best["dist"].alias("best_dist"),
        best["frame"].alias("peak_frame"),
    )


def approach_points(points_in_flight, flight_rows, size=4096):
    """The up to 151 points that lead to each flight's closest approach.

    Matched through the slices such a run can touch (151 points, gaps of at most
    GAP frames), so a long flight is met only where it is needed.
    """
    first = F.col("peak_frame") - GAP * RELEASE_POINTS
    wanted = flight_rows.where("best_n IS NOT NULL").select(
        *KEY,
        "best_n",
        F.explode(
            F.sequence(
                F.floor(first / size).cast("bigint"),
                F.floor(F.col("peak_frame") / size).cast("bigint"),
            )
        ).alias("slice"),
    )
    return points_in_flight.join(wanted, KEY + ["slice"]).where(
        (F.col("n") <= F.col("best_n")) & (F.col("n") >= F.col("best_n") - RELEASE_POINTS)
    )


def approach_figures(approach):
    """What the points before each flight's closest approach say, one row per flight.

    ``r_*`` describe the last 41 points, ``release_frame`` the start of the final arc: the
    latest step away from the hoop that is followed by mostly closing steps, else the
    first point with a hoop, or simply the first one when hardly any has a hoop.  One
    exchange serves all windows and the aggregation.
    """
    w = Window.partitionBy(*KEY).orderBy("n")
    whole = Window.partitionBy(*KEY)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rest = w.rowsBetween(1, Window.unboundedFollowing)
    c = F.col
    recent = c("n") >= c("best_n") - RECENT_POINTS
    rows = approach.withColumns(
        {
            "recent": recent,
            "p": F.sum(recent.cast("int")).over(upto) - 1,
            "m": F.sum(recent.cast("int")).over(whole),
            "i": F.count("dist").over(upto) - 1,
            "pairs": F.count("dist").over(whole),
            "hoop_prev": F.last("dist", ignorenulls=True).over(before),
            "r_hoop_prev": F.last(F.when(recent, c("dist")), ignorenulls=True).over(before),
            "point_prev": F.lag("dist").over(w),
            "vy_before": F.lag("vy").over(w),
        }
    )
    rows = rows.withColumns(
        {
            "ok": (c("dist") <= c("hoop_prev") + 8).cast("int"),
            "rvy": F.when(c("recent") & (c("p") >= 1), c("vy")),
            "rvy_prev": F.when(c("recent") & (c("p") >= 2), c("vy_before")),
        }
    )
    first_turn = F.when((c("rvy_prev") < -0.1) & (c("rvy") >= -0.05), c("p") - 1)
    rows = rows.withColumns(
        {
            "ok_after": F.coalesce(F.sum("ok").over(rest), F.lit(0)),
            "peak_i": F.min(first_turn).over(whole),
        }
    )
    steps_after = c("pairs") - c("i") - 1
    turn = (
        c("dist").isNotNull()
        & (c("i") >= 1)
        & (c("hoop_prev") < c("dist"))
        & (steps_after >= 2)
        & (c("ok_after") > d(0.65) * steps_after)
    )
    one = lambda cond: F.sum(F.when(c("recent") & cond, 1).otherwise(0)).cast("bigint")
    any_ = lambda cond: F.max(c("recent") & cond)
    near = F.when(c("recent"), c("dist"))
    mono = (c("p") >= 1) & (c("dist") <= c("point_prev") + 2)
    peak = lambda v: F.max(F.when(c("n") == c("best_n"), c(v)))
    hooped = F.when(c("dist").isNotNull(), c("frame"))
    out = rows.groupBy(*KEY).agg(
        *[peak(v).alias(n) for v, n in (("cx", "peak_x"), ("cy", "peak_y"),
                                        ("hoop_x", "peak_hoop_x"), ("hoop_y", "peak_hoop_y"))],
        F.min(F.when(c("recent"), c("frame"))).alias("r_first"),
        F.max("m").alias("r_points"),
        F.count(near).alias("r_hoops"),
        one(c("dist") <= c("r_hoop_prev") + 3).alias("r_closing"),
        any_((c("rvy_prev") < -0.05) & (c("rvy") > 0.05)).alias("r_turn"),
        F.min(near).alias("r_min"),
        F.max(near).alias("r_max"),
        F.min_by("dist", F.when(near.isNotNull(), c("n"))).alias("r_dist_first"),
        any_(c("rvy") < -0.1).alias("r_up"),
        any_(c("rvy") > 0.1).alias("r_down"),
        F.max("peak_i").alias("r_peak_i"),
        one(mono & (c("p") < c("peak_i"))).alias("r_mono_before"),
        one(mono & (c("p") > c("peak_i"))).alias("r_mono_after"),
        F.max("pairs").alias("pairs"),
        F.max(F.when(turn, c("frame"))).alias("turn_frame"),
        F.min(hooped).alias("hoop_frame"),
        F.min("frame").alias("first_frame"),
    )
    release = F.when(c("pairs") >= 4, F.coalesce("turn_frame", "hoop_frame")).otherwise(c("first_frame"))
    return out.withColumn("release_frame", release).drop(
        "pairs", "turn_frame", "hoop_frame", "first_frame"
    )


def _final_distance(points_in_flight):
    """Smallest of the last seven hoop distances (the rank limit is applied map-side)."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("n"))
    tail = points_in_flight.where("dist IS NOT NULL").select(*KEY, "n", "dist")
    tail = tail.withColumn("rn", F.row_number().over(w)).where("rn <= 7")
    return tail.groupBy(*KEY).agg(F.min("dist").alias("final_min"))


def shot_candidates(points, size=4096):
    """Every flight with the detector that takes it as a shot, or why it is rejected."""
    inside = flight_steps(points, size, keep=True)
    per = staged(flights(inside), "flights")
    approach = approach_points(inside, per, size)
    rows = per.join(approach_figures(approach), KEY, "left").join(
        _final_distance(inside), KEY, "left"
    )
    c = F.col
    steps = c("points") - 1
    arc_i = c("arc_n") - c("n0") - 1
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    far = (
        (c("points") >= 20)
        & (arc_i > 2)
        & (arc_i < steps - 2)
        & (F.abs(c("x_last") - c("x_first")) > FAR_TRAVEL)
        & ((c("y_first") + c("peak_y")) / d(2) - c("y_min") > ARC_HEIGHT)
        & (c("dist_first") > FAR_RELEASE)
        & (c("dist_min") < REACH)
    )
    recent = (
        (c("r_hoops") >= 6)
        & (c("r_closing") > d(0.6) * (c("r_hoops") - 1))
        & c("r_turn")
        & (c("r_min") < REACH)
        & (c("r_max") - c("r_min") > 200)
    )
    sub = (
        (c("points") > 10)
        & (c("r_hoops") > 5)
        & c("r_up")
        & c("r_down")
        & (c("r_peak_i") > 2)
        & (c("r_mono_before") > d(0.3) * F.greatest(F.lit(1), c("r_peak_i") - 1))
        & (c("r_mono_after") > d(0.3) * F.greatest(F.lit(1), c("r_points") - c("r_peak_i") - 1))
        & (c("r_min") < REACH)
        & (c("r_dist_first") - c("r_min") > 50)
    )
    strong = (
        (c("hoop_points") > 10)
        & (c("closing") > d(0.6) * (c("hoop_points") - 1))
        & (c("vy_rising") > d(0.6) * (steps - 1))
        & (c("dist_min") < REACH)
        & (c("dist_first") - c("dist_min") > 80)
    )
    arc_seen = yes(c("vy_turn")) | (c("y_min") < c("y_avg") - 25) | yes(strong)
    verdict = (
        F.when(c("points") < MIN_POINTS, F.lit("too_short"))
        .when(c("avg_speed").isNull(), F.lit("no_speeds"))
        .when((c("avg_speed") < MIN_SPEED) & (c("points") < 12), F.lit("low_speed"))
        .when(c("best_dist").isNull() | (c("best_dist") > MAX_HOOP_DIST), F.lit("no_hoop_approach"))
        .when(yes(far), F.lit("far_arc"))
        .when(yes(recent), F.lit("recent_arc"))
        .when(c("best_k") < F.floor(c("points") * d(0.1)), F.lit("early_peak"))
        .when(yes(sub), F.lit("subwindow_arc"))
        .when(c("final_min") > 250, F.lit("final_dists"))
        .when((c("hoop_points") > 5) & (c("dist_max") - c("dist_min") < 200), F.lit("total_drop"))
        .when(c("dist_min") > 80, F.lit("never_reached_hoop"))
        .when(~arc_seen, F.lit("arc_check"))
        .otherwise(F.lit("fallback_arc"))
    )
    sliced = c("verdict").isin("recent_arc", "subwindow_arc")
    rows = rows.withColumn("verdict", verdict).withColumns(
        {
            "shot": c("verdict").isin("far_arc", "recent_arc", "subwindow_arc", "fallback_arc"),
            "far": yes(far),
            "recent": yes(recent),
            "sub": yes(sub),
            "fallback": arc_seen & (c("final_min") <= 250) & (c("dist_min") <= 80)
            & ((c("hoop_points") <= 5) | (c("dist_max") - c("dist_min") >= 200)),
            "start_frame": F.when(sliced, c("r_first")).otherwise(c("flight")),
            "end_frame": F.when(sliced, c("peak_frame")).otherwise(c("last_frame")),
            "closest": F.when(sliced, c("r_min"))
            .when(c("verdict") == "far_arc", c("dist_min"))
            .otherwise(c("best_dist")),
            "peak_detected": c("verdict") != "subwindow_arc",
        }
    )
    return rows


def cooldown(shots, wait=COOLDOWN, keys=("game",), peak="peak_frame", size=4096):
    """Accept a shot when its peak is ``wait`` frames past the last accepted one.

    What a slice of frames does depends on its past only by how long ago the last accepted shot was, 1 to ``wait``
    frames (or more). So each slice is turned into a table of what it makes of each of these cases, tables are composed per
    group of ``SLICES`` slices and per game, and each slice is then walked once from its true start. A game of
    candidates that all lie close together is spread over its slices; nothing is gathered but a slice's peaks and tables.
    """
    keys = list(keys)
    rows = shots.withColumnRenamed(peak, "__peak").withColumn("slice", slice_of("__peak", size))
    rows = rows.withColumn("group", slice_of("slice", SLICES))
    border = F.col("slice") * size
    after = lambda last, p: F.when(p - last >= wait, p).otherwise(last)
    walked = lambda since: F.aggregate("peaks", border - since, after)
    cases = F.sequence(F.lit(1).cast("bigint"), F.lit(wait).cast("bigint"))
    table = F.transform(cases, lambda since: F.least(border + size - walked(since), F.lit(wait).cast("bigint")))
    parts = rows.groupBy(*keys, "group", "slice").agg(F.array_sort(F.collect_list("__peak")).alias("peaks"))
    parts = parts.withColumn("table", table)

    # a slice without candidates is as long as many waits: after it, any shot is accepted
    free = F.lit(wait).cast("bigint")
    enter = lambda s, t: F.when(t["at"] == s["at"] + 1, s["since"]).otherwise(free)
    since = lambda s, t: F.struct(t["at"].alias("at"), F.element_at(t["table"], enter(s, t).cast("int")).alias("since"))
    start = lambda at, case: F.struct(at.cast("bigint").alias("at"), case.alias("since"))
    ordered = lambda at: F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "table")))

    groups = parts.groupBy(*keys, "group").agg(ordered("slice").alias("tables"))
    first = F.col("group") * SLICES - 1  # the slice before the group
    through = F.transform(cases, lambda c: F.aggregate("tables", start(first, c), since))
    idle = F.element_at("tables", -1)["at"] < first + SLICES  # its last slices are empty
    whole = groups.withColumn("table", F.transform(through, lambda e: F.when(idle, free).otherwise(e["since"])))
    chain = lambda at, case: F.aggregate(
        "tables",
        F.struct(start(at, case).alias("s"), F.array().cast("array<struct<at:bigint,since:bigint>>").alias("out")),
        lambda acc, t: F.struct(
            since(acc["s"], t).alias("s"),
            F.concat(acc["out"], F.array(F.struct(t["at"].alias("at"), enter(acc["s"], t).alias("since")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    games = whole.groupBy(*keys).agg(ordered("group").alias("tables"))
    begun = games.select(*keys, F.inline(chain(F.lit(-(1 << 62)), free))).withColumnsRenamed({"at": "group", "since": "entry"})
    starts = groups.join(begun, [*keys, "group"]).select(*keys, F.inline(chain(first, F.col("entry")))).withColumnRenamed("at", "slice")
    pick = F.aggregate(
        "peaks",
        F.struct((border - F.col("since")).alias("last"), F.array().cast("array<bigint>").alias("kept")),
        lambda acc, p: F.when(
            p - acc["last"] >= wait, F.struct(p.alias("last"), F.concat(acc["kept"], F.array(p)).alias("kept"))
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    kept = parts.join(starts, [*keys, "slice"]).select(*keys, "slice", F.explode(pick).alias("__peak"))
    out = rows.join(kept.withColumn("accepted", F.lit(True)), [*keys, "slice", "__peak"], "left")
    out = out.withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return out.select(*[F.col("__peak").alias(peak) if c == peak else c for c in shots.columns], "accepted")


def find_shots(points, size=4096):
    """Accepted shots, one row each."""
    found = staged(shot_candidates(points, size).where("shot"), "shot-candidates")
    return staged(cooldown(found).where("accepted").drop("accepted"), "shots")


def shot_report(shots, crash_counts, fps=60.0):
    """Numbered report rows; numbering runs over a game's shots in time order."""
    seconds = lambda c: rounded(F.col(c) / d(fps), 3)
    rows = numbered(shots, ["game"], "peak_frame", "shot_number")
    rows = rows.join(crash_counts, ["game", "peak_frame"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return rows.select(
        "game",
        "shot_number",
        "start_frame",
        "end_frame",
        "peak_frame",
        seconds("start_frame").alias("start_time_s"),
        seconds("end_frame").alias("end_time_s"),
        seconds("peak_frame").alias("peak_time_s"),
        rounded("closest", 1).alias("closest_dist_px"),
        rounded("avg_speed", 2).alias("avg_speed_px_per_frame"),
        "peak_detected",
        F.col("peak_hoop_x").alias("hoop_center_x"),
        F.col("peak_hoop_y").alias("hoop_center_y"),
        F.col("peak_x").alias("ball_x_at_peak"),
        F.col("peak_y").alias("ball_y_at_peak"),
        count("team_0").alias("team_1_crashes"),
        count("team_1").alias("team_2_crashes"),
        count("unknown").alias("unknown_crashes"),
        (count("team_0") + count("team_1") + count("unknown")).alias("total_crashes"),
    )


def overlay(points, shots, hold=OVERLAY, part=256):
    """The shot shown at each point's frame: [release, peak + hold); the later shot wins."""
    span = shots.select(
        "game",
        F.col("release_frame").alias("lo"),
        (F.col("peak_frame") + hold).alias("hi"),
        F.col("peak_frame").alias("shot_peak"),
    )
    span = span.withColumn(
        "part",
        F.explode(
            F.sequence(
                F.floor(F.col("lo") / part).cast("bigint"),
                F.floor((F.col("hi") - 1) / part).cast("bigint"),
            )
        ),
    )
    rows = points.select("game", "frame", slice_of("frame", part).alias("part"))
    hit = rows.join(span, ["game", "part"]).where(
        (F.col("frame") >= F.col("lo")) & (F.col("frame") < F.col("hi"))
    )
    return hit.groupBy("game", "frame").agg(F.max("shot_peak").alias("shot_peak"))


def prev_frame_vy(points):
    """Vertical step from exactly the previous frame; 0 where that frame has no ball."""
    w = Window.partitionBy("game", "slice").orderBy("frame")
    rows = halo(points, before=1)
    prev = F.when(F.lag("frame").over(w) == F.col("frame") - 1, F.lag("cy").over(w))
    rows = own(rows.withColumn("prev_cy", prev)).drop("slice")
    return rows.withColumn("vy", F.coalesce(F.col("cy") - F.col("prev_cy"), d(0)))


def shot_probability(points, every_frame, block=256):
    """Smoothed shot probability for each frame of ``every_frame`` (game, frame).

    The smoothing is linear, so the frames that carry a ball and a hoop are cut into
    blocks of ``block`` rows: within a block it is a weighted running sum, and what an
    older block still weighs (0.85^256) is far below double precision beyond the
    previous one.
    """
    rows = prev_frame_vy(points).where("hoop_x IS NOT NULL")
    near = F.greatest(d(0), d(1) - distance("cx", "cy", "hoop_x", "hoop_y") / d(300))
    arc = (
        F.when(F.col("prev_cy").isNull(), d(0)).when(F.col("vy") < 0, d(1)).otherwise(d(0.3))
    )
    rows = rows.select("game", "frame", (d(0.6) * near + d(0.4) * arc).alias("raw"))
    rows = row_blocks(rows, ["game"], size=block)
    w = Window.partitionBy("game", "block").orderBy("idx")
    pos = F.col("idx") - F.col("block") * block
    rows = rows.withColumn("pos", pos)
    inside = d(PROB_NEW) * F.sum(F.col("raw") * F.pow(d(PROB_KEEP), -F.col("pos"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("part_prob", inside * F.pow(d(PROB_KEEP), F.col("pos")))
    ends = rows.where(F.col("pos") == block - 1).select("game", "block", "part_prob")
    carry = None
    for back in (1, 2):
        shifted = ends.select(
            "game",
            (F.col("block") + back).alias("block"),
            (F.col("part_prob") * d(PROB_KEEP ** (block * (back - 1)))).alias(f"carry{back}"),
        )
        carry = shifted if carry is None else carry.join(shifted, ["game", "block"], "left")
    rows = rows.join(carry, ["game", "block"], "left")
    old = F.coalesce("carry1", d(0)) + F.coalesce("carry2", d(0))
    active = rows.select(
        "game",
        "frame",
        (F.col("part_prob") + F.pow(d(PROB_KEEP), F.col("pos") + 1) * old).alias("active"),
    )
    shown = every_frame.select("game", "frame").join(active, ["game", "frame"], "left")
    shown = running(
        shown.withColumn("slice", slice_of("frame")),
        ["game"],
        ["frame"],
        {"state": ("last", F.col("active"))},
    )
    faded = F.coalesce("state", d(0)) * d(0.9)
    return shown.select(
        "game",
        "frame",
        F.coalesce("active", faded).alias("prob"),
        F.col("active").isNotNull().alias("updated"),
    )


def every_frame(rows, size=4096):
    """Dense frame index 0..last of each game, unrolled slice by slice."""
    last = rows.groupBy("game").agg(F.max("frame").alias("last"))
    parts = last.select(
        "game", "last", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / size))).alias("part")
    )
    lo = F.col("part") * size
    return parts.repartition("game", "part").select(
        "game", F.explode(F.sequence(lo, F.least(lo + size - 1, F.col("last")))).alias("frame")
    )


def debug_metrics(points, frames, step=5):
    """Distance, vertical step and probability on every ``step``-th frame with ball and hoop."""
    probs = shot_probability(points, frames).where("updated").where(F.col("frame") % step == 0)
    rows = prev_frame_vy(points).where("hoop_x IS NOT NULL").where(F.col("frame") % step == 0)
    return rows.join(probs, ["game", "frame"]).select(
        "game",
        "frame",
        rounded(distance("cx", "cy", "hoop_x", "hoop_y"), 2).alias("dist"),
        rounded("vy", 2).alias("vy"),
        rounded("prob", 2).alias("prob"),
    )
