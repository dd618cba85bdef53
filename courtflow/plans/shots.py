"""Shots, crashes and their reports."""

from pyspark.sql import functions as F

from ..functions.geometry import rounded
from ..operators import crashes, shots
from ..session import staged
from .inputs import with_inputs
from .registry import query, r

# ---- the same questions in SQL ------------------------------------------------------

FLIGHTS = [
    ("f0", "SELECT *, frame - lag(frame) OVER (PARTITION BY game ORDER BY frame) AS dt FROM ball_points"),
    (
        "f1",
        """SELECT *, max(CASE WHEN dt IS NULL OR dt > 10 THEN frame END)
             OVER (PARTITION BY game ORDER BY frame) AS flight FROM f0""",
    ),
    (
        "f2",
        """SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS k,
             (cx - lag(cx) OVER w) / dt AS vx, (cy - lag(cy) OVER w) / dt AS vy,
             sqrt((cx - hoop_x) * (cx - hoop_x) + (cy - hoop_y) * (cy - hoop_y)) AS dist
           FROM f1 WINDOW w AS (PARTITION BY game, flight ORDER BY frame)""",
    ),
    (
        "pts",
        """SELECT *, sqrt(vx * vx + vy * vy) AS speed, lag(vy) OVER w AS vy1, lag(vy, 2) OVER w AS vy2,
             lead(vy) OVER w AS vy_next
           FROM f2 WINDOW w AS (PARTITION BY game, flight ORDER BY frame)""",
    ),
    (
        "hd",
        """SELECT game, flight, k, frame, dist, cx, cy, hoop_x, hoop_y,
             row_number() OVER w - 1 AS di, lag(dist) OVER w AS dprev, min(dist) OVER w AS runmin,
             row_number() OVER (PARTITION BY game, flight ORDER BY k DESC) AS back
           FROM pts WHERE dist IS NOT NULL WINDOW w AS (PARTITION BY game, flight ORDER BY k)""",
    ),
    (
        "stops",
        """SELECT game, flight, min(CASE WHEN runmin < 40 AND dist > runmin + 35 THEN k END) AS stop
           FROM hd GROUP BY game, flight""",
    ),
    (
        "best",
        """SELECT * FROM (
             SELECT hd.*, row_number() OVER (PARTITION BY game, flight ORDER BY dist, k) AS rn
             FROM hd JOIN stops USING (game, flight) WHERE stop IS NULL OR k < stop) a WHERE rn = 1""",
    ),
    (
        "wins",
        """SELECT game, flight, CAST(count(*) AS BIGINT) AS points, max(frame) AS last_frame,
             avg(speed) AS avg_speed, CAST(count(*) FILTER (vy >= vy1) AS BIGINT) AS vy_rising,
             arg_max(cx, k) AS x_last, arg_min(cx, k) AS x_first, arg_min(cy, k) AS y_first,
             min(cy) AS y_min, avg(cy) AS y_avg,
             coalesce(bool_or(vy1 < -1.5e0 AND vy > -1), false) AS vy_turn,
             min(CASE WHEN (vy2 + vy1) / 2e0 < -0.8e0 AND (vy + vy_next) / 2e0 > -0.2e0
                 THEN k - 1 END) AS arc_i
           FROM pts GROUP BY game, flight""",
    ),
    (
        "wd",
        """SELECT game, flight, CAST(count(*) AS BIGINT) AS hoop_points,
             CAST(count(*) FILTER (dist <= dprev) AS BIGINT) AS closing,
             arg_min(dist, k) AS dist_first, min(dist) AS dist_min, max(dist) AS dist_max,
             min(dist) FILTER (back <= 7) AS final_min
           FROM hd GROUP BY game, flight""",
    ),
]

RECENT = [
    (
        "rp",
        """SELECT p.*, b.k AS bk, p.k - greatest(b.k - 40, 0) AS pos
           FROM pts p JOIN best b USING (game, flight) WHERE p.k BETWEEN b.k - 40 AND b.k""",
    ),
    (
        "rv",
        """SELECT game, flight, pos, CASE WHEN pos >= 1 THEN vy END AS rvy,
             CASE WHEN pos >= 2 THEN vy1 END AS rvy1 FROM rp""",
    ),
    (
        "rturn",
        """SELECT game, flight, coalesce(bool_or(rvy1 < -0.05e0 AND rvy > 0.05e0), false) AS turn,
             coalesce(bool_or(rvy < -0.1e0), false) AS up, coalesce(bool_or(rvy > 0.1e0), false) AS down,
             min(CASE WHEN rvy1 < -0.1e0 AND rvy >= -0.05e0 THEN pos - 1 END) AS peak_i
           FROM rv GROUP BY game, flight""",
    ),
    (
        "rh",
        """SELECT game, flight, pos, dist, lag(dist) OVER (PARTITION BY game, flight ORDER BY pos) AS dp
           FROM rp WHERE dist IS NOT NULL""",
    ),
    (
        "rdist",
        """SELECT game, flight, CAST(count(*) AS BIGINT) AS hoops,
             CAST(count(*) FILTER (dist <= dp + 3) AS BIGINT) AS closing3, min(dist) AS r_min,
             max(dist) AS r_max, arg_min(dist, pos) AS r_first_dist
           FROM rh GROUP BY game, flight""",
    ),
    (
        "rmono",
        """SELECT a.game, a.flight,
             CAST(count(*) FILTER (a.dist <= b.dist + 2 AND a.pos < t.peak_i) AS BIGINT) AS before,
             CAST(count(*) FILTER (a.dist <= b.dist + 2 AND a.pos > t.peak_i) AS BIGINT) AS after
           FROM rp a JOIN rp b ON a.game = b.game AND a.flight = b.flight AND b.pos = a.pos - 1
           JOIN rturn t ON t.game = a.game AND t.flight = a.flight GROUP BY a.game, a.flight""",
    ),
    ("rsize", "SELECT game, flight, min(frame) AS r_first, count(*) AS r_points FROM rp GROUP BY game, flight"),
]

RELEASE = [
    (
        "lp",
        """SELECT p.game, p.flight, p.k, p.frame, p.dist FROM pts p JOIN best b USING (game, flight)
           WHERE p.k BETWEEN b.k - 150 AND b.k""",
    ),
    (
        "lh",
        """SELECT *, row_number() OVER w - 1 AS i, lag(dist) OVER w AS dp,
             count(*) OVER (PARTITION BY game, flight) AS n
           FROM lp WHERE dist IS NOT NULL WINDOW w AS (PARTITION BY game, flight ORDER BY k)""",
    ),
    (
        "lc",
        """SELECT a.game, a.flight, a.frame, a.i, a.n FROM lh a JOIN lh b
             ON a.game = b.game AND a.flight = b.flight AND b.i > a.i
           WHERE a.i >= 1 AND a.i <= a.n - 3 AND a.dp < a.dist
           GROUP BY a.game, a.flight, a.frame, a.i, a.n
           HAVING count(*) FILTER (b.dist <= b.dp + 8) > 0.65e0 * (a.n - a.i - 1)""",
    ),
    (
        "rel",
        """SELECT f.game, f.flight, CASE WHEN coalesce(h.n, 0) < 4 THEN f.first_frame
             ELSE coalesce(t.turn_frame, h.hoop_frame) END AS release_frame
           FROM (SELECT game, flight, min(frame) AS first_frame FROM lp GROUP BY game, flight) f
           LEFT JOIN (SELECT game, flight, max(n) AS n, min(frame) AS hoop_frame FROM lh GROUP BY game, flight) h
             USING (game, flight)
           LEFT JOIN (SELECT game, flight, max(frame) AS turn_frame FROM lc GROUP BY game, flight) t
             USING (game, flight)""",
    ),
]

CASCADE = FLIGHTS + RECENT + RELEASE + [
    (
        "rules",
        """SELECT w.game, w.flight, points, last_frame, avg_speed, b.k AS best_k, b.dist AS best_dist,
             b.frame AS peak_frame, b.cx AS peak_x, b.cy AS peak_y, b.hoop_x AS peak_hoop_x,
             b.hoop_y AS peak_hoop_y, dist_min, r_min, r_first, release_frame, dist_max, final_min,
             coalesce(hoop_points, 0) AS hoop_points,
             coalesce(points >= 20 AND arc_i > 2 AND arc_i < points - 3 AND abs(x_last - x_first) > 80
               AND (y_first + b.cy) / 2e0 - y_min > 25 AND dist_first > 180 AND dist_min < 80, false) AS far,
             coalesce(hoops >= 6 AND closing3 > 0.6e0 * (hoops - 1) AND turn AND r_min < 80
               AND r_max - r_min > 200, false) AS recent,
             coalesce(points > 10 AND hoops > 5 AND up AND down AND peak_i > 2
               AND before > 0.3e0 * greatest(1, peak_i - 1)
               AND after > 0.3e0 * greatest(1, r_points - peak_i - 1)
               AND r_min < 80 AND r_first_dist - r_min > 50, false) AS sub,
             vy_turn OR y_min < y_avg - 25 OR coalesce(hoop_points > 10
               AND closing > 0.6e0 * (hoop_points - 1) AND vy_rising > 0.6e0 * (points - 2)
               AND dist_min < 80 AND dist_first - dist_min > 80, false) AS arc_seen
           FROM wins w LEFT JOIN wd USING (game, flight) LEFT JOIN best b USING (game, flight)
           LEFT JOIN rturn USING (game, flight) LEFT JOIN rdist USING (game, flight)
           LEFT JOIN rmono USING (game, flight) LEFT JOIN rsize USING (game, flight)
           LEFT JOIN rel USING (game, flight)""",
    ),
    (
        "cand",
        """SELECT *, CASE WHEN points < 8 THEN 'too_short' WHEN avg_speed IS NULL THEN 'no_speeds'
             WHEN avg_speed < 1 AND points < 12 THEN 'low_speed'
             WHEN best_dist IS NULL OR best_dist > 600 THEN 'no_hoop_approach'
             WHEN far THEN 'far_arc' WHEN recent THEN 'recent_arc'
             WHEN best_k < floor(points * 0.1e0) THEN 'early_peak' WHEN sub THEN 'subwindow_arc'
             WHEN final_min > 250 THEN 'final_dists'
             WHEN hoop_points > 5 AND dist_max - dist_min < 200 THEN 'total_drop'
             WHEN dist_min > 80 THEN 'never_reached_hoop' WHEN NOT arc_seen THEN 'arc_check'
             ELSE 'fallback_arc' END AS verdict FROM rules""",
    ),
    (
        "shot_rows",
        """SELECT *, verdict <> 'subwindow_arc' AS peak_detected,
             CASE WHEN verdict IN ('recent_arc', 'subwindow_arc') THEN r_first ELSE flight END AS start_frame,
             CASE WHEN verdict IN ('recent_arc', 'subwindow_arc') THEN peak_frame ELSE last_frame END AS end_frame,
             CASE WHEN verdict IN ('recent_arc', 'subwindow_arc') THEN r_min
               WHEN verdict = 'far_arc' THEN dist_min ELSE best_dist END AS closest,
             row_number() OVER (PARTITION BY game ORDER BY peak_frame) AS rn
           FROM cand WHERE verdict IN ('far_arc', 'recent_arc', 'subwindow_arc', 'fallback_arc')""",
    ),
    (
        "walk",
        """SELECT game, rn, peak_frame, true AS accepted, peak_frame AS last_peak FROM shot_rows WHERE rn = 1
           UNION ALL
           SELECT s.game, s.rn, s.peak_frame, s.peak_frame - w.last_peak >= 60,
             CASE WHEN s.peak_frame - w.last_peak >= 60 THEN s.peak_frame ELSE w.last_peak END
           FROM walk w JOIN shot_rows s ON s.game = w.game AND s.rn = w.rn + 1""",
    ),
    ("shots", "SELECT s.* FROM shot_rows s JOIN walk w USING (game, rn) WHERE w.accepted"),
]

CRASHES = CASCADE + [
    (
        "near_players",
        """SELECT s.game, s.peak_frame, s.peak_hoop_x AS hx, s.peak_hoop_y AS hy, p.frame, p.tid, p.cx,
             p.cy, p.team
           FROM shots s JOIN players p ON p.game = s.game
             AND p.frame BETWEEN s.peak_frame AND s.peak_frame + 90""",
    ),
    (
        "votes",
        """SELECT game, peak_frame, tid, team FROM (
             SELECT *, row_number() OVER (PARTITION BY game, peak_frame, tid ORDER BY n DESC, first) AS rn
             FROM (SELECT game, peak_frame, tid, team, count(*) AS n, min(frame) AS first
                   FROM near_players WHERE team IS NOT NULL GROUP BY game, peak_frame, tid, team) a) b
           WHERE rn = 1""",
    ),
    (
        "ends",
        """SELECT game, peak_frame, tid, arg_min(cx, frame) AS start_x, arg_min(cy, frame) AS start_y,
             arg_max(cx, frame) AS end_x, arg_max(cy, frame) AS end_y, min(hx) AS hx, min(hy) AS hy
           FROM near_players GROUP BY game, peak_frame, tid""",
    ),
    (
        "moves",
        """SELECT *, sqrt((start_x - hx) * (start_x - hx) + (start_y - hy) * (start_y - hy)) AS d0,
             sqrt((start_x - hx) * (start_x - hx) + (start_y - hy) * (start_y - hy))
               - sqrt((end_x - hx) * (end_x - hx) + (end_y - hy) * (end_y - hy)) AS moved FROM ends""",
    ),
    (
        "crashers",
        """SELECT m.*, CASE WHEN v.team IN (0, 1) THEN 'team_' || CAST(v.team AS VARCHAR)
               ELSE 'unknown' END AS bucket
           FROM moves m LEFT JOIN votes v USING (game, peak_frame, tid)
           WHERE d0 <= 270 AND NOT (d0 < 65 AND moved < 15) AND (d0 <= 200 OR moved >= 40)""",
    ),
    (
        "counts",
        """SELECT game, peak_frame, CAST(count(*) FILTER (bucket = 'team_0') AS BIGINT) AS team_0,
             CAST(count(*) FILTER (bucket = 'team_1') AS BIGINT) AS team_1,
             CAST(count(*) FILTER (bucket = 'unknown') AS BIGINT) AS unknown
           FROM crashers GROUP BY game, peak_frame""",
    ),
]

REPORT = f"""SELECT game, CAST(row_number() OVER (PARTITION BY game ORDER BY peak_frame) AS BIGINT) AS shot_number,
  start_frame, end_frame, peak_frame, {r('start_frame / 60e0', 3)} AS start_time_s,
  {r('end_frame / 60e0', 3)} AS end_time_s, {r('peak_frame / 60e0', 3)} AS peak_time_s,
  {r('closest', 1)} AS closest_dist_px, {r('avg_speed', 2)} AS avg_speed_px_per_frame, peak_detected,
  peak_hoop_x AS hoop_center_x, peak_hoop_y AS hoop_center_y, peak_x AS ball_x_at_peak,
  peak_y AS ball_y_at_peak, coalesce(team_0, 0) AS team_1_crashes, coalesce(team_1, 0) AS team_2_crashes,
  coalesce(unknown, 0) AS unknown_crashes,
  coalesce(team_0, 0) + coalesce(team_1, 0) + coalesce(unknown, 0) AS total_crashes
  FROM shots LEFT JOIN counts USING (game, peak_frame)"""

BOARD = f"""SELECT game, peak_frame, tid, bucket, {r('d0', 1)} AS initial_dist,
  {r('moved', 1)} AS displacement, start_x, start_y FROM crashers"""

PROBS = [
    (
        "act",
        """SELECT a.game, a.frame, row_number() OVER (PARTITION BY a.game ORDER BY a.frame) AS rn,
             0.6e0 * greatest(0e0, 1e0 - sqrt((a.cx - hoop_x) * (a.cx - hoop_x)
               + (a.cy - hoop_y) * (a.cy - hoop_y)) / 300e0)
             + 0.4e0 * CASE WHEN p.cy IS NULL THEN 0e0 WHEN a.cy - p.cy < 0 THEN 1e0 ELSE 0.3e0 END AS raw
           FROM ball_points a LEFT JOIN (SELECT game, frame + 1 AS frame, cy FROM ball_points) p
             USING (game, frame) WHERE hoop_x IS NOT NULL""",
    ),
    (
        "ema",
        """SELECT game, frame, rn, 0.15e0 * raw AS prob FROM act WHERE rn = 1
           UNION ALL SELECT a.game, a.frame, a.rn, 0.85e0 * e.prob + 0.15e0 * a.raw
           FROM ema e JOIN act a ON a.game = e.game AND a.rn = e.rn + 1""",
    ),
    (
        "timeline",
        """SELECT game, CAST(unnest(range(0, top + 1)) AS BIGINT) AS frame
           FROM (SELECT game, max(frame) AS top FROM ball_points GROUP BY game) a""",
    ),
    (
        "shown",
        """SELECT t.game, t.frame, e.prob, last_value(e.prob IGNORE NULLS)
             OVER (PARTITION BY t.game ORDER BY t.frame) AS state
           FROM timeline t LEFT JOIN ema e USING (game, frame)""",
    ),
]

DEBUG = f"""SELECT game, frame, {r('sqrt((a.cx - hoop_x) * (a.cx - hoop_x) + (a.cy - hoop_y) * (a.cy - hoop_y))', 2)} AS dist,
  {r('coalesce(a.cy - p.cy, 0e0)', 2)} AS vy, {r('e.prob', 2)} AS prob
  FROM ball_points a JOIN ema e USING (game, frame)
  LEFT JOIN (SELECT game, frame + 1 AS frame, cy FROM ball_points) p USING (game, frame)
  WHERE frame % 5 = 0"""

# ---- queries ------------------------------------------------------------------------


@query(
    "ball_trajectory",
    with_inputs(
        "ball_points hoops",
        """SELECT b.game, b.frame, b.cx, b.cy, (h.x1 + h.x2) / 2e0 AS hoop_x, (h.y1 + h.y2) / 2e0 AS hoop_y
           FROM ball_points b LEFT JOIN hoops h ON h.game = b.game AND h.frame = b.frame AND h.idx = 0""",
    ),
)
def ball_trajectory(src):
    return shots.ball_trajectory(src.ball_points.select("game", "frame", "cx", "cy"), src.hoops)


@query(
    "flight_windows",
    with_inputs(
        "ball_points",
        "SELECT game, flight, last_frame, points FROM wins WHERE points >= 8",
        FLIGHTS,
    ),
)
def flight_windows(src):
    rows = shots.flight_points(src.ball_points).groupBy("game", "flight")
    rows = rows.agg(F.max("frame").alias("last_frame"), F.count("*").alias("points"))
    return rows.where(F.col("points") >= shots.MIN_POINTS)


@query(
    "flight_kinematics",
    with_inputs(
        "ball_points",
        f"""SELECT game, flight, points, {r('avg_speed', 4)} AS avg_speed, closing, vy_rising,
             {r('dist_min', 4)} AS dist_min, {r('dist_max', 4)} AS dist_max,
             {r('dist_max - dist_min', 4)} AS total_drop
           FROM wins LEFT JOIN wd USING (game, flight) WHERE points >= 8""",
        FLIGHTS,
    ),
)
def flight_kinematics(src):
    rows = shots.flights(shots.flight_steps(src.ball_points)).where(F.col("points") >= shots.MIN_POINTS)
    return rows.select(
        "game",
        "flight",
        "points",
        rounded("avg_speed", 4).alias("avg_speed"),
        F.when(F.col("hoop_points") > 0, F.col("closing")).alias("closing"),
        "vy_rising",
        rounded("dist_min", 4).alias("dist_min"),
        rounded("dist_max", 4).alias("dist_max"),
        rounded(F.col("dist_max") - F.col("dist_min"), 4).alias("total_drop"),
    )


@query(
    "first_close_approach",
    with_inputs(
        "ball_points",
        f"""SELECT b.game, b.flight, b.k AS best_k, b.frame AS peak_frame, {r('b.dist', 4)} AS best_dist
           FROM best b JOIN wins USING (game, flight) WHERE points >= 8 AND b.dist <= 600""",
        FLIGHTS,
    ),
)
def first_close_approach(src):
    rows = shots.flights(shots.flight_steps(src.ball_points)).where(F.col("points") >= shots.MIN_POINTS)
    return rows.where(F.col("best_dist") <= shots.MAX_HOOP_DIST).select(
        "game", "flight", "best_k", "peak_frame", rounded("best_dist", 4).alias("best_dist")
    )


@query(
    "release_frame",
    with_inputs("ball_points", "SELECT game, flight, release_frame FROM rel", FLIGHTS + RELEASE),
)
def release_frame(src):
    inside = shots.flight_steps(src.ball_points, keep=True)
    found = shots.approach_figures(shots.approach_points(inside, shots.flights(inside)))
    return found.select("game", "flight", "release_frame")


def _detector(name, flag, sql_flag):
    @query(
        name,
        with_inputs(
            "ball_points",
            f"""SELECT game, flight, points, {sql_flag} AS hit FROM cand
                WHERE points >= 8 AND best_dist <= 600""",
            CASCADE,
        ),
    )
    def run(src):
        rows = shots.shot_candidates(src.ball_points)
        rows = rows.where("points >= 8 AND best_dist <= 600")
        return rows.select("game", "flight", "points", F.coalesce(flag, F.lit(False)).alias("hit"))

    return run


_detector("far_arc", "far", "far")
_detector("recent_arc", "recent", "recent")
_detector("subwindow_arc", "sub", "sub")
_detector(
    "fallback_arc",
    "fallback",
    """coalesce(arc_seen AND final_min <= 250 AND dist_min <= 80
       AND (hoop_points <= 5 OR dist_max - dist_min >= 200), false)""",
)


@query(
    "shot_candidates",
    with_inputs(
        "ball_points",
        """SELECT game, flight, points, best_k, peak_frame, verdict,
             verdict IN ('far_arc', 'recent_arc', 'subwindow_arc', 'fallback_arc') AS shot FROM cand""",
        CASCADE,
    ),
)
def shot_candidates(src):
    return shots.shot_candidates(src.ball_points).select(
        "game", "flight", "points", "best_k", "peak_frame", "verdict", "shot"
    )


@query(
    "shot_cooldown",
    with_inputs("ball_points", "SELECT game, peak_frame, accepted FROM walk", CASCADE),
)
def shot_cooldown(src):
    rows = shots.cooldown(
        staged(shots.shot_candidates(src.ball_points).where("shot"), "shot-candidates")
    )
    return rows.select("game", "peak_frame", "accepted")


@query(
    "shot_player_range",
    with_inputs(
        "ball_points players",
        "SELECT game, peak_frame, frame, tid, cx, cy FROM near_players",
        CRASHES,
    ),
)
def shot_player_range(src):
    rows = crashes.players_after_shot(shots.find_shots(src.ball_points), src.players)
    return rows.select("game", "peak_frame", "frame", "tid", "cx", "cy")


@query(
    "team_majority",
    with_inputs("ball_points players", "SELECT game, peak_frame, tid, team FROM votes", CRASHES),
)
def team_majority(src):
    rows = crashes.players_after_shot(shots.find_shots(src.ball_points), src.players)
    return crashes.team_majority(rows)


@query("board_crashes", with_inputs("ball_points players", BOARD, CRASHES))
def board_crashes(src):
    return crashes.board_crashes(shots.find_shots(src.ball_points), src.players)


@query(
    "crash_counts",
    with_inputs(
        "ball_points players",
        "SELECT *, team_0 + team_1 + unknown AS total FROM counts",
        CRASHES,
    ),
)
def crash_counts(src):
    found = staged(
        crashes.board_crashes(shots.find_shots(src.ball_points), src.players), "crashes"
    )
    total = F.col("team_0") + F.col("team_1") + F.col("unknown")
    return crashes.crash_counts(found).withColumn("total", total)


def report(src):
    found = shots.find_shots(src.ball_points)
    counts = crashes.crash_counts(crashes.board_crashes(found, src.players))
    return shots.shot_report(found, counts)


@query("shot_report", with_inputs("ball_points players", REPORT, CRASHES))
def shot_report(src):
    return report(src)


@query(
    "overlay_interval_join",
    with_inputs(
        "ball_points",
        """SELECT b.game, b.frame, max(s.peak_frame) AS shot_peak FROM ball_points b JOIN shots s
             ON s.game = b.game AND b.frame >= s.release_frame AND b.frame < s.peak_frame + 90
           GROUP BY b.game, b.frame""",
        CASCADE,
    ),
)
def overlay_interval_join(src):
    return shots.overlay(src.ball_points, shots.find_shots(src.ball_points))


@query(
    "prev_frame_vy",
    with_inputs(
        "ball_points",
        """SELECT a.game, a.frame, coalesce(a.cy - p.cy, 0e0) AS vy FROM ball_points a
           LEFT JOIN (SELECT game, frame + 1 AS frame, cy FROM ball_points) p USING (game, frame)""",
    ),
)
def prev_frame_vy(src):
    return shots.prev_frame_vy(src.ball_points).select("game", "frame", "vy")


@query(
    "shot_probability",
    with_inputs(
        "ball_points",
        f"""SELECT game, frame, {r('coalesce(prob, coalesce(state, 0e0) * 0.9e0) + 3e-10', 6)} AS prob
            FROM shown""",
        PROBS,
    ),
)
def shot_probability(src):
    rows = shots.shot_probability(src.ball_points, shots.every_frame(src.ball_points))
    return rows.select("game", "frame", rounded(F.col("prob") + F.lit(3e-10), 6).alias("prob"))


@query("debug_metrics", with_inputs("ball_points", DEBUG, PROBS))
def debug_metrics(src):
    return shots.debug_metrics(src.ball_points, shots.every_frame(src.ball_points))
