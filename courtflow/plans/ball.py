"""The ball."""

from pyspark.sql import functions as F

from ..functions.geometry import rounded
from ..operators import ball
from ..session import staged
from .inputs import with_inputs
from .registry import query, r

BEST = [
    (
        "best_box",
        """SELECT * FROM ball_dets
           QUALIFY row_number() OVER (PARTITION BY game, frame ORDER BY conf DESC, seq) = 1""",
    ),
    ("best_mid", "SELECT *, (x1 + x2) / 2e0 AS cx, (y1 + y2) / 2e0 AS cy FROM best_box"),
]


def dist(a, b):
    return f"sqrt(({a}x-{b}x)*({a}x-{b}x) + ({a}y-{b}y)*({a}y-{b}y))"


def _spike_pass(run, base, out):
    """One removal pass in SQL over neighbours p (before), c1..c_run (the run), n (after)."""
    ahead = 7 if run == 1 else 7 + run
    lead = "".join(
        f", lead(frame, {k}) OVER w AS f{k}, lead(cx, {k}) OVER w AS c{k}x, lead(cy, {k}) OVER w AS c{k}y"
        for k in range(1, run)
    )
    chain = "".join(
        f" AND f{k} = frame + {k} AND {dist('c%d' % (k - 1), 'c%d' % k)} <= 50e0" for k in range(1, run)
    )
    end = f"c{run - 1}"
    hit = (
        f"frame - pf <= 7 AND nf - frame <= {ahead}{chain}"
        f" AND greatest({dist('c0', 'p')}, {dist(end, 'n')}) > {dist('p', 'n')} * 3 + 20"
        f" AND {dist('c0', 'p')} > 30 AND {dist(end, 'n')} > 30"
    )
    return [
        (
            f"{out}_s",
            f"""SELECT game, frame FROM (SELECT game, frame, cx AS c0x, cy AS c0y, lag(frame) OVER w AS pf,
                  lag(cx) OVER w AS px, lag(cy) OVER w AS py, lead(frame, {run}) OVER w AS nf,
                  lead(cx, {run}) OVER w AS nx, lead(cy, {run}) OVER w AS ny{lead}
                FROM {base} WINDOW w AS (PARTITION BY game ORDER BY frame)) a WHERE {hit}""",
        ),
        (
            out,
            f"""SELECT b.* FROM {base} b WHERE NOT EXISTS (SELECT 1 FROM {out}_s s WHERE s.game = b.game
                  AND b.frame BETWEEN s.frame AND s.frame + {run - 1})""",
        ),
    ]


SPIKES = BEST + _spike_pass(1, "best_mid", "sp1") + _spike_pass(2, "sp1", "sp2") + _spike_pass(3, "sp2", "sp3")

KALMAN = BEST + [
    ("hits", "SELECT game, frame, cx, cy, row_number() OVER (PARTITION BY game ORDER BY frame) AS rn FROM best_mid"),
    (
        "kf",
        """SELECT game, frame, rn, cx AS x, 0e0 AS vx, cy AS y, 0e0 AS vy, 100e0 AS a, 0e0 AS b, 100e0 AS c
           FROM hits WHERE rn = 1
           UNION ALL
           SELECT game, frame, rn, CASE WHEN reset THEN cx ELSE x + a / (a + 15e0) * (cx - x) END,
             CASE WHEN reset THEN 0e0 ELSE vx + b / (a + 15e0) * (cx - x) END,
             CASE WHEN reset THEN cy ELSE y + a / (a + 15e0) * (cy - y) END,
             CASE WHEN reset THEN 0e0 ELSE vy + b / (a + 15e0) * (cy - y) END,
             CASE WHEN reset THEN 100e0 ELSE (1 - a / (a + 15e0)) * a END,
             CASE WHEN reset THEN 0e0 ELSE (1 - a / (a + 15e0)) * b END,
             CASE WHEN reset THEN 100e0 ELSE c - b / (a + 15e0) * b END
           FROM (SELECT h.game, h.frame, h.rn, h.cx, h.cy, k.x + g * k.vx AS x, k.vx, k.y + g * k.vy AS y, k.vy,
                   k.a + 2 * g * k.b + g * g * k.c + 0.5e0 * (g * (g - 1) * (g - 2) / 3e0 + g * (g - 1) / 2e0 + g) AS a,
                   k.b + g * k.c + 0.5e0 * g * (g - 1) / 2e0 AS b, k.c + 0.5e0 * g AS c,
                   g <= 5 AND sqrt((h.cx - k.x - (g - 1) * k.vx) * (h.cx - k.x - (g - 1) * k.vx)
                     + (h.cy - k.y - (g - 1) * k.vy) * (h.cy - k.y - (g - 1) * k.vy)) > 50 AS reset
                 FROM kf k JOIN (SELECT *, frame - lag(frame) OVER (PARTITION BY game ORDER BY frame) AS g FROM hits) h
                   ON h.game = k.game AND h.rn = k.rn + 1) s""",
    ),
]

CANDS = [
    (
        "cand",
        """SELECT * FROM (SELECT game, frame, seq, conf, (x1 + x2) / 2e0 AS cx, (y1 + y2) / 2e0 AS cy,
               (x2 - x1) * (y2 - y1) AS area FROM ball_dets) a
           WHERE cy <= 633e0 + 497e0 * 0.05e0 AND CASE WHEN cy <= 136e0 THEN cx BETWEEN 256e0 AND 1024e0
             ELSE cx BETWEEN 320e0 + (cy - 136e0) / 497e0 * -154e0 - 64e0
                         AND 960e0 + (cy - 136e0) / 497e0 * 153e0 + 64e0 END""",
    ),
    (
        "cand_hoop",
        """SELECT c.*, CAST(h.y1 AS DOUBLE) AS top, (h.x1 + h.x2) / 2e0 AS hx FROM cand c
           LEFT JOIN hoops h ON h.game = c.game AND h.frame = c.frame
             AND abs(c.cx - (h.x1 + h.x2) / 2e0) < 102.4e0 AND abs(c.cy - (h.y1 + h.y2) / 2e0) < 102.4e0
           QUALIFY row_number() OVER (PARTITION BY c.game, c.frame, c.seq ORDER BY h.idx) = 1""",
    ),
    (
        "per_frame",
        """SELECT game, frame, row_number() OVER (PARTITION BY game ORDER BY frame) AS rn,
             list({'seq': seq, 'cx': cx, 'cy': cy, 'area': area, 'conf': conf, 'top': top, 'hx': hx} ORDER BY seq) AS c
           FROM cand_hoop GROUP BY game, frame""",
    ),
    (
        "vw",
        """SELECT game, frame, rn, c AS valid, list_filter(c, lambda k: k.area = list_max(list_transform(c, lambda q: q.area)))[1] AS best,
             CAST(NULL AS DOUBLE) AS lx, CAST(NULL AS DOUBLE) AS ly, CAST(NULL AS BIGINT) AS lf, CAST(NULL AS BIGINT) AS hf,
             CAST(NULL AS DOUBLE) AS ht, CAST(NULL AS DOUBLE) AS hx
           FROM per_frame WHERE rn = 1
           UNION ALL
           SELECT game, frame, rn, v, list_filter(v, lambda k: k.area = list_max(list_transform(v, lambda q: q.area)))[1],
             lx, ly, lf, hf, ht, hx
           FROM (SELECT game, frame, rn, lx, ly, lf, hf, ht, hx, list_filter(c, lambda k:
                 NOT coalesce(frame - lf <= 10 AND sqrt((k.cx - lx) * (k.cx - lx) + (k.cy - ly) * (k.cy - ly))
                     > 250e0 * (1280 / 1920e0) * (frame - lf), false)
                 AND NOT coalesce(frame - hf <= 30 AND k.cy < ht - 720 * 0.03e0
                     AND CASE WHEN hx < 640e0 THEN k.cx < hx ELSE k.cx > hx END, false)) AS v
             FROM (SELECT p.game, p.frame, p.rn, p.c,
                     CASE WHEN w.best IS NULL THEN w.lx ELSE w.best.cx END AS lx,
                     CASE WHEN w.best IS NULL THEN w.ly ELSE w.best.cy END AS ly,
                     CASE WHEN w.best IS NULL THEN w.lf ELSE w.frame END AS lf,
                     CASE WHEN w.best.top IS NULL THEN w.hf ELSE w.frame END AS hf,
                     CASE WHEN w.best.top IS NULL THEN w.ht ELSE w.best.top END AS ht,
                     CASE WHEN w.best.top IS NULL THEN w.hx ELSE w.best.hx END AS hx
                   FROM vw w JOIN per_frame p ON p.game = w.game AND p.rn = w.rn + 1) a) b""",
    ),
]


@query(
    "best_detection",
    with_inputs("ball_dets", "SELECT game, frame, seq, conf, x1, y1, x2, y2 FROM best_box", BEST),
)
def best_detection(src):
    return ball.best_detection(src.ball_dets)


def best(src):
    return ball.best_detection(src.ball_dets)


@query(
    "neighbor_asof",
    with_inputs(
        "ball_points",
        """SELECT game, frame, max(before) AS before, min(after) AS after FROM (
             SELECT b.game, b.frame, CASE WHEN o.frame < b.frame THEN o.frame END AS before,
               CASE WHEN o.frame > b.frame THEN o.frame END AS after
             FROM ball_points b JOIN ball_points o ON o.game = b.game AND o.frame BETWEEN b.frame - 7 AND b.frame + 7) a
           GROUP BY game, frame""",
    ),
)
def neighbor_asof(src):
    return ball.neighbor_asof(src.ball_points)


@query(
    "near_hoop_asof",
    with_inputs(
        "ball_points hoops",
        """SELECT b.game, b.frame, n.frame AS hoop_frame, n.x1, n.y1, n.x2, n.y2 FROM ball_points b
           JOIN near n ON n.game = b.game AND n.frame BETWEEN b.frame - 30 AND b.frame - 1
           QUALIFY row_number() OVER (PARTITION BY b.game, b.frame ORDER BY n.frame DESC) = 1""",
        [
            (
                "near",
                """SELECT h.* FROM ball_points p JOIN hoops h USING (game, frame)
                   WHERE abs(p.cx - (h.x1 + h.x2) / 2e0) < 102.4e0 AND abs(p.cy - (h.y1 + h.y2) / 2e0) < 102.4e0
                   QUALIFY row_number() OVER (PARTITION BY h.game, h.frame ORDER BY h.idx) = 1""",
            )
        ],
    ),
)
def near_hoop_asof(src):
    return ball.near_hoop_asof(src.ball_points.select("game", "frame", "cx", "cy"), src.hoops)


NEAR_KP = [
    (
        "nkp",
        f"""SELECT game, frame, tid, kp, gap, dx, dy FROM (
              SELECT k.game, k.frame, k.tid, k.kp, b.cx - k.x AS dx, b.cy - k.y AS dy,
                sqrt((b.cx - k.x) * (b.cx - k.x) + (b.cy - k.y) * (b.cy - k.y)) AS gap
              FROM ball_points b JOIN keypoints k USING (game, frame)
              WHERE k.conf >= 0.3e0 AND NOT (k.x = 0 AND k.y = 0)) a
            WHERE gap < 80e0 * (1280 / 1920e0)
            QUALIFY row_number() OVER (PARTITION BY game, frame, tid ORDER BY gap, kp) = 1""",
    ),
]


@query(
    "nearest_keypoint",
    with_inputs(
        "ball_points keypoints",
        f"SELECT game, frame, tid, kp, {r('gap', 6)} AS gap FROM nkp",
        NEAR_KP,
    ),
)
def nearest_keypoint(src):
    rows = ball.nearest_keypoint(src.ball_points, src.keypoints)
    return rows.select("game", "frame", "tid", "kp", rounded("gap", 6).alias("gap"))


@query(
    "head_lock",
    with_inputs(
        "ball_points keypoints",
        f"""SELECT game, frame, tid, {r('sqrt(sx * sx + sy * sy)', 4)} AS spread, sqrt(sx * sx + sy * sy) < 4e0 AS locked
            FROM (SELECT n.*, call - lag(call, 19) OVER w AS back, stddev_pop(dx) OVER l AS sx, stddev_pop(dy) OVER l AS sy
                  FROM nkp n JOIN (SELECT game, frame, row_number() OVER (PARTITION BY game ORDER BY frame) AS call
                    FROM ball_points) c USING (game, frame)
                  WINDOW w AS (PARTITION BY game, tid ORDER BY call),
                    l AS (PARTITION BY game, tid ORDER BY call ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) a WHERE back = 19""",
        NEAR_KP,
    ),
)
def head_lock(src):
    rows = ball.head_lock(src.ball_points, src.keypoints)
    return rows.withColumn("spread", rounded("spread", 4))


@query(
    "temporal_support",
    with_inputs(
        "ball_dets",
        f"""SELECT a.game, a.frame, CAST(count(*) AS BIGINT) AS support FROM best_mid a JOIN best_mid b ON a.game = b.game
              AND b.frame BETWEEN a.frame - 4 AND a.frame WHERE {dist('a.c', 'b.c')} <= 80e0 * (1280 / 1920e0)
            GROUP BY a.game, a.frame""",
        BEST,
    ),
)
def temporal_support(src):
    return ball.temporal_support(best(src))


@query(
    "ball_validate",
    with_inputs(
        "ball_dets hoops",
        """SELECT game, frame, k.seq AS seq, k.cx AS cx, k.cy AS cy, k.conf AS conf
           FROM (SELECT game, frame, unnest(valid) AS k FROM vw) a""",
        CANDS,
    ),
)
def ball_validate(src):
    return ball.ball_validate(src.ball_dets, src.hoops)


@query("ball_validate_strict")
def ball_validate_strict(src):
    heads = ball.nearest_keypoint(src.ball_points, src.keypoints)
    return ball.ball_validate(src.ball_dets, src.hoops, "strict", heads, posed=src.keypoints)


@query(
    "spike_reject",
    with_inputs("ball_dets", "SELECT game, frame, seq, conf, x1, y1, x2, y2 FROM sp3", SPIKES),
)
def spike_reject(src):
    return ball.spike_reject(best(src))


@query("spike_reject_in_order")
def spike_reject_in_order(src):
    return ball.spike_reject_in_order(best(src))


FILL_T = "(j / CAST(gap + 1 AS DOUBLE))"


def _line(c):
    lift = ""
    if c[0] == "y":
        lift = f" + CASE WHEN gap > 3 THEN -least(abs((n.x1 + n.x2) / 2e0 - (x1 + x2) / 2e0) * 0.3e0, gap * 15e0) * 4e0 * {FILL_T} * (1e0 - {FILL_T}) ELSE 0e0 END"
    return f"CAST(trunc({c} + (n.{c} - {c}) * {FILL_T}{lift}) AS BIGINT) AS {c}"


@query(
    "gap_fill",
    with_inputs(
        "ball_dets",
        f"""SELECT game, frame, x1, y1, x2, y2, 'SEEN' AS provenance FROM sp3
            UNION ALL SELECT game, frame + j, {', '.join(_line(c) for c in ('x1', 'y1', 'x2', 'y2'))}, 'INTERP'
            FROM (SELECT *, CAST(unnest(range(1, gap + 1)) AS BIGINT) AS j FROM (
              SELECT game, frame, x1, y1, x2, y2, n, n.frame - frame - 1 AS gap FROM (
                SELECT *, lead({{'frame': frame, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) OVER (PARTITION BY game ORDER BY frame) AS n
                FROM sp3) a) b
              WHERE gap BETWEEN 1 AND 8 AND sqrt(((x1 + x2) / 2e0 - (n.x1 + n.x2) / 2e0) * ((x1 + x2) / 2e0 - (n.x1 + n.x2) / 2e0)
                + ((y1 + y2) / 2e0 - (n.y1 + n.y2) / 2e0) * ((y1 + y2) / 2e0 - (n.y1 + n.y2) / 2e0))
                <= 250e0 * (1280 / 1920e0) * (gap + 1)) c""",
        SPIKES,
    ),
)
def gap_fill(src):
    return ball.gap_fill(ball.spike_reject(best(src)))


@query(
    "kalman_smooth",
    with_inputs(
        "ball_dets",
        f"""SELECT game, frame, {r('x', 3)} AS sx, {r('vx', 3)} AS svx, {r('y', 3)} AS sy, {r('vy', 3)} AS svy FROM kf""",
        KALMAN,
    ),
)
def kalman_smooth(src):
    rows = ball.kalman_smooth(best(src))
    return rows.select("game", "frame", *[rounded(c, 3).alias(c) for c in ("sx", "svx", "sy", "svy")])


@query(
    "box_recenter",
    with_inputs(
        "ball_dets",
        """SELECT game, frame, CAST(trunc(x - (x2 - x1) / 2e0) AS BIGINT) AS x1, CAST(trunc(y - (y2 - y1) / 2e0) AS BIGINT) AS y1,
             CAST(trunc(x + (x2 - x1) / 2e0) AS BIGINT) AS x2, CAST(trunc(y + (y2 - y1) / 2e0) AS BIGINT) AS y2
           FROM kf JOIN best_box USING (game, frame)""",
        KALMAN,
    ),
)
def box_recenter(src):
    boxes = staged(best(src), "best-boxes")
    return ball.box_recenter(boxes, ball.kalman_smooth(boxes))


@query(
    "velocity_history",
    with_inputs(
        "ball_dets",
        f"""SELECT m.game, m.frame, CAST(count(v.frame) AS BIGINT) AS n, {r('avg(v.vx)', 6)} AS mean_vx, {r('avg(v.vy)', 6)} AS mean_vy
            FROM vh m LEFT JOIN va v ON v.game = m.game AND v.island = m.island AND v.k > m.k - 5 AND v.k <= m.k
            GROUP BY m.game, m.frame""",
        BEST
        + [
            (
                "vg",
                """SELECT game, frame, CASE WHEN gap <= 3 THEN (cx - px) / gap END AS vx, CASE WHEN gap <= 3 THEN (cy - py) / gap END AS vy,
                     CASE WHEN gap IS NULL OR gap > 10 THEN frame END AS fresh
                   FROM (SELECT *, frame - lag(frame) OVER w AS gap, lag(cx) OVER w AS px, lag(cy) OVER w AS py
                         FROM best_mid WINDOW w AS (PARTITION BY game ORDER BY frame)) a""",
            ),
            (
                "vh",
                """SELECT *, count(vx) OVER (PARTITION BY game, island ORDER BY frame) AS k FROM (
                     SELECT *, max(fresh) OVER (PARTITION BY game ORDER BY frame) AS island FROM vg) a""",
            ),
            ("va", "SELECT * FROM vh WHERE vx IS NOT NULL"),
        ],
    ),
)
def velocity_history(src):
    rows = ball.velocity_history(best(src))
    return rows.withColumns({c: rounded(c, 6) for c in ("mean_vx", "mean_vy")})


@query(
    "source_fallback",
    with_inputs(
        "ball_points second_dets",
        """SELECT game, frame, cx, cy, conf, 'primary' AS source FROM prim
           UNION ALL SELECT s.game, s.frame, s.cx, s.cy, s.conf, 'secondary' FROM (
             SELECT s.*, (SELECT max(frame) FROM prim p WHERE p.game = s.game AND p.frame < s.frame AND p.frame >= s.frame - 60) AS pf
             FROM second_dets s WHERE NOT EXISTS (SELECT 1 FROM prim p WHERE p.game = s.game AND p.frame = s.frame)) s
           LEFT JOIN prim p ON p.game = s.game AND p.frame = s.pf
           WHERE CASE WHEN pf IS NULL THEN s.conf >= 0.2e0 AND s.frame % 5 = 0
             ELSE abs(s.cx - p.cx) <= 400 AND abs(s.cy - p.cy) <= 400 END""",
        [("prim", "SELECT game, frame, cx, cy, conf FROM ball_points WHERE frame % 200 < 60 AND conf >= 0.6e0")],
    ),
)
def source_fallback(src):
    primary = src.ball_points.where("frame % 200 < 60 AND conf >= 0.6e0")
    return ball.source_fallback(primary, src.second_dets)
