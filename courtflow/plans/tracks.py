"""Player tracks."""

from pyspark.sql import functions as F

from ..functions.geometry import rounded
from ..operators import teams, tracks
from ..session import staged
from .inputs import with_inputs
from .registry import query, r
from .teams import LOCKS

IOU = """CASE WHEN u > 0 THEN i / CAST(u AS DOUBLE) ELSE 0e0 END"""


def iou_of(a, b):
    i = (
        f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
        f" * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    )
    u = f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1) - {i})"
    return f"(CASE WHEN {u} > 0 THEN {i} / CAST({u} AS DOUBLE) ELSE 0e0 END)"


PAIRS = [
    (
        "pairs",
        f"""SELECT DISTINCT a.game, a.frame, least(a.tid, b.tid) AS tid_a, greatest(a.tid, b.tid) AS tid_b
            FROM track_dets a JOIN track_dets b ON a.game = b.game AND a.frame = b.frame AND a.seq < b.seq
            WHERE {iou_of('a', 'b')} >= 0.4e0""",
    ),
]
SPEED = [
    (
        "spd",
        """SELECT game, tid, frame, cx, cy, CASE WHEN frame > f0 THEN (cx - x0) / (frame - f0) ELSE 0e0 END AS vx,
             CASE WHEN frame > f0 THEN (cy - y0) / (frame - f0) ELSE 0e0 END AS vy
           FROM (SELECT *, first_value(frame) OVER w AS f0, first_value(cx) OVER w AS x0, first_value(cy) OVER w AS y0
                 FROM (SELECT *, (x1 + x2) / 2e0 AS cx, (y1 + y2) / 2e0 AS cy FROM track_dets) a
                 WINDOW w AS (PARTITION BY game, tid ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) b""",
    ),
]
EPISODES = PAIRS + SPEED + [
    (
        "runs",
        """SELECT game, tid_a, tid_b, min(frame) AS "start", max(frame) AS "end" FROM (
             SELECT *, frame - row_number() OVER (PARTITION BY game, tid_a, tid_b ORDER BY frame) AS island FROM pairs) a
           GROUP BY game, tid_a, tid_b, island""",
    ),
    (
        "episodes",
        """SELECT r.*, a.vx AS vx_a, a.vy AS vy_a, b.vx AS vx_b, b.vy AS vy_b FROM runs r
           LEFT JOIN spd a ON a.game = r.game AND a.tid = r.tid_a AND a.frame = r."start"
           LEFT JOIN spd b ON b.game = r.game AND b.tid = r.tid_b AND b.frame = r."start" """,
    ),
]
NEXT = [
    (
        "nx",
        """SELECT d.*, lead(frame) OVER (PARTITION BY game, tid ORDER BY frame) AS nxt, last
           FROM track_dets d JOIN (SELECT game, max(frame) AS last FROM track_dets GROUP BY game) USING (game)""",
    ),
]
LOST = NEXT + [
    (
        "lost",
        """SELECT game, tid, frame + 1 AS lost_frame, (x1 + x2) / 2e0 AS cx, (y1 + y2) / 2e0 AS cy, frame + 601 AS expires
           FROM nx WHERE (nxt IS NULL OR nxt > frame + 1) AND frame < last""",
    ),
]

OPEN_LOST = [
    (
        "open_lost",
        """SELECT *, least(expires, lead(lost_frame) OVER (PARTITION BY game, tid ORDER BY lost_frame)) AS until
           FROM lost""",
    ),
]

SUMMARY = """SELECT game, frame, CAST(coalesce(players, 0) AS BIGINT) AS players, CAST(coalesce(numbers, 0) AS BIGINT) AS numbers,
             CAST(coalesce(poses, 0) AS BIGINT) AS poses, coalesce(ball, false) AS ball, frame % 30 = 0 AS progress
           FROM (SELECT d.game, d.frame, count(*) AS players, count(*) FILTER (lock_frame < d.frame) AS numbers
                 FROM track_dets d LEFT JOIN locks l ON l.game = d.game AND l.tid = d.tid GROUP BY 1, 2) a
           FULL JOIN (SELECT game, frame, count(*) AS poses FROM pose_dets GROUP BY 1, 2) b USING (game, frame)
           FULL JOIN (SELECT game, frame, true AS ball FROM ball_points) c USING (game, frame)"""


@query(
    "pair_overlap",
    with_inputs(
        "player_dets",
        f"""SELECT a.game, a.frame, a.seq AS seq_a, b.seq AS seq_b, a.tid AS tid_a, b.tid AS tid_b,
              {r(iou_of('a', 'b'), 6)} AS iou
            FROM player_dets a JOIN player_dets b ON a.game = b.game AND a.frame = b.frame AND a.seq < b.seq
            WHERE a.conf >= 0.3e0 AND b.conf >= 0.3e0 AND {iou_of('a', 'b')} >= 0.4e0""",
    ),
)
def pair_overlap(src):
    rows = tracks.pair_overlap(src.player_dets.where("conf >= 0.3e0"))
    return rows.withColumn("iou", rounded("iou", 6))


@query(
    "track_velocity",
    with_inputs("track_dets", f"SELECT game, tid, frame, {r('vx', 6)} AS vx, {r('vy', 6)} AS vy FROM spd", SPEED),
)
def track_velocity(src):
    return tracks.track_velocity(src.track_dets).select(
        "game", "tid", "frame", rounded("vx", 6).alias("vx"), rounded("vy", 6).alias("vy")
    )


@query(
    "overlap_episodes",
    with_inputs(
        "track_dets",
        f"""SELECT game, tid_a, tid_b, "start", "end", {r('vx_a', 6)} AS vx_a, {r('vy_a', 6)} AS vy_a,
              {r('vx_b', 6)} AS vx_b, {r('vy_b', 6)} AS vy_b FROM episodes""",
        EPISODES,
    ),
)
def overlap_episodes(src):
    rows = tracks.overlap_episodes(src.track_dets)
    return rows.withColumns({v: rounded(v, 6) for v in ("vx_a", "vy_a", "vx_b", "vy_b")})


@query(
    "ended_pairs",
    with_inputs(
        "track_dets",
        "SELECT game, frame + 1 AS frame, tid_a, tid_b FROM pairs EXCEPT SELECT game, frame, tid_a, tid_b FROM pairs",
        PAIRS,
    ),
)
def ended_pairs(src):
    return tracks.ended_pairs(src.track_dets)


@query(
    "exit_match",
    with_inputs(
        "track_dets",
        """SELECT game, frame, tid, arg_min(new_tid, seq) AS new_tid FROM (
             SELECT m.game, m."end" + 1 AS frame, m.tid, d.tid AS new_tid, d.seq FROM mem m
             JOIN spd p ON p.game = m.game AND p.tid = m.tid AND p.frame = m."end"
             JOIN track_dets d ON d.game = m.game AND d.frame = m."end" + 1
             WHERE NOT EXISTS (SELECT 1 FROM track_dets x WHERE x.game = m.game AND x.tid = m.tid AND x.frame = m."end" + 1)
               AND sqrt(((d.x1 + d.x2) / 2e0 - p.cx - m.vx) * ((d.x1 + d.x2) / 2e0 - p.cx - m.vx)
                 + ((d.y1 + d.y2) / 2e0 - p.cy - m.vy) * ((d.y1 + d.y2) / 2e0 - p.cy - m.vy)) < 80) a
           GROUP BY game, frame, tid
           QUALIFY row_number() OVER (PARTITION BY game, frame, arg_min(new_tid, seq) ORDER BY tid) = 1""",
        EPISODES
        + [
            (
                "mem",
                """SELECT * FROM (SELECT game, tid_a AS tid, "start", "end", vx_a AS vx, vy_a AS vy FROM episodes
                     UNION ALL SELECT game, tid_b, "start", "end", vx_b, vy_b FROM episodes) u
                   QUALIFY row_number() OVER (PARTITION BY game, tid, "end" ORDER BY "start" DESC, vx DESC, vy DESC) = 1""",
            )
        ],
    ),
)
def exit_match(src):
    return tracks.exit_match(src.track_dets, tracks.overlap_episodes(src.track_dets))


@query(
    "ghost_tracks",
    with_inputs(
        "track_dets",
        """SELECT game, CAST(g AS BIGINT) AS frame, tid, x1, y1, x2, y2, CAST(g - frame AS BIGINT) AS age FROM (
             SELECT *, unnest(range(frame + 1, least(coalesce(nxt - 1, last), frame + 30, last) + 1)) AS g FROM nx) a""",
        NEXT,
    ),
)
def ghost_tracks(src):
    return tracks.ghost_tracks(src.track_dets)


@query("lost_registry", with_inputs("track_dets", "SELECT * FROM lost", LOST))
def lost_registry(src):
    return tracks.lost_registry(src.track_dets)


@query(
    "reid_candidates",
    with_inputs(
        "track_dets",
        f"""SELECT game, tid, old_tid, lost_frame, frame, {r('gap', 6)} AS gap FROM (
              SELECT d.game, d.tid, l.tid AS old_tid, l.lost_frame, d.frame,
                sqrt((d.cx - l.cx) * (d.cx - l.cx) + (d.cy - l.cy) * (d.cy - l.cy)) AS gap
              FROM spd d JOIN open_lost l ON d.game = l.game AND d.frame > l.lost_frame AND d.frame <= l.until
              WHERE sqrt((d.cx - l.cx) * (d.cx - l.cx) + (d.cy - l.cy) * (d.cy - l.cy)) < 300) a
            QUALIFY row_number() OVER (PARTITION BY game, tid, old_tid, lost_frame ORDER BY frame) = 1""",
        SPEED + LOST + OPEN_LOST,
    ),
)
def reid_candidates(src):
    dets = src.track_dets
    rows = tracks.reid_candidates(dets, tracks.lost_registry(dets))
    return rows.select("game", "tid", "old_tid", "lost_frame", "frame", rounded("gap", 6).alias("gap"))


#: contacts in their order; a round accepts those that come first for both their track and their entry
REID = with_inputs(
    "track_dets reads",
    """SELECT game, tid, frame, old_tid FROM rounds WHERE took""",
    SPEED
    + LOST
    + OPEN_LOST
    + LOCKS
    + [
        (
            "contacts",
            """SELECT game, tid, old_tid, lost_frame, frame, gap, row_number() OVER (PARTITION BY game
                 ORDER BY frame, seq, tid, gap, lost_frame, old_tid) AS rk FROM (
               SELECT * FROM (
                 SELECT d.game, d.tid, l.tid AS old_tid, l.lost_frame, d.frame, t.seq,
                   sqrt((d.cx - l.cx) * (d.cx - l.cx) + (d.cy - l.cy) * (d.cy - l.cy)) AS gap
                 FROM spd d JOIN track_dets t ON t.game = d.game AND t.tid = d.tid AND t.frame = d.frame
                 JOIN open_lost l ON d.game = l.game AND d.frame > l.lost_frame AND d.frame <= l.until
                 WHERE sqrt((d.cx - l.cx) * (d.cx - l.cx) + (d.cy - l.cy) * (d.cy - l.cy)) < 300
                 UNION ALL
                 SELECT d.game, d.tid, l.tid, l.lost_frame, d.frame, d.seq, -1e0
                 FROM track_dets d JOIN locks a ON a.game = d.game AND a.tid = d.tid AND d.frame > a.lock_frame
                 JOIN open_lost l ON d.game = l.game AND d.frame > l.lost_frame AND d.frame <= l.until
                 JOIN locks b ON b.game = l.game AND b.tid = l.tid AND b.num = a.num AND d.frame > b.lock_frame) u
               QUALIFY row_number() OVER (PARTITION BY game, tid, old_tid, lost_frame ORDER BY frame, gap) = 1) c""",
        ),
        (
            "rounds",
            """SELECT game, tid, old_tid, lost_frame, frame, rk, false AS took FROM contacts
               UNION ALL
               SELECT game, tid, old_tid, lost_frame, frame, rk, mine AS took FROM (
                 SELECT *, bool_or(mine) OVER (PARTITION BY game, tid) OR bool_or(mine) OVER (PARTITION BY game, old_tid, lost_frame) AS hit
                 FROM (SELECT *, rk = min(rk) OVER (PARTITION BY game, tid)
                         AND rk = min(rk) OVER (PARTITION BY game, old_tid, lost_frame) AS mine
                       FROM rounds WHERE NOT took) a) b
               WHERE mine OR NOT hit""",
        ),
    ],
)


@query("reid_match", REID)
def reid_match(src):
    dets = src.track_dets
    matches = tracks.reid_match(dets, tracks.lost_registry(dets), teams.jersey_lock(src.reads))
    return matches.select("game", "tid", "frame", "old_tid")


@query("reid_applied")
def reid_applied(src):
    dets = src.track_dets
    matches = tracks.reid_match(dets, tracks.lost_registry(dets), teams.jersey_lock(src.reads))
    return tracks.apply_identities(dets, staged(matches, "matches")).select("game", "frame", "seq", "tid", "identity")


@query(
    "pose_player_match",
    with_inputs(
        "player_dets pose_dets",
        f"""SELECT game, frame, tid, pose, {r('iou', 6)} AS iou FROM (
              SELECT b.*, coalesce(ref, 0e0) AS ref FROM (
                SELECT p.game, p.frame, p.pose, d.tid, {iou_of('p', 'd')} AS iou FROM pose_dets p
                JOIN player_dets d ON d.game = p.game AND d.frame = p.frame AND d.cls = 2 AND d.conf >= 0.3e0
                WHERE {iou_of('p', 'd')} > 0.12e0
                QUALIFY row_number() OVER (PARTITION BY p.game, p.frame, p.pose ORDER BY iou DESC, d.seq) = 1) b
              LEFT JOIN (SELECT p.game, p.frame, p.pose, max({iou_of('p', 'd')}) AS ref FROM pose_dets p
                JOIN player_dets d ON d.game = p.game AND d.frame = p.frame AND d.cls = 3 AND d.conf >= 0.3e0
                GROUP BY 1, 2, 3) r USING (game, frame, pose)) c
            WHERE iou > ref QUALIFY row_number() OVER (PARTITION BY game, frame, tid ORDER BY pose DESC) = 1""",
    ),
)
def pose_player_match(src):
    sure = src.player_dets.where("conf >= 0.3e0")
    rows = tracks.pose_player_match(src.pose_dets, sure.where("cls = 2"), sure.where("cls = 3"))
    return rows.withColumn("iou", rounded("iou", 6))


@query(
    "frame_summary",
    with_inputs(
        "track_dets reads pose_dets ball_points",
        SUMMARY,
        LOCKS,
    ),
)
def frame_summary(src):
    return tracks.frame_summary(
        src.track_dets, teams.jersey_lock(src.reads), src.pose_dets, src.ball_points
    )
