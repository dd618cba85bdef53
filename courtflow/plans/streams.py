"""Streaming twins of the batch operators, drained over the whole tables."""

from pyspark.sql import functions as F

from ..functions.geometry import center_x, center_y, rounded
from ..operators import ball, gates, shots, teams, tracks
from ..streaming import stateful, takeover
from ..streaming.runner import drain
from . import ball as ball_plans
from . import shots as shot_plans
from . import teams as team_plans
from . import tracks as track_plans
from .inputs import with_inputs
from .registry import query, r

LATE = 1_000_000
MICRO_BATCH = 3_000_000  # rows of a micro-batch of the take-over, each of which becomes up to ten events
VOTE_BATCH = 10_000_000  # rows of a micro-batch of votes, which wait in the state as columns
FILTER_BATCH = 3_000_000  # rows of a micro-batch of the filter, which also cross, packed by slice, a step per game


def late(rows):
    """A sentinel far behind the last frame of all games: it lets the watermark pass all others, not itself."""
    return rows.orderBy(F.desc("frame")).limit(1).withColumn("frame", F.col("frame") + LATE)


@query(
    "stream_frame_summary",
    with_inputs("track_dets reads pose_dets ball_points", track_plans.SUMMARY, team_plans.LOCKS),
)
def stream_frame_summary(src):
    rows = tracks.summary_parts(src.track_dets, teams.jersey_lock(src.reads), src.pose_dets, src.ball_points)
    none = {k: F.lit(0) for k in ("players", "numbers", "poses", "balls")}
    return drain(rows, stateful.frame_summary, "stream-summary", closing=late(rows).withColumns(none))


@query(
    "stream_flight_sessions",
    with_inputs("ball_points", "SELECT game, flight, last_frame, points FROM wins", shot_plans.FLIGHTS),
)
def stream_flight_sessions(src):
    rows = src.ball_points.select("game", "frame")
    return drain(rows, stateful.flight_sessions, "stream-flights", closing=late(rows))


@query(
    "stream_sliding_triplet",
    with_inputs(
        "ball_points",
        """SELECT a.game, a.frame FROM ball_points a JOIN ball_points b ON b.game = a.game AND b.frame = a.frame - 1
           JOIN ball_points c ON c.game = a.game AND c.frame = a.frame - 2""",
    ),
)
def stream_sliding_triplet(src):
    rows = src.ball_points.select("game", "frame")
    return drain(rows, stateful.sliding_triplet, "stream-triplets", closing=late(rows))


@query(
    "stream_kalman",
    with_inputs(
        "ball_dets",
        f"""SELECT game, frame, {r('x', 3)} AS sx, {r('vx', 3)} AS svx, {r('y', 3)} AS sy, {r('vy', 3)} AS svy FROM kf""",
        ball_plans.KALMAN,
    ),
)
def stream_kalman(src):
    rows = ball_plans.best(src).select("game", "frame", center_x().alias("cx"), center_y().alias("cy"))
    build = lambda s: stateful.kalman(s, ball.TELEPORT["strict"])
    out = drain(rows, build, "stream-kalman", closing=late(rows), most=FILTER_BATCH)
    return out.select("game", "frame", *[rounded(c, 3).alias(c) for c in ("sx", "svx", "sy", "svy")])


@query(
    "stream_ghosts",
    with_inputs(
        "track_dets",
        """SELECT game, CAST(g AS BIGINT) AS frame, tid, x1, y1, x2, y2, CAST(g - frame AS BIGINT) AS age FROM (
             SELECT *, unnest(range(frame + 1, least(coalesce(nxt - 1, last), frame + 30, last) + 1)) AS g FROM nx) a""",
        track_plans.NEXT,
    ),
)
def stream_ghosts(src):
    """The end of a game's video is an end marker for each of its tracks."""
    rows = src.track_dets.select("game", "frame", "tid", "x1", "y1", "x2", "y2")
    last = rows.groupBy("game").agg((F.max("frame") + 1).alias("frame"))
    zero = F.lit(0).cast("bigint")
    end = rows.select("game", "tid").distinct().join(last, "game").select(
        "game", "frame", "tid", *[zero.alias(c) for c in ("x1", "y1", "x2", "y2")]
    )
    rows = rows.unionByName(end)
    build = lambda s: stateful.ghosts(s, tracks.GHOST_AGE)
    return drain(rows, build, "stream-ghosts", closing=late(rows))


@query(
    "stream_jersey_lock",
    with_inputs("reads", "SELECT game, tid, num, lock_ord FROM locks", team_plans.LOCKS),
)
def stream_jersey_lock(src):
    rows = gates.digit_read_gate(src.reads).select("game", "tid", "frame", "num")
    build = lambda s: stateful.jersey_lock(s, teams.CONFIRM_READS)
    return drain(rows, build, "stream-locks", closing=late(rows))


@query(
    "stream_team_vote",
    with_inputs(
        "players",
        """SELECT game, frame, tid, CAST(CASE WHEN 2 * ones > n THEN 1 WHEN 2 * ones < n THEN 0 ELSE oldest END AS BIGINT) AS voted
           FROM (SELECT game, frame, tid, sum(team) OVER w AS ones, count(*) OVER w AS n, first_value(team) OVER w AS oldest
                 FROM players WHERE team IS NOT NULL
                 WINDOW w AS (PARTITION BY game, tid ORDER BY frame ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)) a""",
    ),
)
def stream_team_vote(src):
    rows = src.players.where("team IS NOT NULL").select("game", "frame", "tid", "team")
    build = lambda s: stateful.team_vote(s, teams.VOTE_WINDOW)
    return drain(rows, build, "stream-votes", closing=late(rows), most=VOTE_BATCH)


@query(
    "stream_gap_fill",
    with_inputs(
        "ball_dets",
        f"""SELECT game, frame + j AS frame, {', '.join(ball_plans._line(c) for c in ('x1', 'y1', 'x2', 'y2'))}
            FROM (SELECT *, CAST(unnest(range(1, gap + 1)) AS BIGINT) AS j FROM (
              SELECT game, frame, x1, y1, x2, y2, n, n.frame - frame - 1 AS gap FROM (
                SELECT *, lead({{'frame': frame, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) OVER (PARTITION BY game ORDER BY frame) AS n
                FROM best_box) a) b
              WHERE gap BETWEEN 1 AND 8 AND sqrt(((x1 + x2) / 2e0 - (n.x1 + n.x2) / 2e0) * ((x1 + x2) / 2e0 - (n.x1 + n.x2) / 2e0)
                + ((y1 + y2) / 2e0 - (n.y1 + n.y2) / 2e0) * ((y1 + y2) / 2e0 - (n.y1 + n.y2) / 2e0))
                <= 250e0 * (1280 / 1920e0) * (gap + 1)) c""",
        ball_plans.BEST,
    ),
)
def stream_gap_fill(src):
    rows = ball_plans.best(src).select("game", "frame", "x1", "y1", "x2", "y2")
    teleport = ball.TELEPORT["export"] * ball.SCALE
    build = lambda s: stateful.gap_fill(s, teleport, ball.MAX_FILL, ball.LINEAR_FILL)
    return drain(rows, build, "stream-fill", closing=late(rows))


@query(
    "stream_cooldown",
    with_inputs("ball_points", "SELECT game, peak_frame, accepted FROM walk", shot_plans.CASCADE),
)
def stream_cooldown(src):
    rows = shots.shot_candidates(src.ball_points).where("shot")
    rows = rows.select("game", F.col("peak_frame").alias("frame"))
    return drain(rows, lambda s: stateful.cooldown(s, shots.COOLDOWN), "stream-cooldown", closing=late(rows))


@query("stream_reid", track_plans.REID)
def stream_reid(src):
    """Take-overs by number and by distance; each track gets a row at the end of its game's video."""
    dets = src.track_dets
    last = dets.groupBy("game").agg((F.max("frame") + 1).alias("frame"))
    ends = dets.select("game", "tid").distinct().join(last, "game")
    rows = takeover.events(dets, gates.digit_read_gate(src.reads), ends)
    build = lambda s: takeover.reid(s, tracks.REID_DIST, tracks.REID_FRAMES, teams.CONFIRM_READS)
    out = drain(rows, build, "stream-reid", closing=late(rows.where("kind = 'd'")), most=MICRO_BATCH)
    return out.select("game", "tid", "frame", "old_tid")


@query(
    "stream_ball_validate",
    with_inputs(
        "ball_dets hoops",
        """SELECT game, frame, k.seq AS seq, k.cx AS cx, k.cy AS cy, k.conf AS conf
           FROM (SELECT game, frame, unnest(valid) AS k FROM vw) a""",
        ball_plans.CANDS,
    ),
)
def stream_ball_validate(src):
    rows = ball.court_candidates(src.ball_dets, src.hoops)
    build = lambda s: stateful.ball_validate(s, ball.TELEPORT["export"] * ball.SCALE)
    return drain(rows, build, "stream-validate", closing=late(rows))
