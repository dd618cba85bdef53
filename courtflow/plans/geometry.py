"""Keys, gates and box projections."""

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.geometry import iou, rounded
from ..operators import gates, teams
from .inputs import with_inputs
from .registry import query, r
from .teams import LOCKS

BOX = "x1, y1, x2, y2"
DET = "game, frame, seq, " + BOX
STEM = r"regexp_replace(regexp_extract(replace(frame_path, chr(92), '/'), '([^/]+)$', 1), '(.)\.[^.]*$', '\1')"


@query(
    "frame_key",
    with_inputs(
        "label_rows",
        r"""SELECT frame_path, ord, split_part(p, '/', -2) AS folder, replace(CASE WHEN name LIKE '%.jpg'
              THEN left(name, length(name) - 4) ELSE name END, '_640x360', '') AS stem
            FROM (SELECT frame_path, ord, p, split_part(p, '/', -1) AS name FROM (
              SELECT frame_path, ord, replace(frame_path, chr(92), '/') AS p FROM (
                SELECT ord, CASE WHEN ord % 4 = 0 THEN replace(frame_path, '.jpg', '_640x360.jpg')
                  ELSE frame_path END AS frame_path FROM label_rows) a) b) c""",
    ),
)
def frame_key(src):
    resized = F.replace("frame_path", F.lit(".jpg"), F.lit("_640x360.jpg"))
    rows = src.label_rows.select(
        "ord",
        F.when(F.col("ord") % 4 == 0, resized).otherwise(F.col("frame_path")).alias("frame_path"),
    )
    return gates.frame_keys(rows)


NAMES = """names AS (SELECT frame_path AS name FROM label_rows UNION ALL SELECT file FROM polygons
  UNION ALL SELECT url FROM pages)"""


@query(
    "frame_numbers",
    with_inputs(
        "label_rows polygons",
        rf""", {NAMES}, st AS (SELECT name, {STEM.replace('frame_path', 'name')} AS stem FROM names)
        SELECT name, coalesce(try_cast(nullif(regexp_extract(stem, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT), -1) AS last_digits,
          CASE WHEN regexp_full_match(split_part(stem, '_', -1), '[+-]?[0-9]+')
            THEN coalesce(try_cast(split_part(stem, '_', -1) AS BIGINT), -1) ELSE -1 END AS last_token,
          coalesce(try_cast(nullif(regexp_extract(name, 'frame_([0-9]+)', 1), '') AS BIGINT), -1) AS frame_tag
        FROM st""",
    ).replace("\n, names AS", ",\nnames AS"),
)
def frame_numbers(src):
    names = src.label_rows.select(F.col("frame_path").alias("name"))
    names = names.unionAll(src.polygons.select("file")).unionAll(src.pages.select("url"))
    return names.select(
        "name",
        paths.last_digits(paths.file_stem("name")).alias("last_digits"),
        paths.last_token("name").alias("last_token"),
        paths.frame_tag("name").alias("frame_tag"),
    )


@query("cutoff_filter", with_inputs("label_rows", "SELECT ord, frame FROM label_rows WHERE frame <= 6000"))
def cutoff_filter(src):
    rows = gates.frame_keys(src.label_rows)
    return gates.cutoff_filter(rows, 6000).select("ord", "frame")


@query(
    "box_geometry",
    with_inputs(
        "player_dets",
        f"""SELECT {DET}, (x1 + x2) / 2e0 AS cx, (y1 + y2) / 2e0 AS cy,
              CAST(trunc((x1 + x2) / 2e0) AS BIGINT) AS icx, CAST(trunc((y1 + y2) / 2e0) AS BIGINT) AS icy,
              x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area,
              greatest(x2 - x1, y2 - y1) / CAST(greatest(least(x2 - x1, y2 - y1), 1) AS DOUBLE) AS aspect
            FROM player_dets""",
    ),
)
def box_geometry(src):
    return gates.box_geometry(src.player_dets.select("game", "frame", "seq", "x1", "y1", "x2", "y2"))


@query(
    "box_from_center",
    with_inputs(
        "ball_points",
        """SELECT game, frame, greatest(0, CAST(trunc(cx - 15) AS BIGINT)) AS x1,
             greatest(0, CAST(trunc(cy - 15) AS BIGINT)) AS y1,
             least(1280, CAST(trunc(cx + 15) AS BIGINT)) AS x2, least(720, CAST(trunc(cy + 15) AS BIGINT)) AS y2
           FROM ball_points""",
    ),
)
def box_from_center(src):
    return gates.box_from_center(src.ball_points).select("game", "frame", "x1", "y1", "x2", "y2")


@query(
    "box_iou",
    with_inputs(
        "ball_dets ball_shapes",
        f"""SELECT a.game, a.frame, a.seq, CASE WHEN u > 0 THEN {r('i / CAST(u AS DOUBLE)', 6)} ELSE 0e0 END AS iou
            FROM (SELECT *, (x2 - x1) * (y2 - y1) + (bx2 - bx1) * (by2 - by1) - i AS u FROM (
              SELECT a.*, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
                greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))
                * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i
              FROM ball_dets a JOIN ball_shapes b USING (game, frame)) q) a""",
    ),
)
def box_iou(src):
    rows = src.ball_dets.alias("a").join(src.ball_shapes.alias("b"), ["game", "frame"])
    return rows.select("game", "frame", "seq", rounded(iou(), 6).alias("iou"))


@query(
    "class_gate",
    with_inputs(
        "player_dets",
        """SELECT game, frame, seq, tid, CASE cls WHEN 1 THEN 'hoop' WHEN 2 THEN 'player' ELSE 'referee' END AS route
           FROM player_dets WHERE conf >= 0.3e0 AND (cls IN (1, 3) OR cls = 2 AND y2 - y1 >= 57.6e0)""",
    ),
)
def class_gate(src):
    return gates.class_gate(src.player_dets).select("game", "frame", "seq", "tid", "route")


@query(
    "court_roi_gate",
    with_inputs(
        "ball_dets",
        f"""SELECT {DET} FROM (SELECT *, (x1 + x2) / 2e0 AS fx, CAST(y2 AS DOUBLE) AS fy FROM ball_dets) a
            WHERE fy <= 633e0 AND fy >= 136e0
              AND (fx - 166e0) * 497e0 >= (633e0 - fy) * 154e0
              AND (1113e0 - fx) * 497e0 >= (633e0 - fy) * 153e0""",
    ),
)
def court_roi_gate(src):
    return gates.court_roi_gate(src.ball_dets).select("game", "frame", "seq", "x1", "y1", "x2", "y2")


@query(
    "court_column_gate",
    with_inputs(
        "ball_points",
        """SELECT game, frame, cx, cy FROM ball_points
           WHERE cy <= 633e0 + 497e0 * 0.05e0 AND CASE WHEN cy <= 136e0 THEN cx BETWEEN 256e0 AND 1024e0
             ELSE cx BETWEEN 320e0 + (cy - 136e0) / 497e0 * -154e0 - 64e0
                         AND 960e0 + (cy - 136e0) / 497e0 * 153e0 + 64e0 END""",
    ),
)
def court_column_gate(src):
    return gates.court_column_gate(src.ball_points).select("game", "frame", "cx", "cy")


@query(
    "ball_shape_gate",
    with_inputs(
        "ball_shapes",
        """SELECT game, frame, x1, y1, x2, y2 FROM ball_shapes WHERE conf >= 0.25e0
             AND (x2 - x1) * (y2 - y1) BETWEEN 50 AND 2500
             AND greatest(x2 - x1, y2 - y1) <= 1.8e0 * greatest(least(x2 - x1, y2 - y1), 1)""",
    ),
)
def ball_shape_gate(src):
    return gates.ball_shape_gate(src.ball_shapes).select("game", "frame", "x1", "y1", "x2", "y2")


@query(
    "frame_flag_gate",
    with_inputs(
        "ball_dets court_flags",
        f"""SELECT {DET} FROM ball_dets b WHERE EXISTS (SELECT 1 FROM court_flags f
              WHERE f.game = b.game AND f.frame = b.frame AND f.visible)""",
    ),
)
def frame_flag_gate(src):
    rows = gates.frame_flag_gate(src.ball_dets, src.court_flags)
    return rows.select("game", "frame", "seq", "x1", "y1", "x2", "y2")


@query(
    "scale_coords",
    with_inputs(
        "label_rows",
        """SELECT ord, CASE WHEN visibility > 0 AND x >= 0 AND y >= 0 THEN x * 640 / 1280e0 END AS mx,
             CASE WHEN visibility > 0 AND x >= 0 AND y >= 0 THEN y * 360 / 720e0 END AS my FROM label_rows""",
    ),
)
def scale_coords(src):
    return gates.scale_coords(src.label_rows).select("ord", "mx", "my")


@query(
    "polygon_centroid",
    with_inputs(
        "polygons",
        f"""SELECT file, {r('(c[2] + c[4] + c[6]) / 3e0 * 640e0', 1)} AS x,
              {r('(c[3] + c[5] + c[7]) / 3e0 * 360e0', 1)} AS y
            FROM (SELECT file, CAST(string_split(line, ' ') AS DOUBLE[]) AS c FROM polygons) a WHERE c[1] = 0""",
    ),
)
def polygon_centroid(src):
    rows = gates.polygon_centroid(src.polygons)
    return rows.select("file", rounded("x", 1).alias("x"), rounded("y", 1).alias("y"))


@query(
    "crop_box",
    with_inputs(
        "torso_points",
        """SELECT game, frame, seq, greatest(0, jx1) AS jersey_x1, greatest(0, y1) AS jersey_y1,
             jx2 AS jersey_x2, jy2 AS jersey_y2, b[1] AS color_x1, b[2] AS color_y1, b[3] AS color_x2, b[4] AS color_y2
           FROM (SELECT *, CASE WHEN use_pose THEN pose WHEN plain[3] > plain[1] + 4 AND plain[4] > plain[2] + 4
               THEN plain END AS b FROM (
             SELECT *, pose IS NOT NULL AND pose[3] > pose[1] + 8 AND pose[4] > pose[2] + 8 AS use_pose FROM (
               SELECT *, CASE WHEN shoulder_conf >= 0.3e0 AND hip_conf >= 0.3e0
                   THEN [greatest(0, l + px), greatest(0, t + py), least(1280, rt - px), least(720, hip - py)]
                 WHEN shoulder_conf >= 0.3e0
                   THEN [greatest(0, l + px), greatest(0, t), least(1280, rt - px),
                         least(720, t + CAST(trunc((y2 - y1) * 0.45e0) AS BIGINT))] END AS pose,
                 [greatest(0, jx1), greatest(0, y1 + CAST(trunc((y2 - y1) * 0.22e0) AS BIGINT)),
                  least(1280, jx2), least(720, y1 + CAST(trunc((y2 - y1) * 0.58e0) AS BIGINT))] AS plain
               FROM (SELECT *, CAST(trunc(least(lsx, rsx)) AS BIGINT) AS l, CAST(trunc(greatest(lsx, rsx)) AS BIGINT) AS rt,
                   CAST(trunc(least(lsy, rsy)) AS BIGINT) AS t, CAST(trunc((lhy + rhy) / 2e0) AS BIGINT) AS hip,
                   CAST(trunc(abs(lsx - rsx) * 0.1e0) AS BIGINT) AS px, CAST(trunc(abs(lsy + rsy) * 0.02e0) AS BIGINT) AS py,
                   x1 + CAST(trunc((x2 - x1) * 0.15e0) AS BIGINT) AS jx1, x2 - CAST(trunc((x2 - x1) * 0.15e0) AS BIGINT) AS jx2,
                   y1 + CAST(trunc((y2 - y1) * 0.55e0) AS BIGINT) AS jy2
                 FROM torso_points) a) b1) c) e""",
    ),
)
def crop_box(src):
    return gates.crop_box(src.torso_points)


@query(
    "digit_read_gate",
    with_inputs(
        "reads",
        """SELECT ord, game, tid, CAST(CAST(text AS BIGINT) AS VARCHAR) AS num FROM reads
           WHERE regexp_full_match(text, '[0-9]{1,2}') AND TRY_CAST(text AS BIGINT) BETWEEN 1 AND 99""",
    ),
)
def digit_read_gate(src):
    return gates.digit_read_gate(src.reads).select("ord", "game", "tid", "num")


@query(
    "display_label",
    with_inputs(
        "reads track_dets",
        """SELECT d.game, d.frame, d.seq, d.tid, '#' || coalesce(l.num, CAST(d.tid AS VARCHAR)) AS label
           FROM track_dets d LEFT JOIN locks l ON l.game = d.game AND l.tid = d.tid""",
        LOCKS,
    ),
)
def display_label(src):
    locks = teams.jersey_lock(src.reads)
    return gates.display_label(src.track_dets, locks).select("game", "frame", "seq", "tid", "label")


@query(
    "cadence_filter",
    with_inputs(
        "reads track_dets",
        """SELECT game, frame, has_unconfirmed FROM (
             SELECT d.game, d.frame, bool_or(l.lock_frame IS NULL OR l.lock_frame >= d.frame) AS has_unconfirmed
             FROM track_dets d LEFT JOIN locks l ON l.game = d.game AND l.tid = d.tid GROUP BY d.game, d.frame) a
           WHERE frame % CASE WHEN has_unconfirmed THEN 30 ELSE 90 END = 0""",
        LOCKS,
    ),
)
def cadence_filter(src):
    locks = teams.jersey_lock(src.reads)
    return gates.cadence_filter(src.track_dets, locks)
