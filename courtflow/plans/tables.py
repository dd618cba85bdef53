"""Sources, sinks and metrics."""

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.geometry import rounded
from ..operators import ball, gates, metrics, shots
from ..session import work_folder
from ..sources import labels as label_files
from ..sources import tracking
from . import labels as label_plans
from . import shots as shot_plans
from .inputs import with_inputs
from .registry import query, r

MID = "CAST(trunc((x1 + x2) / 2e0) AS BIGINT) AS cx, CAST(trunc((y1 + y2) / 2e0) AS BIGINT) AS cy"


FIRST = "SELECT * FROM ball_dets QUALIFY row_number() OVER (PARTITION BY game, frame ORDER BY conf DESC, seq) = 1"


def first_balls(src):
    return ball.best_detection(src.ball_dets)


@query(
    "src_tracking_json",
    with_inputs(
        "ball_dets hoops players",
        f"""SELECT 'ball' AS kind, game, frame, CAST(0 AS BIGINT) AS id, {MID}, x1, y1, x2, y2, CAST(NULL AS BIGINT) AS team
              FROM ({FIRST}) f
            UNION ALL SELECT 'hoop', game, frame, idx, {MID}, x1, y1, x2, y2, NULL FROM hoops
            UNION ALL SELECT 'player', game, frame, tid, {MID.replace('AS cx', '').replace('AS cy', '')},
              CAST(x1 AS BIGINT), CAST(y1 AS BIGINT), CAST(x2 AS BIGINT), CAST(y2 AS BIGINT), team FROM players""",
    ),
)
def src_tracking_json(src):
    path = work_folder(src.spark, "tracking-docs")
    tracking.write_documents(tracking.frame_records(first_balls(src), src.hoops, src.players), path)
    rows = tracking.read_objects(src.spark, path)
    return rows.withColumn("game", F.regexp_extract("video", r"(\d+)$", 1).cast("bigint")).drop("video")


BOXED = """{{{head}'center': [CAST(trunc((x1 + x2) / 2e0) AS BIGINT), CAST(trunc((y1 + y2) / 2e0) AS BIGINT)],
  'box': [CAST(x1 AS BIGINT), CAST(y1 AS BIGINT), CAST(x2 AS BIGINT), CAST(y2 AS BIGINT)]{tail}}}"""


@query(
    "sink_tracking_json",
    with_inputs(
        "ball_dets hoops players",
        """SELECT CAST(to_json({'game': game, 'frame': frame, 'ball': ball, 'hoops': coalesce(hs, []),
             'players': coalesce(ps, [])}) AS VARCHAR) AS line
           FROM b FULL JOIN h USING (game, frame) FULL JOIN p USING (game, frame)""",
        [
            ("b", f"SELECT game, frame, {BOXED.format(head='', tail='')} AS ball FROM ({FIRST}) f"),
            ("h", f"SELECT game, frame, list({BOXED.format(head='', tail='')} ORDER BY idx) AS hs FROM hoops GROUP BY game, frame"),
            (
                "p",
                f"""SELECT game, frame, list({BOXED.format(head="'tid': tid, ", tail=", 'team': team")} ORDER BY tid) AS ps
                    FROM players GROUP BY game, frame""",
            ),
        ],
    ),
)
def sink_tracking_json(src):
    path = work_folder(src.spark, "tracking-lines")
    tracking.write_frame_lines(tracking.frame_records(first_balls(src), src.hoops, src.players), path)
    return src.spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "src_label_csv",
    with_inputs("label_rows", "SELECT ord, frame_path, visibility, x, y FROM label_rows"),
)
def src_label_csv(src):
    """The written file carries stray coordinates on hidden rows, as hand-edited ones do."""
    path = work_folder(src.spark, "labels")
    stray = F.when(F.col("visibility") == 0, F.lit(7.0))
    rows = src.label_rows.withColumns(
        {"x": F.coalesce(stray, "x"), "y": F.coalesce(stray, "y"), "split": F.lit("train")}
    )
    label_files.write_labels(rows, path)
    return label_files.read_labels(src.spark, path).drop("split")


@query(
    "sink_label_csv",
    with_inputs(
        "label_rows",
        "SELECT split, ord, frame_path, visibility, x, y FROM split_rows",
        label_plans.SPLITS,
    ),
)
def sink_label_csv(src):
    path = work_folder(src.spark, "split-labels")
    label_files.write_labels(label_plans.split_rows(src), path)
    return label_files.read_labels(src.spark, path)


@query(
    "sink_disagreement_csv",
    with_inputs(
        "label_rows pred_rows",
        """SELECT split, category, ord, frame_path, label_x, label_y, pred_x, pred_y, pred_conf, distance_px
           FROM diff""",
        label_plans.AUDIT,
    ),
)
def sink_disagreement_csv(src):
    path = work_folder(src.spark, "disagreements")
    label_files.write_disagreements(label_plans.audit_rows(src), path)
    return label_files.read_disagreements(src.spark, path)


@query(
    "src_polygon_labels",
    with_inputs(
        "polygons",
        """SELECT file, line_no, CAST(c[1] AS BIGINT) AS cls, CAST(len(c) - 1 AS BIGINT) AS coords, c[2] AS first_x, c[7] AS last_y
           FROM (SELECT *, CAST(string_split(line, ' ') AS DOUBLE[]) AS c FROM polygons) a""",
    ),
)
def src_polygon_labels(src):
    path = work_folder(src.spark, "polygons")
    label_files.write_packed_polygons(src.polygons, path)
    rows = label_files.read_polygons(src.spark, path, packed=True)
    return rows.select(
        "file",
        "line_no",
        "cls",
        F.size("coords").cast("bigint").alias("coords"),
        F.element_at("coords", 1).alias("first_x"),
        F.element_at("coords", -1).alias("last_y"),
    )


@query(
    "src_review_listing",
    with_inputs(
        "review_keys",
        """SELECT ['false_negatives', 'false_positives', 'position_mismatch'][ord % 3 + 1] AS category, folder, stem
           FROM review_keys""",
    ),
)
def src_review_listing(src):
    path = work_folder(src.spark, "review-listing")
    kinds = F.array(*[F.lit(c) for c in ("false_negatives", "false_positives", "position_mismatch")])
    line = F.concat_ws("/", F.lit("review"), F.element_at(kinds, (F.col("ord") % 3 + 1).cast("int")), "folder", "stem")
    rows = src.review_keys
    rows.select(F.concat(line, F.lit(".jpg")).alias("value")).unionAll(
        rows.where(F.col("ord") % 50 == 1).select(F.concat(line, F.lit(".txt")))
    ).write.text(path)
    return label_files.read_review_listing(src.spark, path)


@query(
    "src_review_list",
    with_inputs("review_keys", "SELECT folder, stem FROM review_keys WHERE neither"),
)
def src_review_list(src):
    path = work_folder(src.spark, "review-list")
    rows = src.review_keys.where("neither")
    plain = F.concat_ws("/", "folder", "stem")
    back = F.concat(F.lit("  "), F.concat_ws("\\", "folder", F.concat("stem", F.lit(".png"))), F.lit(" "))
    lines = rows.select(F.when(F.col("ord") % 2 == 0, plain).otherwise(back).alias("value"))
    noise = rows.select(F.explode(F.array(F.concat(F.lit("# "), plain), F.lit(""), F.col("stem"))))
    lines.unionAll(noise).write.text(path)
    return label_files.read_review_list(src.spark, path)


@query(
    "sink_shot_report",
    with_inputs("ball_points players", shot_plans.REPORT, shot_plans.CRASHES),
)
def sink_shot_report(src):
    path = work_folder(src.spark, "shot-report")
    rows = shot_plans.report(src)
    rows.write.csv(path, header=True)
    return src.spark.read.schema(rows.schema).csv(path, header=True)


@query("sink_debug_metrics", with_inputs("ball_points", shot_plans.DEBUG, shot_plans.PROBS))
def sink_debug_metrics(src):
    path = work_folder(src.spark, "debug-metrics")
    rows = shots.debug_metrics(src.ball_points, shots.every_frame(src.ball_points))
    rows.write.csv(path, header=True)
    return src.spark.read.schema(rows.schema).csv(path, header=True)


_SNAPSHOT = "ord BIGINT, frame_path STRING, visibility BIGINT, x DOUBLE, y DOUBLE"


def _snapshots(src):
    """Folder of two snapshots: the labels, and the labels with fixes applied."""
    path = work_folder(src.spark, "snapshots")
    rows = src.label_rows.select("ord", "frame_path", "visibility", "x", "y")
    label_files.write_snapshot(rows, path, "20240101_000000_first")
    fixed = label_plans.patched(src).select(*rows.columns)
    label_files.write_snapshot(fixed, path, "20240102_000000_apply_fixes")
    return path


@query(
    "snapshot_write",
    with_inputs(
        "label_rows pred_rows",
        """SELECT '20240101_000000_first' AS snapshot, ord, visibility FROM label_rows UNION ALL
           SELECT '20240102_000000_apply_fixes', ord, CASE action WHEN 'removed' THEN 0 WHEN 'added' THEN 1 ELSE visibility END
           FROM patched""",
        label_plans.FIXES,
    ),
)
def snapshot_write(src):
    rows = label_files.read_snapshots(src.spark, _snapshots(src), f"{_SNAPSHOT}, snapshot STRING")
    return rows.select("snapshot", "ord", "visibility")


@query(
    "snapshot_latest",
    with_inputs(
        "label_rows pred_rows",
        """SELECT ord, CASE action WHEN 'removed' THEN 0 WHEN 'added' THEN 1 ELSE visibility END AS visibility FROM patched""",
        label_plans.FIXES,
    ),
)
def snapshot_latest(src):
    return label_files.read_latest_snapshot(src.spark, _snapshots(src), _SNAPSHOT).select("ord", "visibility")


@query(
    "remap_data_root",
    with_inputs(
        "label_rows",
        """SELECT ord, '/mnt/labels/' || substr(replace(frame_path, chr(92), '/'), 6) AS frame_path FROM label_rows""",
    ),
)
def remap_data_root(src):
    return src.label_rows.select("ord", paths.remap_root("frame_path", "/mnt/labels").alias("frame_path"))


@query(
    "pe_metrics",
    with_inputs(
        "label_rows pred_rows",
        f"""SELECT game, tp, fp, fn, {r('p', 6)} AS precision, {r('q', 6)} AS recall,
              {r('CASE WHEN p + q > 0 THEN 2e0 * p * q / (p + q) ELSE 0e0 END', 6)} AS f1
            FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0e0 END AS p,
                    CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0e0 END AS q
                  FROM (SELECT game, count(*) FILTER (hit) AS tp, count(*) FILTER (pred_x IS NOT NULL AND NOT hit) AS fp,
                          count(*) FILTER (gx IS NOT NULL AND NOT hit) AS fn
                        FROM (SELECT *, coalesce(sqrt((gx - pred_x) * (gx - pred_x) + (gy - pred_y) * (gy - pred_y)) <= 5, false) AS hit
                              FROM (SELECT l.game, CASE WHEN visibility > 0 THEN x * 640 / 1280e0 END AS gx,
                                      CASE WHEN visibility > 0 THEN y * 360 / 720e0 END AS gy, p.pred_x, p.pred_y
                                    FROM label_rows l LEFT JOIN pred_rows p ON p.game = l.game AND p.frame = l.frame AND p.conf >= 0.5e0) a) b
                        GROUP BY GROUPING SETS ((game), ())) c) e""",
    ),
)
def pe_metrics(src):
    rows = gates.scale_coords(src.label_rows).select("game", "frame", F.col("mx").alias("gx"), F.col("my").alias("gy"))
    return metrics.pe_metrics(rows, src.pred_rows)


PEAKS = [
    (
        "peaks",
        """SELECT vec_id, label, x AS px, y AS py, p AS pp FROM heat_cells
           QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, y, x) = 1""",
    ),
]


@query(
    "peak_margin",
    with_inputs(
        "heat_cells",
        f"""SELECT label, CAST(count(*) AS BIGINT) AS maps, {r('avg(margin)', 9)} AS margin FROM (
              SELECT k.vec_id, k.label, max(k.pp) - coalesce(max(c.p) FILTER (abs(c.x - k.px) > 2 OR abs(c.y - k.py) > 2), 0e0) AS margin
              FROM heat_cells c JOIN peaks k USING (vec_id) GROUP BY k.vec_id, k.label) a
            GROUP BY label""",
        PEAKS,
    ),
)
def peak_margin(src):
    """Mean margin over all maps, per label."""
    per = metrics.peak_margin(src.heat_cells, radius=2, keys=("vec_id", "label"))
    return per.groupBy("label").agg(F.count("*").alias("maps"), F.avg("margin").alias("margin")).withColumn(
        "margin", rounded("margin", 9)
    )


@query(
    "peak_centroid",
    with_inputs(
        "heat_cells",
        f"""SELECT vec_id, {r('sum(x * p) / sum(p)', 9)} AS cx, {r('sum(y * p) / sum(p)', 9)} AS cy, max(pp) AS conf
            FROM heat_cells c JOIN peaks k USING (vec_id)
            WHERE pp >= 0.1e0 AND abs(x - px) <= 2 AND abs(y - py) <= 2 AND p >= 0.5e0 * pp GROUP BY vec_id""",
        PEAKS,
    ),
)
def peak_centroid(src):
    rows = metrics.peak_centroid(src.heat_cells, radius=2)
    return rows.withColumns({c: rounded(c, 9) for c in ("cx", "cy")})
