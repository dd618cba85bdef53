"""The label-quality loop."""

from pyspark.sql import functions as F

from ..functions.geometry import rounded
from ..operators import gates, labels
from ..operators.labels import FN, FP, PM
from .inputs import with_inputs
from .registry import query, r

# ---- the same questions in SQL ------------------------------------------------------

SPLITS = [
    (
        "split_rows",
        """SELECT l.*, CASE WHEN row_number() OVER (PARTITION BY game ORDER BY ord)
               > count(*) OVER (PARTITION BY game) - greatest(1, floor(count(*) OVER (PARTITION BY game) * 0.15e0))
             THEN 'val' ELSE 'train' END AS split,
             string_split(replace(frame_path, chr(92), '/'), '/')[-2] AS folder,
             replace(string_split(replace(frame_path, chr(92), '/'), '/')[-1], '.jpg', '') AS stem
           FROM label_rows l""",
    ),
]
TRIPLETS = SPLITS + [
    (
        "trip",
        """SELECT * FROM (
             SELECT *, frame - lag(frame) OVER w AS s1, lag(frame) OVER w - lag(frame, 2) OVER w AS s2,
               folder = lag(folder) OVER w AND folder = lag(folder, 2) OVER w AS same
             FROM split_rows WINDOW w AS (PARTITION BY split ORDER BY ord)) a
           WHERE s1 = 1 AND s2 = 1 AND same""",
    ),
]


def _audit(base):
    return [
        (
            "cmp",
            f"""SELECT t.*, CASE WHEN visibility > 0 AND x >= 0 AND y >= 0 THEN x * 640 / 1280e0 END AS mx,
                  CASE WHEN visibility > 0 AND x >= 0 AND y >= 0 THEN y * 360 / 720e0 END AS my,
                  p.pred_x, p.pred_y, p.conf AS pc
                FROM {base} t LEFT JOIN pred_rows p ON p.game = t.game AND p.frame = t.frame AND p.conf >= 0.5e0""",
        ),
        (
            "diff",
            """SELECT ord, split, folder, stem, frame, frame_path, visibility, category,
                 CASE WHEN category <> 'false_negatives' THEN mx END AS label_x,
                 CASE WHEN category <> 'false_negatives' THEN my END AS label_y, pred_x, pred_y,
                 CASE WHEN category = 'false_negatives' THEN pc END AS pred_conf,
                 CASE WHEN category = 'position_mismatch' THEN dist END AS distance_px
               FROM (SELECT *, CASE WHEN pred_x IS NOT NULL AND mx IS NULL THEN 'false_negatives'
                     WHEN pred_x IS NULL AND mx IS NOT NULL THEN 'false_positives'
                     WHEN dist > 15 THEN 'position_mismatch' END AS category
                   FROM (SELECT *, sqrt((pred_x - mx) * (pred_x - mx) + (pred_y - my) * (pred_y - my)) AS dist
                         FROM cmp) a) b
               WHERE category IS NOT NULL""",
        ),
    ]


AUDIT = TRIPLETS + _audit("trip")
FIXES = SPLITS + _audit("split_rows") + [
    (
        "fixes",
        """SELECT folder, stem, category, pred_x, pred_y, pred_conf, distance_px, ord AS fix_ord FROM diff
           UNION ALL SELECT folder, stem, 'position_mismatch', label_x + 40e0, label_y, NULL, 40e0, ord
           FROM diff WHERE category = 'false_positives' AND ord % 7 = 0
           UNION ALL SELECT folder, stem, category, pred_x + 1e0, pred_y, pred_conf, distance_px, ord + 1000000
           FROM diff WHERE ord % 17 = 0""",
    ),
    (
        "patch",
        """SELECT l.*, f.stem IS NOT NULL AND visibility > 0 AS fp, visibility > 0 AND pm.distance_px >= 18e0 AS pm,
             visibility = 0 AND fn.pred_conf >= 0.6e0 AS fn, pm.pred_x AS px, pm.pred_y AS py, fn.pred_x AS nx,
             fn.pred_y AS ny
           FROM split_rows l
           LEFT JOIN (SELECT DISTINCT folder, stem FROM fixes WHERE category = 'false_positives') f USING (folder, stem)
           LEFT JOIN (SELECT * FROM fixes WHERE category = 'position_mismatch' QUALIFY row_number()
             OVER (PARTITION BY folder, stem ORDER BY fix_ord DESC) = 1) pm USING (folder, stem)
           LEFT JOIN (SELECT * FROM fixes WHERE category = 'false_negatives' QUALIFY row_number()
             OVER (PARTITION BY folder, stem ORDER BY fix_ord DESC) = 1) fn USING (folder, stem)""",
    ),
    (
        "patched",
        """SELECT *, CASE WHEN fp AND frame <= 8000 THEN 'removed' WHEN coalesce(pm, false) AND frame <= 9000 THEN 'repositioned'
             WHEN coalesce(fn, false) AND frame <= 7000 THEN 'added' END AS action, fp AND frame > 8000 AS skipped_fp,
             NOT (fp AND frame <= 8000) AND coalesce(pm, false) AND frame > 9000 AS skipped_pm,
             coalesce(fn, false) AND frame > 7000 AS skipped_fn FROM patch""",
    ),
]
CUTS = {"max_fp": 8000, "max_pm": 9000, "max_fn": 7000, "min_dist": 18.0, "min_conf": 0.6}


# ---- shared steps -------------------------------------------------------------------


def split_rows(src):
    return labels.split_tail(gates.frame_keys(src.label_rows))


def audit_rows(src):
    return labels.audit(labels.frame_triplets(split_rows(src), keys=["split"]), src.pred_rows)


def fix_rows(src):
    """Disagreements on all labels plus stale and repeated ones, as reviews leave them."""
    cols = ["folder", "stem", "category", "pred_x", "pred_y", "pred_conf", "distance_px", "fix_ord"]
    rows = labels.audit(split_rows(src), src.pred_rows).withColumn("fix_ord", F.col("ord"))
    stale = rows.where((F.col("category") == FP) & (F.col("ord") % 7 == 0)).withColumns(
        {
            "category": F.lit(PM),
            "pred_x": F.col("label_x") + 40.0,
            "pred_y": F.col("label_y"),
            "distance_px": F.lit(40.0),
        }
    )
    again = rows.where(F.col("ord") % 17 == 0).withColumns(
        {"pred_x": F.col("pred_x") + 1.0, "fix_ord": F.col("ord") + 1000000}
    )
    return rows.select(*cols).unionByName(stale.select(*cols)).unionByName(again.select(*cols))


def patched(src):
    return labels.label_patch(split_rows(src), fix_rows(src), **CUTS)


# ---- queries ------------------------------------------------------------------------


@query("frame_triplets", with_inputs("label_rows", "SELECT ord, split, visibility > 0 AS visible FROM trip", TRIPLETS))
def frame_triplets(src):
    return labels.frame_triplets(split_rows(src), keys=["split"]).select("ord", "split", "visible")


@query("split_tail", with_inputs("label_rows", "SELECT ord, game, split FROM split_rows", SPLITS))
def split_tail(src):
    return labels.split_tail(src.label_rows).select("ord", "game", "split")


@query(
    "split_block",
    with_inputs(
        "label_rows",
        """SELECT ord, CASE WHEN ord > 300 AND ord <= 300 + floor((SELECT count(*) FROM label_rows) * 0.15e0)
             THEN 'val' ELSE 'train' END AS split FROM label_rows""",
    ),
)
def split_block(src):
    return labels.split_block(src.label_rows, offset=300).select("ord", "split")


@query(
    "audit_disagreements",
    with_inputs(
        "label_rows pred_rows",
        "SELECT ord, split, folder, stem, category, label_x, label_y, pred_x, pred_y, pred_conf, distance_px FROM diff",
        AUDIT,
    ),
)
def audit_disagreements(src):
    return audit_rows(src).select(
        "ord", "split", "folder", "stem", "category", "label_x", "label_y", "pred_x", "pred_y",
        "pred_conf", "distance_px",
    )


@query(
    "audit_counts",
    with_inputs(
        "label_rows pred_rows",
        "SELECT split, category, CAST(count(*) AS BIGINT) AS rows FROM diff GROUP BY CUBE (split, category)",
        AUDIT,
    ),
)
def audit_counts(src):
    return labels.category_counts(audit_rows(src))


@query(
    "review_cap",
    with_inputs(
        "label_rows pred_rows",
        """SELECT ord, split, category FROM diff
           QUALIFY row_number() OVER (PARTITION BY split, category ORDER BY ord) <= 200""",
        AUDIT,
    ),
)
def review_cap(src):
    return labels.review_cap(audit_rows(src), 200).select("ord", "split", "category")


@query(
    "review_sync",
    with_inputs(
        "label_rows pred_rows review_keys",
        """SELECT ord, category FROM diff d WHERE EXISTS (SELECT 1 FROM review_keys k
             WHERE k.ord % 5 <> 0 AND k.folder = d.folder AND k.stem = d.stem)""",
        AUDIT,
    ),
)
def review_sync(src):
    kept = src.review_keys.where(F.col("ord") % 5 != 0)
    return labels.review_sync(audit_rows(src), kept).select("ord", "category")


@query(
    "reviewed_keys",
    with_inputs(
        "label_rows pred_rows review_keys",
        """SELECT folder, stem FROM diff INTERSECT SELECT folder, stem FROM review_keys WHERE ord % 5 <> 0""",
        AUDIT,
    ),
)
def reviewed_keys(src):
    return labels.reviewed_keys(audit_rows(src), src.review_keys.where(F.col("ord") % 5 != 0))


@query(
    "label_patch",
    with_inputs(
        "label_rows pred_rows",
        f"""SELECT ord, split, action, CASE action WHEN 'removed' THEN 0 WHEN 'added' THEN 1 ELSE visibility END AS visibility,
              CASE action WHEN 'removed' THEN -1e0 WHEN 'repositioned' THEN {r('px', 1)} WHEN 'added' THEN {r('nx', 1)} ELSE x END AS x,
              CASE action WHEN 'removed' THEN -1e0 WHEN 'repositioned' THEN {r('py', 1)} WHEN 'added' THEN {r('ny', 1)} ELSE y END AS y
            FROM patched""",
        FIXES,
    ),
)
def label_patch(src):
    return patched(src).select("ord", "split", "action", "visibility", "x", "y")


@query(
    "patch_counts",
    with_inputs(
        "label_rows pred_rows",
        """SELECT count(*) FILTER (action = 'removed') AS removed, count(*) FILTER (action = 'repositioned') AS repositioned,
             count(*) FILTER (action = 'added') AS added, count(*) FILTER (skipped_fp) AS skipped_fp,
             count(*) FILTER (skipped_pm) AS skipped_pm, count(*) FILTER (skipped_fn) AS skipped_fn, count(*) AS total
           FROM patched""",
        FIXES,
    ),
)
def patch_counts(src):
    return labels.patch_counts(patched(src))


def _zeroed(src):
    return labels.zero_targets(gates.frame_keys(src.label_rows), src.review_keys.where("neither"))


@query(
    "zero_targets",
    with_inputs(
        "label_rows review_keys",
        """SELECT ord, CASE WHEN neither THEN 0 ELSE visibility END AS visibility,
             CASE WHEN neither THEN -1e0 ELSE x END AS x, CASE WHEN neither THEN -1e0 ELSE y END AS y,
             CASE WHEN neither AND visibility > 0 THEN 'zeroed' WHEN neither THEN 'already_zero' END AS outcome
           FROM label_rows JOIN review_keys USING (ord)""",
    ),
)
def zero_targets(src):
    return _zeroed(src).select("ord", "visibility", "x", "y", "outcome")


@query(
    "zero_counts",
    with_inputs(
        "label_rows review_keys",
        """SELECT count(*) FILTER (neither AND visibility > 0) AS zeroed,
             count(*) FILTER (neither AND visibility = 0) AS already_zero, count(*) AS total
           FROM label_rows JOIN review_keys USING (ord)""",
    ),
)
def zero_counts(src):
    return labels.zero_counts(_zeroed(src))


@query(
    "label_demote",
    with_inputs(
        "label_rows ball_dets",
        """SELECT ord, demoted, CASE WHEN demoted THEN 0 ELSE visibility END AS visibility,
             CASE WHEN demoted THEN -1e0 ELSE x END AS x, CASE WHEN demoted THEN -1e0 ELSE y END AS y
           FROM (SELECT *, visibility > 0 AND NOT EXISTS (SELECT 1 FROM ball_dets d WHERE d.game = l.game
               AND d.frame = l.frame AND d.conf >= 0.5e0
               AND sqrt((l.x - (d.x1 + d.x2) / 2e0) * (l.x - (d.x1 + d.x2) / 2e0)
                 + (l.y - (d.y1 + d.y2) / 2e0) * (l.y - (d.y1 + d.y2) / 2e0)) <= 30) AS demoted FROM label_rows l) a""",
    ),
)
def label_demote(src):
    rows = labels.label_demote(src.label_rows, src.ball_dets)
    return rows.select("ord", "demoted", "visibility", "x", "y")


@query(
    "label_stats",
    with_inputs(
        "label_rows",
        f"""SELECT split, game, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (visibility > 0) AS BIGINT) AS visible,
              {r('count(*) FILTER (visibility > 0) / CAST(count(*) AS DOUBLE) * 100e0', 1)} AS pct
            FROM split_rows GROUP BY ROLLUP (split, game)""",
        SPLITS,
    ),
)
def label_stats(src):
    return labels.label_stats(labels.split_tail(src.label_rows))


@query(
    "merge_sources",
    with_inputs(
        "label_sources",
        """SELECT source, CAST(row_number() OVER (ORDER BY source, ord) AS BIGINT) AS ord, frame_path, visibility
           FROM label_sources""",
    ),
)
def merge_sources(src):
    rows = src.label_sources
    parts = [rows.where(F.col("source") == k).drop("source") for k in (0, 1, 2)]
    return labels.merge_sources([*parts, None]).select("source", "ord", "frame_path", "visibility")


@query(
    "image_for_label",
    with_inputs(
        "polygons",
        """SELECT stem, stem || '.' || ext AS image FROM images
           QUALIFY row_number() OVER (PARTITION BY stem ORDER BY CASE ext WHEN 'jpg' THEN 1 WHEN 'jpeg' THEN 2
             WHEN 'png' THEN 3 ELSE 4 END) = 1""",
        [
            (
                "images",
                """SELECT replace(file, '.jpg', '') AS stem, ['jpg', 'jpeg', 'png', 'bmp'][frame_no % 4 + 1] AS ext FROM polygons
                   UNION ALL SELECT replace(file, '.jpg', ''), ['bmp', 'png', 'jpeg'][frame_no % 3 + 1] FROM polygons""",
            )
        ],
    ),
)
def image_for_label(src):
    stem = F.replace("file", F.lit(".jpg"), F.lit(""))
    pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), by.cast("int") + 1)
    stems = src.polygons.select(stem.alias("stem"), "frame_no")
    images = stems.select("stem", pick(labels.IMAGE_KINDS, F.col("frame_no") % 4).alias("ext")).unionByName(
        stems.select("stem", pick(("bmp", "png", "jpeg"), F.col("frame_no") % 3).alias("ext"))
    )
    return labels.image_for_label(stems, images)


@query(
    "pending_work",
    with_inputs(
        "label_rows",
        "SELECT frame_path FROM label_rows EXCEPT SELECT frame_path FROM label_rows WHERE ord % 3 = 0",
    ),
)
def pending_work(src):
    return labels.pending_work(src.label_rows, src.label_rows.where(F.col("ord") % 3 == 0))


@query(
    "distinct_paths",
    with_inputs(
        "label_sources",
        """SELECT frame_path FROM label_sources WHERE source <> 1 UNION
           SELECT frame_path FROM label_sources WHERE source <> 2""",
    ),
)
def distinct_paths(src):
    rows = src.label_sources
    return labels.distinct_paths(rows.where("source <> 1"), rows.where("source <> 2"))


@query(
    "oversample_class",
    with_inputs(
        "polygons",
        """SELECT stem, stem || '_osball_' || CAST(k AS VARCHAR) AS copy
           FROM (SELECT replace(file, '.jpg', '') AS stem, unnest(range(1, 8)) AS k FROM polygons
                 WHERE line LIKE '0 %' AND frame_no % 10 <> 0) a""",
    ),
)
def oversample_class(src):
    rows = src.polygons.select(
        F.replace("file", F.lit(".jpg"), F.lit("")).alias("stem"),
        F.split("line", " ")[0].cast("int").alias("cls"),
        "frame_no",
    )
    copies = rows.where("frame_no % 10 = 0").select(F.concat("stem", F.lit("_osball_1")).alias("stem"))
    return labels.oversample_class(rows, rows.select("stem").unionByName(copies))


@query(
    "class_counts",
    with_inputs(
        "polygons",
        "SELECT CAST(split_part(line, ' ', 1) AS INTEGER) AS cls, count(*) AS n FROM polygons GROUP BY 1",
    ),
)
def class_counts(src):
    return labels.class_counts(src.polygons.select(F.split("line", " ")[0].cast("int").alias("cls")))


@query(
    "balance_visible",
    with_inputs(
        "label_rows",
        """SELECT ord, CAST(unnest(range(1, CASE WHEN visible THEN times ELSE 1 END + 1)) AS INTEGER) AS copy
           FROM (SELECT ord, visibility = 0 AS visible, greatest(1, CAST(round_even(
               (SELECT count(*) FILTER (visibility > 0) / CAST(greatest(1, count(*) FILTER (visibility = 0)) AS DOUBLE) FROM trip), 0)
               AS BIGINT)) AS times FROM trip) a""",
        TRIPLETS,
    ),
)
def balance_visible(src):
    """Here the rarer hidden labels play the visible class, so that copies do arise."""
    rows = labels.frame_triplets(split_rows(src), keys=["split"])
    return labels.balance_visible(rows.withColumn("visible", ~F.col("visible"))).select("ord", "copy")


@query(
    "dedup_variants",
    with_inputs("polygons", "SELECT frame_no AS num, min(file) AS file FROM polygons GROUP BY frame_no"),
)
def dedup_variants(src):
    return labels.dedup_variants(src.polygons)


@query(
    "ordered_frames",
    with_inputs(
        "polygons",
        """SELECT num, file, CAST(row_number() OVER (ORDER BY num) AS BIGINT) AS pos
           FROM (SELECT frame_no AS num, min(file) AS file FROM polygons GROUP BY frame_no) a""",
    ),
)
def ordered_frames(src):
    return labels.ordered_frames(src.polygons)


@query(
    "label_sample",
    with_inputs(
        "label_rows",
        "SELECT ord, frame_path FROM label_rows ORDER BY (ord * 7919) % 10007, ord LIMIT 50",
    ),
)
def label_sample(src):
    return labels.label_sample(src.label_rows, 50).select("ord", "frame_path")


@query(
    "detection_rate",
    with_inputs(
        "label_rows",
        f"""SELECT game, detected, frames, {r('detected / CAST(frames AS DOUBLE) * 100e0', 2)} AS pct
            FROM (SELECT game, count(*) FILTER (visibility > 0) AS detected, count(*) AS frames
                  FROM label_rows GROUP BY game) a""",
    ),
)
def detection_rate(src):
    return labels.detection_rate(src.label_rows)


@query(
    "frame_range_slice",
    with_inputs(
        "ball_points",
        """SELECT game, frame, cx, cy FROM ball_points WHERE frame >= 500
           QUALIFY row_number() OVER (PARTITION BY game ORDER BY frame) <= 1500""",
    ),
)
def frame_range_slice(src):
    rows = src.ball_points.select("game", "frame", "cx", "cy")
    return labels.frame_range_slice(rows, start=500, count=1500)
