"""Row-wise gates and projections on detections, reads and crops.

All of these are narrow: no shuffle, so filters and column choices reach the scan.
The two exceptions join or group by (game, frame), a key as small as one image.
"""

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.geometry import (
    FRAME_H,
    FRAME_W,
    center_x,
    center_y,
    d,
    in_court,
    in_court_column,
    trunc,
)

# Class numbers and gate limits.
BALL, HOOP, PLAYER, REFEREE = 0, 1, 2, 3
MIN_CONF = 0.30
MIN_HEIGHT_SHARE = 0.08
BALL_CONF, BALL_AREA, BALL_ASPECT = 0.25, (50, 2500), 1.8
BALL_RADIUS = 15
MODEL_W, MODEL_H = 640, 360
KP_CONF = 0.30


def box_geometry(boxes):
    """Centre, whole-pixel centre, size, area and aspect of each box."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.withColumns(
        {
            "cx": center_x(),
            "cy": center_y(),
            "icx": trunc(center_x()),
            "icy": trunc(center_y()),
            "w": w,
            "h": h,
            "area": w * h,
            "aspect": F.greatest(w, h).cast("double") / F.greatest(F.least(w, h), F.lit(1)),
        }
    )


def box_from_center(points, r=BALL_RADIUS, w=FRAME_W, h=FRAME_H):
    """Square box around a point, clipped to the frame."""
    return points.withColumns(
        {
            "x1": F.greatest(F.lit(0).cast("bigint"), trunc(F.col("cx") - r)),
            "y1": F.greatest(F.lit(0).cast("bigint"), trunc(F.col("cy") - r)),
            "x2": F.least(F.lit(w).cast("bigint"), trunc(F.col("cx") + r)),
            "y2": F.least(F.lit(h).cast("bigint"), trunc(F.col("cy") + r)),
        }
    )


def class_gate(dets, frame_h=FRAME_H):
    """Route detections by class; unsure ones and tiny players are dropped."""
    tall = (F.col("y2") - F.col("y1")) >= d(frame_h * MIN_HEIGHT_SHARE)
    route = (
        F.when(F.col("cls") == PLAYER, F.when(tall, F.lit("player")))
        .when(F.col("cls") == HOOP, F.lit("hoop"))
        .when(F.col("cls") == REFEREE, F.lit("referee"))
    )
    return dets.where(F.col("conf") >= MIN_CONF).withColumn("route", route).where("route IS NOT NULL")


def court_roi_gate(dets):
    """Keep detections whose foot point lies in the court trapezoid, edge included."""
    return dets.where(in_court(center_x(), F.col("y2").cast("double")))


def court_column_gate(points):
    """Keep ball points in or above the court's column."""
    return points.where(in_court_column("cx", "cy"))


def ball_shape_gate(dets):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    aspect = F.greatest(w, h).cast("double") / F.greatest(F.least(w, h), F.lit(1))
    return dets.where(
        (F.col("conf") >= BALL_CONF) & (w * h).between(*BALL_AREA) & (aspect <= BALL_ASPECT)
    )


def frame_flag_gate(dets, flags):
    """Keep detections of frames flagged as showing the court."""
    return dets.join(flags.where("visible").select("game", "frame"), ["game", "frame"], "left_semi")


def scale_coords(labels, w=FRAME_W, h=FRAME_H, to_w=MODEL_W, to_h=MODEL_H):
    """Label coordinates in another resolution; null when there is no ball."""
    seen = (F.col("visibility") > 0) & (F.col("x") >= 0) & (F.col("y") >= 0)
    return labels.withColumns(
        {
            "mx": F.when(seen, F.col("x") * to_w / d(w)),
            "my": F.when(seen, F.col("y") * to_h / d(h)),
        }
    )


def polygon_centroid(lines, cls=BALL, w=MODEL_W, h=MODEL_H):
    """Vertex mean of each file's first polygon of a class with at least two vertices."""
    parts = F.split(F.trim("line"), r"\s+")
    coords = F.transform(F.slice(parts, 2, 1 << 20), lambda v: v.try_cast("double"))
    rows = lines.select("file", "line_no", parts[0].cast("int").alias("cls"), coords.alias("at"))
    rows = rows.where((F.col("cls") == cls) & (F.size("at") >= 4))
    first = rows.groupBy("file").agg(F.min_by("at", "line_no").alias("at"))
    every = lambda odd: F.filter("at", lambda v, i: i % 2 == odd)
    mean = lambda a: F.aggregate(a, d(0), lambda s, v: s + v) / F.size(a)
    return first.select("file", (mean(every(0)) * d(w)).alias("x"), (mean(every(1)) * d(h)).alias("y"))


def jersey_crop(boxes):
    """Number crop: upper 55 % of the box without 15 % at each side; null if degenerate."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    x1, x2 = F.col("x1") + trunc(w * d(0.15)), F.col("x2") - trunc(w * d(0.15))
    y2 = F.col("y1") + trunc(h * d(0.55))
    ok = (x2 > x1) & (y2 > F.col("y1"))
    zero = F.lit(0).cast("bigint")
    return F.when(
        ok,
        F.struct(
            F.greatest(zero, x1).alias("x1"),
            F.greatest(zero, F.col("y1")).alias("y1"),
            x2.alias("x2"),
            y2.alias("y2"),
        ),
    )


def color_crop(fw=FRAME_W, fh=FRAME_H):
    """Torso crop for colour: shoulders to hips, shoulders only, or a share of the box.

    A pose crop that is too small falls back to the box; a degenerate box gives null.
    """
    c = F.col
    zero = F.lit(0).cast("bigint")
    seen = lambda conf, *pts: F.forall(F.array(*[c(p) for p in pts]), lambda v: v > 0) & (
        c(conf) >= KP_CONF
    )
    shoulders = seen("shoulder_conf", "lsx", "lsy", "rsx", "rsy")
    hips = seen("hip_conf", "lhx", "lhy", "rhx", "rhy")
    box = lambda x1, y1, x2, y2: F.struct(
        F.greatest(zero, x1).alias("x1"),
        F.greatest(zero, y1).alias("y1"),
        F.least(F.lit(fw).cast("bigint"), x2).alias("x2"),
        F.least(F.lit(fh).cast("bigint"), y2).alias("y2"),
    )
    big = lambda b, by: F.when((b.x2 > b.x1 + by) & (b.y2 > b.y1 + by), b)
    pad_x = trunc(F.abs(c("lsx") - c("rsx")) * d(0.10))
    pad_y = trunc(F.abs(c("lsy") + c("rsy")) * d(0.02))
    left = trunc(F.least("lsx", "rsx")) + pad_x
    right = trunc(F.greatest("lsx", "rsx")) - pad_x
    top = trunc(F.least("lsy", "rsy"))
    h, w = c("y2") - c("y1"), c("x2") - c("x1")
    full = box(left, top + pad_y, right, trunc((c("lhy") + c("rhy")) / d(2)) - pad_y)
    half = box(left, top, right, top + trunc(h * d(0.45)))
    plain = box(
        c("x1") + trunc(w * d(0.15)),
        c("y1") + trunc(h * d(0.22)),
        c("x2") - trunc(w * d(0.15)),
        c("y1") + trunc(h * d(0.58)),
    )
    pose = F.when(shoulders & hips, big(full, 8)).when(shoulders, big(half, 8))
    return F.coalesce(pose, big(plain, 4))


def crop_box(torsos):
    """Both crops of each player box as flat columns."""
    rows = torsos.withColumn("j", jersey_crop(torsos)).withColumn("c", color_crop())
    flat = [F.col(f"{p}.{k}").alias(f"{n}_{k}") for p, n in (("j", "jersey"), ("c", "color"))
            for k in ("x1", "y1", "x2", "y2")]
    return rows.select("game", "frame", "seq", *flat)


def digit_read_gate(reads):
    """Reads that are a number from 1 to 99, in canonical spelling."""
    text = F.trim("text")
    num = F.when(text.rlike(r"^\d{1,2}$"), text.cast("int"))
    return reads.withColumn("num", num).where(F.col("num").between(1, 99)).withColumn(
        "num", F.col("num").cast("string")
    )


def display_label(dets, locks):
    """``#number`` for a player with a confirmed number, else ``#track``."""
    rows = dets.join(locks.select("game", "tid", "num"), ["game", "tid"], "left")
    return rows.withColumn(
        "label", F.concat(F.lit("#"), F.coalesce("num", F.col("tid").cast("string")))
    ).drop("num")


def cadence_filter(dets, locks, fast=30, slow=90):
    """Frames on which numbers are read: every ``fast`` frames while any visible player
    is unconfirmed, else every ``slow`` frames.

    Only multiples of ``fast`` can pass when it divides ``slow``, so the rest is dropped
    before the join.
    """
    rows = dets.where((F.col("frame") % fast == 0) | (F.col("frame") % slow == 0))
    rows = rows.join(
        locks.select("game", "tid", F.col("lock_frame")), ["game", "tid"], "left"
    )
    open_ = F.col("lock_frame").isNull() | (F.col("lock_frame") >= F.col("frame"))
    per = rows.groupBy("game", "frame").agg(F.max(open_).alias("has_unconfirmed"))
    every = F.when(F.col("has_unconfirmed"), fast).otherwise(slow)
    return per.where(F.col("frame") % every == 0)


def frame_keys(rows, path="frame_path"):
    return rows.withColumns({"folder": paths.game_of(path), "stem": paths.frame_stem(path)})


def cutoff_filter(rows, cutoff=None, stem="stem"):
    """Rows whose frame number does not pass the cutoff; all of them without one."""
    return rows if cutoff is None else rows.where(paths.last_digits(stem) <= cutoff)
