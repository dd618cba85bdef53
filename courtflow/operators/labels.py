"""The label-quality loop: triplets, audit, review, patching, splits and sampling.

File order is the column ``ord``; look-back along it uses slices with a two-row halo,
so no window spans a whole game or a whole file.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.geometry import FRAME_H, FRAME_W, d, distance, rounded
from ..functions.slices import halo, numbered, own, per_slice, running, slice_of
from .gates import BALL, scale_coords

# Fixed values of the label rules.
AUDIT_CONF, AUDIT_DIST = 0.5, 15.0
DEMOTE_CONF, DEMOTE_DIST = 0.5, 30.0
VAL_SHARE = 0.15
FN, FP, PM = "false_negatives", "false_positives", "position_mismatch"
IMAGE_KINDS = ("jpg", "jpeg", "png", "bmp")


# ---- sequences and splits -----------------------------------------------------------


def frame_triplets(labels, keys=()):
    """Rows whose two predecessors in file order are the previous two frames of the
    same folder; ``keys`` keeps files (such as splits) apart."""
    rows = labels.withColumns(
        {"folder_path": paths.unix_path("frame_path"), "num": paths.last_token("frame_path")}
    ).withColumn("folder_path", F.regexp_extract("folder_path", r"^(.*)/[^/]*$", 1))
    w = Window.partitionBy(*keys, "slice").orderBy("ord")
    rows = halo(rows, "ord", before=2)
    ok = F.lit(True)
    for back in (1, 2):
        ok = ok & (F.lag("folder_path", back).over(w) == F.col("folder_path"))
        ok = ok & (F.lag("num", back).over(w) == F.col("num") - back)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)) & (F.col("num") >= 2))
    rows = own(rows).where("ok").drop("ok", "slice", "num", "folder_path")
    return rows.withColumn("visible", F.col("visibility") > 0)


def split_tail(labels, share=VAL_SHARE, keys=("game",)):
    """Last max(1, floor(share * n)) rows of each game, in file order, become ``val``."""
    keys = list(keys)
    rows = numbered(labels, keys, "ord", "row")
    size = per_slice(labels, keys, "ord", name="__slice", n=F.count("*"))
    held = F.greatest(F.lit(1), F.floor(F.col("n") * d(share)))
    return rows.withColumn("__slice", slice_of("ord")).join(size, [*keys, "__slice"]).withColumn(
        "split", F.when(F.col("row") > F.col("n") - held, "val").otherwise("train")
    ).drop("row", "n", "__slice")


def split_block(labels, offset, share=VAL_SHARE):
    """One contiguous block of floor(share * n) rows from ``offset`` on becomes ``val``."""
    n = labels.agg(F.count("*")).scalar()
    rows = numbered(labels, [], "ord", "row").withColumn("n", n)
    size = F.floor(F.col("n") * d(share))
    at = F.least(F.lit(offset), F.greatest(F.col("n") - size, F.lit(0)))
    inside = (F.col("row") > at) & (F.col("row") <= at + size)
    return rows.withColumn("split", F.when(inside, "val").otherwise("train")).drop("row", "n")


def merge_sources(sources):
    """Sources stacked in the given order; missing ones (None) are skipped.

    Each source brings its own ``ord``; the result counts on across sources.
    """
    stacked = None
    for rank, rows in enumerate(sources):
        if rows is None:
            continue
        rows = rows.withColumns(
            {"source": F.lit(rank).cast("bigint"), "slice": slice_of("ord"), "at": F.col("ord")}
        ).drop("ord")
        stacked = rows if stacked is None else stacked.unionByName(rows)
    out = running(
        stacked, [], ["source", "at"], {"ord": ("count", F.lit(1))}, unit=["source", "slice"]
    )
    return out.drop("slice", "at")


def label_stats(labels, columns=("split", "game")):
    """Rows and visible rows per column set, with subtotals (rolled up after counting)."""
    per = labels.groupBy(*columns).agg(
        F.count("*").alias("n"), F.count_if(F.col("visibility") > 0).alias("v")
    )
    return per.rollup(*columns).agg(F.sum("n").alias("rows"), F.sum("v").alias("visible")).withColumn(
        "pct", rounded(F.col("visible") / F.col("rows") * d(100), 1)
    )


# ---- audit --------------------------------------------------------------------------


def audit(labels, preds, conf=AUDIT_CONF, dist=AUDIT_DIST, w=FRAME_W, h=FRAME_H):
    """Disagreements between labels and predictions, in model space, per label row.

    ``preds`` holds (game, frame, pred_x, pred_y, conf); one below ``conf`` counts as none.
    """
    seen = preds.where(F.col("conf") >= conf).select(
        "game", "frame", "pred_x", "pred_y", F.col("conf").alias("pred_conf")
    )
    rows = scale_coords(labels, w, h).join(seen, ["game", "frame"], "left")
    gap = distance("pred_x", "pred_y", "mx", "my")
    has_label, has_pred = F.col("mx").isNotNull(), F.col("pred_x").isNotNull()
    category = (
        F.when(has_pred & ~has_label, FN)
        .when(has_label & ~has_pred, FP)
        .when(has_label & has_pred & (gap > dist), PM)
    )
    rows = rows.withColumns({"category": category, "distance_px": gap}).where("category IS NOT NULL")
    pick = lambda c, *cats: F.when(F.col("category").isin(*cats), F.col(c))
    return rows.withColumns(
        {
            "label_x": pick("mx", FP, PM),
            "label_y": pick("my", FP, PM),
            "pred_conf": pick("pred_conf", FN),
            "distance_px": pick("distance_px", PM),
        }
    )


def category_counts(disagreements, extra=()):
    """Rows per split and category with both kinds of subtotals."""
    per = disagreements.groupBy("split", "category").agg(F.count("*").alias("n"))
    return per.cube("split", "category").agg(F.sum("n").alias("rows"))


def review_cap(disagreements, limit):
    """First ``limit`` rows per split and category in row order (limited before the shuffle)."""
    w = Window.partitionBy("split", "category").orderBy("ord")
    return disagreements.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def review_sync(disagreements, kept):
    """Disagreements whose image is still in the review set."""
    return disagreements.join(kept.select("folder", "stem"), ["folder", "stem"], "left_semi")


def reviewed_keys(disagreements, kept):
    return disagreements.select("folder", "stem").intersect(kept.select("folder", "stem"))


# ---- changes ------------------------------------------------------------------------


def label_patch(
    labels,
    fixes,
    fix_positions=True,
    add_missed=True,
    min_dist=AUDIT_DIST,
    min_conf=AUDIT_CONF,
    max_fp=None,
    max_pm=None,
    max_fn=None,
    scale_x=1.0,
    scale_y=1.0,
):
    """Apply reviewed disagreements to labels: remove, else reposition, else add.

    A fix past its cutoff is skipped and the next kind gets its chance.  Of several rows
    for one image and category the last counts, so the fixes are folded to one row per
    image first and a single join remains.  ``scale_*`` bring predictions into label space.
    """
    of = lambda cat: F.when(F.col("category") == cat, F.col("fix_ord"))
    point = F.struct("pred_x", "pred_y", "distance_px", "pred_conf")
    per = fixes.groupBy("folder", "stem").agg(
        (F.max(of(FP)).isNotNull()).alias("fp"),
        F.max_by(point, of(PM)).alias("pm"),
        F.max_by(point, of(FN)).alias("fn"),
    )
    rows = labels.join(per, ["folder", "stem"], "left")
    c = F.col
    number = paths.last_digits("stem")
    within = lambda limit: F.lit(True) if limit is None else number <= limit
    shown = c("visibility") > 0
    fp = F.coalesce(c("fp"), F.lit(False)) & shown
    pm = F.lit(fix_positions) & F.coalesce(c("pm.distance_px") >= min_dist, F.lit(False)) & shown
    fn = F.lit(add_missed) & F.coalesce(c("fn.pred_conf") >= min_conf, F.lit(False)) & ~shown
    removed = fp & within(max_fp)
    moved = ~removed & pm & within(max_pm)
    added = fn & within(max_fn)
    action = F.when(removed, "removed").when(moved, "repositioned").when(added, "added")
    fixed = lambda p, k, s: rounded(c(f"{p}.{k}") * d(s), 1)
    new = lambda k, s, old: (
        F.when(removed, d(-1)).when(moved, fixed("pm", k, s)).when(added, fixed("fn", k, s)).otherwise(c(old))
    )
    return rows.select(
        *[x for x in labels.columns if x not in ("visibility", "x", "y")],
        F.when(removed, 0).when(added, 1).otherwise(c("visibility")).cast("bigint").alias("visibility"),
        new("pred_x", scale_x, "x").alias("x"),
        new("pred_y", scale_y, "y").alias("y"),
        action.alias("action"),
        (fp & ~within(max_fp)).alias("skipped_fp"),
        (~removed & pm & ~within(max_pm)).alias("skipped_pm"),
        (fn & ~within(max_fn)).alias("skipped_fn"),
    )


def patch_counts(patched):
    hit = lambda a: F.count_if(F.col("action") == a).alias(a)
    return patched.agg(
        hit("removed"),
        hit("repositioned"),
        hit("added"),
        *[F.count_if(F.col(s)).alias(s) for s in ("skipped_fp", "skipped_pm", "skipped_fn")],
        F.count("*").alias("total"),
    )


def zero_targets(labels, targets):
    """Hide the labels of the target images; tells hidden ones from already hidden ones."""
    keys = targets.select("folder", "stem").distinct().withColumn("hit", F.lit(True))
    rows = labels.join(keys, ["folder", "stem"], "left")
    shown = F.col("visibility") > 0
    outcome = F.when(F.col("hit") & shown, "zeroed").when(F.col("hit"), "already_zero")
    zero = F.coalesce(F.col("hit"), F.lit(False)) & shown
    return rows.withColumns(
        {
            "outcome": outcome,
            "x": F.when(zero, d(-1)).otherwise(F.col("x")),
            "y": F.when(zero, d(-1)).otherwise(F.col("y")),
            "visibility": F.when(zero, F.lit(0).cast("bigint")).otherwise(F.col("visibility")),
        }
    ).drop("hit")


def zero_counts(zeroed):
    return zeroed.agg(
        F.count_if(F.col("outcome") == "zeroed").alias("zeroed"),
        F.count_if(F.col("outcome") == "already_zero").alias("already_zero"),
        F.count("*").alias("total"),
    )


def label_demote(labels, dets, conf=DEMOTE_CONF, radius=DEMOTE_DIST):
    """Hide visible labels without a sure detection within ``radius`` on their frame."""
    sure = dets.where(F.col("conf") >= conf).select(
        "game", "frame", ((F.col("x1") + F.col("x2")) / d(2)).alias("dx"),
        ((F.col("y1") + F.col("y2")) / d(2)).alias("dy"),
    )
    per = sure.groupBy("game", "frame").agg(F.collect_list(F.struct("dx", "dy")).alias("sure"))
    near = F.exists("sure", lambda p: distance("x", "y", p["dx"], p["dy"]) <= radius)
    hidden = (F.col("visibility") > 0) & ~F.coalesce(near, F.lit(False))
    return labels.join(per, ["game", "frame"], "left").select(
        *labels.columns, F.coalesce(hidden, F.lit(False)).alias("hidden")
    ).withColumns(
        {
            "demoted": F.col("hidden"),
            "visibility": F.when(F.col("hidden"), F.lit(0).cast("bigint")).otherwise(F.col("visibility")),
            "x": F.when(F.col("hidden"), d(-1)).otherwise(F.col("x")),
            "y": F.when(F.col("hidden"), d(-1)).otherwise(F.col("y")),
        }
    ).drop("hidden")


# ---- files and images ---------------------------------------------------------------


def image_for_label(stems, images, kinds=IMAGE_KINDS):
    """Image of each label stem, by extension priority."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("ext"))
    known = images.withColumn("rank", rank).where("rank > 0")
    best = known.groupBy("stem").agg(F.min_by("ext", "rank").alias("ext"))
    return stems.select("stem").distinct().join(best, "stem").withColumn(
        "image", F.concat("stem", F.lit("."), "ext")
    ).drop("ext")


def pending_work(rows, cached):
    """Distinct paths that have not been cached yet."""
    return rows.select("frame_path").distinct().join(
        cached.select("frame_path"), "frame_path", "left_anti"
    )


def distinct_paths(train, val):
    return train.select("frame_path").union(val.select("frame_path")).distinct()


def oversample_class(files, existing, name="ball", factor=8):
    """Copies ``_os<name>_<k>`` of files that hold the class, skipping files already copied.

    ``files`` holds (stem, cls) of annotation lines; ``existing`` lists stems on disk.
    """
    mark = f"_os{name}"
    hold = files.where(F.col("cls") == BALL).select("stem").distinct()
    hold = hold.where(~F.contains("stem", F.lit(mark)))
    done = existing.where(F.endswith("stem", F.lit(f"{mark}_1"))).select(
        F.regexp_replace("stem", f"{mark}_1$", "").alias("stem")
    )
    return hold.join(done, "stem", "left_anti").select(
        "stem", F.explode(F.sequence(F.lit(1), F.lit(factor - 1))).alias("k")
    ).select("stem", F.concat("stem", F.lit(mark + "_"), F.col("k").cast("string")).alias("copy"))


def class_counts(lines):
    """Annotations per class, as reported next to oversampling."""
    return lines.groupBy("cls").agg(F.count("*").alias("n"))


def balance_visible(triplets):
    """Repeat visible sequences so that they are about as many as empty ones."""
    n = triplets.agg(
        F.count_if(F.col("visible")).alias("v"), F.count_if(~F.col("visible")).alias("e")
    )
    times = n.select(
        F.greatest(F.lit(1), F.bround(F.col("e") / F.greatest(F.col("v"), F.lit(1)), 0)).cast("int")
    ).scalar()
    rows = triplets.withColumn("times", F.when(F.col("visible"), times).otherwise(1))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def dedup_variants(images):
    """First file name of each frame number; files without a number are ignored."""
    rows = images.withColumn("num", paths.frame_tag("file")).where("num >= 0")
    return rows.groupBy("num").agg(F.min("file").alias("file"))


def ordered_frames(images):
    """De-duplicated frames numbered in frame order."""
    return numbered(dedup_variants(images), [], "num", "pos")


def label_sample(labels, n):
    """``n`` rows picked by a fixed scrambling of their position (for inspection)."""
    key = (F.col("ord") * 7919) % 10007
    return labels.withColumn("key", key).orderBy("key", "ord").limit(n).drop("key")


def detection_rate(labels):
    """Share of frames with a visible ball per game."""
    return labels.groupBy("game").agg(
        F.count_if(F.col("visibility") > 0).alias("detected"), F.count("*").alias("frames")
    ).withColumn("pct", rounded(F.col("detected") / F.greatest("frames", F.lit(1)) * d(100), 2))


def frame_range_slice(rows, start, count):
    """First ``count`` rows of each game from frame ``start`` on."""
    rows = rows.where(F.col("frame") >= start)
    return numbered(rows, ["game"], "frame", "row").where(F.col("row") <= count).drop("row")
