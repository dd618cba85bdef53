"""Accuracy of predicted ball positions and shape of prediction heatmaps."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import d, distance, rounded

PE_DIST, PE_CONF = 5.0, 0.5
PEAK_LEAST, PEAK_SHARE = 0.1, 0.5


def pe_metrics(labels, preds, dist=PE_DIST, conf=PE_CONF):
    """Hits, misses, precision, recall and F1 per game and overall.

    A prediction too far off counts as both a false positive and a false negative.
    ``labels`` holds (game, frame, gx, gy), null where there is no ball.
    Counted per game first; the overall row is built from those few rows.
    """
    sure = preds.where(F.col("conf") >= conf).select("game", "frame", "pred_x", "pred_y")
    rows = labels.join(sure, ["game", "frame"], "left")
    label, pred = F.col("gx").isNotNull(), F.col("pred_x").isNotNull()
    hit = label & pred & (distance("gx", "gy", "pred_x", "pred_y") <= dist)
    per = rows.groupBy("game").agg(
        F.count_if(hit).alias("tp"),
        F.count_if(pred & ~F.coalesce(hit, F.lit(False))).alias("fp"),
        F.count_if(label & ~F.coalesce(hit, F.lit(False))).alias("fn"),
    )
    total = per.rollup("game").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(d(0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = total.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    p, q = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", ratio(d(2) * p * q, p + q))
    return out.withColumns({c: rounded(c, 6) for c in ("precision", "recall", "f1")})


def with_peak(cells, keys=("vec_id",)):
    """Cells of each heatmap beside its peak (first in row order on a tie).

    A heatmap has a fixed number of cells, so the window per heatmap is bounded; the
    aggregations that follow use the same partitioning.
    """
    w = Window.partitionBy(*keys)
    peak = F.max(F.struct("p", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).over(w)
    rows = cells.withColumn("peak", peak)
    return rows.select(
        *cells.columns,
        F.col("peak.p").alias("peak_p"),
        (-F.col("peak.nx")).alias("peak_x"),
        (-F.col("peak.ny")).alias("peak_y"),
    )


def _inside(radius):
    return (F.abs(F.col("x") - F.col("peak_x")) <= radius) & (F.abs(F.col("y") - F.col("peak_y")) <= radius)


def peak_margin(cells, radius=10, keys=("vec_id",)):
    """Peak minus the highest value outside the window around it, per heatmap."""
    rows = with_peak(cells, keys)
    other = F.coalesce(F.max(F.when(~_inside(radius), F.col("p"))), d(0))
    return rows.groupBy(*keys).agg(F.max("peak_p").alias("peak"), other.alias("other")).select(
        *keys, (F.col("peak") - F.col("other")).alias("margin")
    )


def peak_centroid(cells, radius=10, keys=("vec_id",)):
    """Weighted centre of the cells around each peak that reach half of it."""
    rows = with_peak(cells, keys).where(F.col("peak_p") >= PEAK_LEAST)
    rows = rows.where(_inside(radius) & (F.col("p") >= d(PEAK_SHARE) * F.col("peak_p")))
    mean = lambda c: F.sum(F.col(c) * F.col("p")) / F.sum("p")
    return rows.groupBy(*keys).agg(mean("x").alias("cx"), mean("y").alias("cy"), F.max("peak_p").alias("conf"))
