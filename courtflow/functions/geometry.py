"""Column expressions on boxes, points and the court trapezoid."""

from pyspark.sql import functions as F

FRAME_W, FRAME_H = 1280, 720
# Corners of the court trapezoid as shares of the frame size.
COURT_LEFT, COURT_RIGHT, COURT_BOTTOM = 0.13, 0.87, 0.88
COURT_TOP_LEFT, COURT_TOP_RIGHT, COURT_TOP = 0.25, 0.75, 0.19


def col(c):
    return F.col(c) if isinstance(c, str) else c


def d(value):
    return F.lit(float(value))


def rounded(c, places):
    """Half-up rounding spelled so that other engines repeat it bit for bit."""
    scale = d(10**places)
    return F.floor(col(c) * scale + d(0.5)) / scale


def distance(x1, y1, x2, y2):
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def trunc(c):
    return col(c).cast("bigint")


def center_x(p=""):
    return (F.col(p + "x1") + F.col(p + "x2")) / d(2)


def center_y(p=""):
    return (F.col(p + "y1") + F.col(p + "y2")) / d(2)


def iou(a="a.", b="b."):
    """Intersection over union of two boxes; 0 where the union is not positive."""
    side = lambda lo, hi: F.greatest(
        F.lit(0), F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo))
    )
    area = lambda p: (F.col(p + "x2") - F.col(p + "x1")) * (F.col(p + "y2") - F.col(p + "y1"))
    inter = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter.cast("double") / union.cast("double")).otherwise(d(0))


def court_corners(w=FRAME_W, h=FRAME_H):
    """Bottom-left, bottom-right, top-right, top-left, cut to whole pixels."""
    return [
        (int(w * COURT_LEFT), int(h * COURT_BOTTOM)),
        (int(w * COURT_RIGHT), int(h * COURT_BOTTOM)),
        (int(w * COURT_TOP_RIGHT), int(h * COURT_TOP)),
        (int(w * COURT_TOP_LEFT), int(h * COURT_TOP)),
    ]


def in_court(x, y, w=FRAME_W, h=FRAME_H):
    """Point inside or on the trapezoid: four half-plane tests of a convex polygon."""
    x, y = col(x), col(y)
    corners = court_corners(w, h)
    inside = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        cross = d(bx - ax) * (y - d(ay)) - d(by - ay) * (x - d(ax))
        inside = inside & (cross <= 0)
    return inside


def in_court_column(x, y, w=FRAME_W, h=FRAME_H, slack=0.05):
    """Ball above or within the court: x inside the (interpolated) court span."""
    x, y = col(x), col(y)
    (blx, bly), (brx, _), (trx, try_), (tlx, _) = court_corners(w, h)
    pad = d(w * slack)
    share = (y - d(try_)) / d(bly - try_)
    left = F.when(y <= try_, d(tlx)).otherwise(d(tlx) + share * d(blx - tlx)) - pad
    right = F.when(y <= try_, d(trx)).otherwise(d(trx) + share * d(brx - trx)) + pad
    return (y <= d(bly + (bly - try_) * slack)) & (x >= left) & (x <= right)
