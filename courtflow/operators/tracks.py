"""Player tracks: overlaps, velocities, ghosts, re-identification, poses, summaries."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import center_x, center_y, d, distance, iou
from ..functions.slices import dealt, halo, own, per_slice, row_blocks, running, slice_of
from ..session import staged

# Fixed values of the track rules (frames, pixels).
OVERLAP_IOU = 0.40
POSE_IOU = 0.12
EXIT_DIST = 80
REID_FRAMES, REID_DIST = 600, 300
VELOCITY_ROWS = 5
GHOST_AGE = 30  # half a second at 60 frames/s
GHOSTS_PER_TASK = 1_000_000
PAIRS_PER_TASK = 2_000_000  # of a detection and a lost entry of one time bin


def meeting_boxes(a, b, extra=None, cell=128):
    """Pairs of boxes of one frame that intersect, as columns ``a.*`` and ``b.*``.

    Boxes are matched per grid cell rather than all against all within a frame; the
    cell that holds the top-left corner of the intersection reports the pair, so each
    pair comes out once.
    """
    span = lambda lo, hi: F.sequence(
        F.floor(F.col(lo) / cell).cast("int"), F.floor(F.col(hi) / cell).cast("int")
    )
    grid = lambda t: t.withColumn("gx", F.explode(span("x1", "x2"))).withColumn(
        "gy", F.explode(span("y1", "y2"))
    )
    c = F.col
    corner = (
        (F.floor(F.greatest("a.x1", "b.x1") / cell) == c("a.gx"))
        & (F.floor(F.greatest("a.y1", "b.y1") / cell) == c("a.gy"))
        & (F.greatest("a.x1", "b.x1") < F.least("a.x2", "b.x2"))
        & (F.greatest("a.y1", "b.y1") < F.least("a.y2", "b.y2"))
    )
    same = F.lit(True)
    for k in ("game", "frame", "gx", "gy"):
        same = same & (c(f"a.{k}") == c(f"b.{k}"))
    cond = same & corner if extra is None else same & corner & extra
    return grid(a).alias("a").join(grid(b).alias("b"), cond)


def pair_overlap(dets, least=OVERLAP_IOU):
    """In-frame pairs with an IoU of at least ``least``."""
    pairs = meeting_boxes(dets, dets, F.col("a.seq") < F.col("b.seq")).withColumn("iou", iou())
    return pairs.where(F.col("iou") >= least).select(
        F.col("a.game").alias("game"),
        F.col("a.frame").alias("frame"),
        F.col("a.seq").alias("seq_a"),
        F.col("b.seq").alias("seq_b"),
        F.col("a.tid").alias("tid_a"),
        F.col("b.tid").alias("tid_b"),
        "iou",
    )


def track_velocity(dets, rows_back=VELOCITY_ROWS):
    """Mean velocity of each track over its last five sightings; 0 with fewer than two."""
    rows = dets.select("game", "tid", "frame", center_x().alias("cx"), center_y().alias("cy"))
    rows = row_blocks(rows, ["game", "tid"], before=rows_back - 1)
    w = Window.partitionBy("game", "tid", "block").orderBy("idx").rowsBetween(1 - rows_back, 0)
    dt = F.col("frame") - F.first("frame").over(w)
    speed = lambda c: F.when(dt > 0, (F.col(c) - F.first(c).over(w)) / dt).otherwise(d(0))
    rows = rows.withColumns({"vx": speed("cx"), "vy": speed("cy")})
    return own(rows).select("game", "tid", "frame", "cx", "cy", "vx", "vy")


def _track_pairs(dets):
    pairs = pair_overlap(dets)
    return pairs.select(
        "game",
        "frame",
        F.least("tid_a", "tid_b").alias("tid_a"),
        F.greatest("tid_a", "tid_b").alias("tid_b"),
    ).distinct()


def ended_pairs(dets):
    """Pairs that overlapped in the frame before and no longer do."""
    pairs = _track_pairs(dets)
    before = pairs.withColumn("frame", F.col("frame") + 1)
    return before.exceptAll(pairs)


def overlap_episodes(dets):
    """Runs of consecutive frames in which two tracks overlap, with their velocities at the start."""
    pair = ["game", "tid_a", "tid_b"]
    w = Window.partitionBy(*pair, "slice").orderBy("frame")
    rows = halo(_track_pairs(dets), before=1)
    fresh = F.coalesce(F.lag("frame").over(w) != F.col("frame") - 1, F.lit(True))
    rows = own(rows.withColumn("fresh", fresh))
    rows = running(
        rows, pair, ["frame"], {"start": ("last", F.when(F.col("fresh"), F.col("frame")))}
    )
    runs = rows.groupBy(*pair, "start").agg(F.max("frame").alias("end"))
    speed = track_velocity(dets)
    for side in ("a", "b"):
        at = speed.select(
            "game",
            F.col("tid").alias(f"tid_{side}"),
            F.col("frame").alias("start"),
            F.col("vx").alias(f"vx_{side}"),
            F.col("vy").alias(f"vy_{side}"),
        )
        runs = runs.join(at, ["game", f"tid_{side}", "start"], "left")
    return runs


def exit_match(dets, episodes, reach=EXIT_DIST):
    """Who took over a track that is missing right after an overlap ended.

    The missing track is expected at its last place moved by its velocity at the start
    of the overlap; the first detection nearby inherits its identity.  If several
    overlaps of a track end at once, the one that began last counts.  A detection inherits
    one identity only: the smallest of the tracks it could stand for.
    """
    side = lambda s: episodes.select(
        "game", F.col(f"tid_{s}").alias("tid"), "start", "end",
        F.col(f"vx_{s}").alias("vx"), F.col(f"vy_{s}").alias("vy"),
    )
    member = side("a").unionByName(side("b"))
    member = member.groupBy("game", "tid", "end").agg(
        F.max(F.struct("start", "vx", "vy")).alias("m")
    ).select("game", "tid", "end", F.col("m.vx").alias("vx"), F.col("m.vy").alias("vy"))
    place = dets.select("game", "tid", F.col("frame").alias("end"), center_x().alias("px"), center_y().alias("py"))
    gone = member.join(place, ["game", "tid", "end"]).withColumn("frame", F.col("end") + 1)
    gone = gone.join(dets.select("game", "tid", "frame"), ["game", "tid", "frame"], "left_anti")
    near = gone.join(
        dets.select("game", "frame", "seq", F.col("tid").alias("new_tid"),
                    center_x().alias("cx"), center_y().alias("cy")),
        ["game", "frame"],
    ).where(distance("cx", "cy", F.col("px") + F.col("vx"), F.col("py") + F.col("vy")) < reach)
    heir = near.groupBy("game", "frame", "tid").agg(F.min_by("new_tid", "seq").alias("new_tid"))
    return heir.groupBy("game", "frame", "new_tid").agg(F.min("tid").alias("tid")).select(
        "game", "frame", "tid", "new_tid"
    )


def _with_next(dets, reach, tasks=None):
    """Each sighting with the track's next one, if that lies within ``reach`` frames; in ``tasks`` parts, if given."""
    w = Window.partitionBy("game", "tid", "slice").orderBy("frame")
    rows = halo(dets, after=reach)
    if tasks is not None:
        rows = rows.repartition(tasks, "game", "tid", "slice")
    rows = rows.withColumn("next", F.lead("frame").over(w))
    last = per_slice(dets, ["game"], "frame", last=F.max("frame"))
    return own(rows).join(last, ["game", "slice"]).drop("slice")


def ghost_tracks(dets, max_age=GHOST_AGE):
    """Ghost rows of a track for up to ``max_age`` frames after it was last seen.

    A sighting becomes up to ``max_age`` rows, so tasks are dealt by the rows to come, not by those read.
    """
    tasks = dealt(dets.count() * max_age, GHOSTS_PER_TASK)
    rows = _with_next(dets.select("game", "frame", "tid", "x1", "y1", "x2", "y2"), max_age + 1, tasks)
    until = F.least(F.col("next") - 1, F.col("frame") + max_age, F.col("last"))
    rows = rows.withColumn("until", until).where(F.col("until") > F.col("frame"))
    at = F.explode(F.sequence(F.col("frame") + 1, F.col("until")))
    rows = rows.withColumn("ghost_frame", at)
    return rows.select(
        "game", F.col("ghost_frame").alias("frame"), "tid", "x1", "y1", "x2", "y2",
        (F.col("ghost_frame") - F.col("frame")).alias("age"),
    )


def lost_registry(dets, keep=REID_FRAMES):
    """Places where tracks were lost, and until which frame they may be taken over."""
    gone = F.col("next").isNull() | (F.col("next") > F.col("frame") + 1)
    rows = _with_next(dets, 1).where(gone & (F.col("frame") < F.col("last")))
    return rows.select(
        "game", "tid", (F.col("frame") + 1).alias("lost_frame"),
        center_x().alias("cx"), center_y().alias("cy"),
        (F.col("frame") + 1 + keep).alias("expires"),
    )


def _open_until(lost, keep=REID_FRAMES):
    """A lost entry ends at its expiry or when the same track is lost anew."""
    w = Window.partitionBy("game", "tid", "slice").orderBy("lost_frame")
    rows = halo(lost, "lost_frame", after=keep)
    rows = own(rows.withColumn("again", F.lead("lost_frame").over(w))).drop("slice")
    return rows.withColumn("until", F.least("expires", "again")).drop("again")


def reid_candidates(dets, lost, reach=REID_DIST, keep=REID_FRAMES):
    """First frame at which each track comes within ``reach`` of each lost entry.

    Later frames of the same pair cannot change the outcome: at the first one either the
    track takes something over or the entry is gone.  An entry lies in the time bin (as long as an
    entry lives) in which it was lost and a detection is handed to its own bin and the one before, so all that an
    entry meets is found in one bin; inside, they are matched by grid cells as wide as the reach.
    Bins are dealt to tasks by the pairs in them.
    """
    grid = lambda c: F.floor(F.col(c) / reach).cast("int")
    at = slice_of("frame", keep)
    seen = dets.select(
        "game", "tid", "frame", "seq", center_x().alias("x"), center_y().alias("y")
    ).withColumn("bin", F.explode(F.array(at, at - 1)))
    entry = staged(
        _open_until(lost, keep).withColumnRenamed("tid", "old_tid").withColumn("bin", slice_of("lost_frame", keep)),
        "open-entries",
    )
    sizes = seen.groupBy("game", "bin").agg(F.count("*").alias("n")).join(
        entry.groupBy("game", "bin").agg(F.count("*").alias("m")), ["game", "bin"]
    )
    pairs = sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    tasks = dealt(pairs or 0, PAIRS_PER_TASK)
    near = lambda c: F.explode(F.sequence(grid(c) - 1, grid(c) + 1))
    seen = seen.repartition(tasks, "game", "bin").withColumns({"gx": grid("x"), "gy": grid("y")})
    entry = entry.repartition(tasks, "game", "bin").withColumn("gx", near("cx")).withColumn("gy", near("cy"))
    gap = distance("x", "y", "cx", "cy")
    hits = seen.join(entry, ["game", "bin", "gx", "gy"]).where(
        (F.col("frame") > F.col("lost_frame")) & (F.col("frame") <= F.col("until")) & (gap < reach)
    )
    return hits.groupBy("game", "bin", "tid", "old_tid", "lost_frame").agg(
        F.min("frame").alias("frame"), F.min_by("seq", "frame").alias("seq"), F.min_by(gap, "frame").alias("gap")
    ).drop("bin")


def _number_contacts(dets, lost, locks, keep=REID_FRAMES):
    """First frame at which a track and a lost entry are known to wear the same number."""
    num = locks.select("game", "tid", "num", "lock_frame")
    entry = _open_until(lost, keep).withColumnRenamed("tid", "old_tid")
    entry = entry.join(
        num.select("game", F.col("tid").alias("old_tid"), "num", F.col("lock_frame").alias("old_lock")),
        ["game", "old_tid"],
    ).withColumn("bin", F.explode(F.sequence(
        F.floor((F.col("lost_frame") + 1) / keep).cast("bigint"),
        F.floor(F.col("until") / keep).cast("bigint"))))
    seen = dets.join(num, ["game", "tid"]).where(F.col("frame") > F.col("lock_frame"))
    seen = seen.select("game", "tid", "num", "frame", "seq", slice_of("frame", keep).alias("bin"))
    hits = seen.join(entry, ["game", "num", "bin"]).where(
        (F.col("frame") > F.greatest("lost_frame", "old_lock")) & (F.col("frame") <= F.col("until"))
    )
    return hits.groupBy("game", "tid", "old_tid", "lost_frame").agg(
        F.min("frame").alias("frame"), F.min_by("seq", "frame").alias("seq")
    ).withColumn("gap", F.lit(None).cast("double"))


def take_over(contacts):
    """Walk one group's contacts in order; each track and each entry is used once.

    A known equal number beats any distance; entries of a number are tried oldest first,
    others nearest first.
    """
    taken, done, out = set(), set(), []
    rows = [
        (c.frame, c.seq, c.tid, c.gap if c.gap == c.gap else -1.0, c.lost_frame, c.old_tid, c.game)
        for c in contacts.itertuples()
    ]
    for frame, _, tid, _, lost_frame, old_tid, game in sorted(rows):
        if tid not in done and (old_tid, lost_frame) not in taken:
            done.add(tid)
            taken.add((old_tid, lost_frame))
            out.append((game, tid, frame, old_tid, lost_frame))
    return out


def _first_contacts(contacts):
    """One contact per track and entry: the earliest, by number before by distance on one frame."""
    first = F.min(F.struct("frame", F.coalesce("gap", d(-1)).alias("gap"), "seq")).alias("c")
    rows = contacts.groupBy("game", "tid", "old_tid", "lost_frame").agg(first)
    return rows.select(
        "game", "tid", "old_tid", "lost_frame", "c.frame", "c.seq", F.expr("nullif(c.gap, -1D)").alias("gap")
    )


def _contacts_that_count(dets, lost, locks, first=REID_FRAMES, grow=8):
    """Contacts of each track from its beginning on, until there are as many as tracks in its game or it ends.

    Detections are taken stretch by stretch of a track's life, each ``grow`` times as long as all before, and only
    of tracks that have not met enough entries yet; so contacts written grow with those needed, and there are few stretches.
    """
    dets, lost = dets.select("game", "frame", "seq", "tid", "x1", "y1", "x2", "y2"), staged(lost, "lost")
    lives = dets.groupBy("game", "tid").agg(F.min("frame").alias("born"), F.max("frame").alias("end"))
    rivals = lives.groupBy("game").agg(F.count("*").alias("rivals"))
    lives = staged(lives.join(rivals, "game"), "lives")
    found, asked, lo, hi = None, lives, 0, first
    while True:
        life = asked.select("game", "tid", "born")
        age = F.col("frame") - F.col("born")
        some = dets.join(life, ["game", "tid"]).where((age >= lo) & (age < hi)).drop("born")
        some = staged(some, "stretch")
        bins = some.select("game", F.floor(F.col("frame") / REID_FRAMES).alias("bin"))
        bins = bins.unionByName(bins.withColumn("bin", F.col("bin") - 1)).distinct()
        # an entry lives for as long as a bin; the next loss of its track may cut it, so those of the bin after count as well
        bins = bins.unionByName(bins.withColumn("bin", F.col("bin") + 1)).distinct()
        near = lost.withColumn("bin", F.floor(F.col("lost_frame") / REID_FRAMES)).join(bins, ["game", "bin"], "left_semi")
        near = near.drop("bin")
        new = reid_candidates(some, near)
        if locks is not None:
            new = new.unionByName(_number_contacts(some, near, locks))
        new = staged(_first_contacts(new), "contacts")
        found = new if found is None else staged(_first_contacts(found.unionByName(new)), "contacts")
        met = found.groupBy("game", "tid").agg(F.count("*").alias("met"))
        asked = lives.where(F.col("end") - F.col("born") >= hi).join(met, ["game", "tid"], "left")
        asked = staged(asked.where(F.coalesce("met", F.lit(0)) < F.col("rivals")).drop("met"), "unmet")
        if asked.isEmpty():
            return found
        lo, hi = hi, hi * grow


def reid_match(dets, lost, locks=None):
    """Which lost track each track takes over: (game, tid, frame, old_tid, lost_frame).

    The choice is sequential, but only the first contact of a track with an entry matters: there
    either the track takes something over or the entry is gone for it.  A track fails at a
    contact only if another track has taken that entry, and every other track takes one
    at most; so among its contacts with as many different entries as there are tracks one must
    succeed, and later ones can be left out without loss.  The rest is cut into groups at
    frames that no track's and no entry's contacts span; each group is walked on its own.
    """
    contacts = _contacts_that_count(dets, lost, locks)
    rivals = per_slice(contacts, ["game"], "frame", rivals=F.count_distinct("tid"))
    w = Window.partitionBy("game", "tid").orderBy("frame")
    contacts = contacts.withColumns({"rk": F.rank().over(w), "slice": slice_of("frame")})
    contacts = contacts.join(rivals, ["game", "slice"])
    contacts = staged(
        contacts.where(F.col("rk") <= F.col("rivals")).drop("rk", "rivals", "slice"), "first-contacts"
    )

    span = lambda keys: contacts.groupBy("game", *keys).agg(
        F.min("frame").alias("lo"), F.max("frame").alias("hi")
    )
    tracks = span(["tid"])
    entries = span(["old_tid", "lost_frame"])
    spans = tracks.select("game", "lo", "hi", "tid").unionByName(
        entries.select("game", "lo", "hi", F.lit(None).cast("bigint").alias("tid"))
    ).withColumn("slice", slice_of("lo"))
    order = ["lo", "hi", "tid"]
    spans = running(spans, ["game"], order, {"reach": ("prevmax", F.col("hi"))})
    cut = F.col("reach").isNull() | (F.col("reach") < F.col("lo"))
    spans = running(spans, ["game"], order, {"run": ("last", F.when(cut, F.col("lo")))})
    runs = spans.where("tid IS NOT NULL").select("game", "tid", "run")

    def walk(pdf):
        return pd.DataFrame(take_over(pdf), columns=["game", "tid", "frame", "old_tid", "lost_frame"])

    return contacts.join(runs, ["game", "tid"]).groupBy("game", "run").applyInPandas(
        walk, "game bigint, tid bigint, frame bigint, old_tid bigint, lost_frame bigint"
    )


def identities(matches):
    """The identity that each take-over ends in: (game, tid, frame, identity).

    A taken-over track may have taken over another before it was lost; such chains run back
    in time, so they end, and are followed by doubling: a chain of n links takes log2(n) rounds.
    """
    m = matches.select("game", "tid", "frame", "old_tid", "lost_frame")
    older = m.select("game", F.col("tid").alias("old_tid"), F.col("frame").alias("since"))
    rows = m.join(older, ["game", "old_tid"], "left")
    rows = rows.select(
        "game", "tid", "frame", F.col("old_tid").alias("identity"),
        F.when(F.col("since") < F.col("lost_frame"), F.col("old_tid")).alias("next"),
    )
    rows = staged(rows, "identities")
    while not rows.where("next IS NOT NULL").isEmpty():
        then = rows.select(
            "game", F.col("tid").alias("next"), F.col("identity").alias("then"), F.col("next").alias("after")
        )
        rows = rows.join(then, ["game", "next"], "left").select(
            "game", "tid", "frame", F.coalesce("then", "identity").alias("identity"), F.col("after").alias("next")
        )
        rows = staged(rows, "identities")
    return rows.drop("next")


def apply_identities(dets, matches):
    """Detections with the identity they stand for from the frame of the take-over on."""
    known = identities(matches).withColumnRenamed("frame", "since")
    rows = dets.join(known, ["game", "tid"], "left")
    taken = F.col("frame") >= F.col("since")
    return rows.withColumn("identity", F.when(taken, F.col("identity")).otherwise(F.col("tid"))).drop("since")


def pose_player_match(poses, players, referees):
    """The player each pose belongs to: best IoU above 0.12 and above every referee's.

    The first player wins a tie, and a later pose replaces an earlier one of the same player.
    """
    def overlaps(boxes, how):
        rows = meeting_boxes(poses.withColumnRenamed("pose", "seq"), boxes).withColumn("iou", iou())
        pick = [F.col("a.game").alias("game"), F.col("a.frame").alias("frame"), F.col("a.seq").alias("pose")]
        return rows.select(*pick, "iou", *how)

    mine = overlaps(players, [F.col("b.seq").alias("seq"), F.col("b.tid").alias("tid")])
    mine = mine.where(F.col("iou") > POSE_IOU).groupBy("game", "frame", "pose").agg(
        F.max_by(F.struct("tid", "iou"), F.struct("iou", -F.col("seq"))).alias("best")
    )
    theirs = overlaps(referees, []).groupBy("game", "frame", "pose").agg(F.max("iou").alias("ref_iou"))
    rows = mine.join(theirs, ["game", "frame", "pose"], "left")
    rows = rows.where(F.col("best.iou") > F.coalesce("ref_iou", d(0)))
    rows = rows.select("game", "frame", F.col("best.tid").alias("tid"), "pose", F.col("best.iou").alias("iou"))
    return rows.groupBy("game", "frame", "tid").agg(
        F.max("pose").alias("pose"), F.max_by("iou", "pose").alias("iou")
    )


def summary_parts(dets, locks, poses, balls):
    """One row per detection, pose and ball with what it adds to its frame's counts."""
    known = dets.join(locks.select("game", "tid", "lock_frame"), ["game", "tid"], "left")
    one, none = F.lit(1), F.lit(0)
    part = lambda t, **v: t.select(
        "game", "frame", *[v.get(k, none).alias(k) for k in ("players", "numbers", "poses", "balls")]
    )
    worn = F.coalesce(F.col("lock_frame") < F.col("frame"), F.lit(False)).cast("int")
    return (
        part(known, players=one, numbers=worn)
        .unionByName(part(poses, poses=one))
        .unionByName(part(balls, balls=one))
    )


def frame_summary(dets, locks, poses, balls):
    """Players, known numbers, poses and ball per frame: one union, one aggregation."""
    rows = summary_parts(dets, locks, poses, balls)
    per = rows.groupBy("game", "frame").agg(*[F.sum(k).alias(k) for k in ("players", "numbers", "poses", "balls")])
    return per.select(
        "game", "frame", "players", "numbers", "poses", (F.col("balls") > 0).alias("ball"),
        (F.col("frame") % 30 == 0).alias("progress"),
    )
