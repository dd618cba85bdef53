"""Tracking documents: one JSON record per stretch of frames, and one line per frame.

A document holds ``frames``, a map from frame number to the ball, the hoops and the
players of that frame.  A game may be split into any number of documents, which is how
long games stay splittable; a whole game in one multi-line file is read as well.
"""

from pyspark.sql import functions as F

from ..functions.geometry import center_x, center_y, trunc
from ..session import grouped_in_order

BOX = "center ARRAY<BIGINT>, box ARRAY<BIGINT>"
FRAME = (
    f"ball STRUCT<{BOX.replace(' ARRAY', ': ARRAY')}>, "
    f"hoops ARRAY<STRUCT<{BOX.replace(' ARRAY', ': ARRAY')}>>, "
    f"players ARRAY<STRUCT<tid: BIGINT, {BOX.replace(' ARRAY', ': ARRAY')}, team: BIGINT>>"
)
NESTED = FRAME.replace("ball STRUCT", "ball: STRUCT").replace("hoops ARRAY", "hoops: ARRAY").replace(
    "players ARRAY", "players: ARRAY"
)
DOCUMENT = (
    "video STRING, fps DOUBLE, frame_width INT, frame_height INT, total_frames BIGINT, "
    f"frames MAP<STRING, STRUCT<{NESTED}>>"
)
SIDES = ("x1", "y1", "x2", "y2")


def frame_records(balls, hoops, players, stretch=4096):
    """One nested record per frame, with the ``part`` of ``stretch`` frames it lies in.

    Objects cross one exchange, flat and whole parts to a task; records, and documents of them, are
    then grouped in the order the rows are sorted in.
    """
    flat = lambda df, kind, id_, team: df.select(
        "game", "frame", F.lit(kind).alias("kind"), id_.cast("bigint").alias("id"), team.cast("bigint").alias("team"),
        trunc(center_x()).alias("cx"), trunc(center_y()).alias("cy"), *[trunc(c).alias(c) for c in SIDES],
    )
    none = F.lit(None)
    rows = (
        flat(balls, 0, none, none)
        .unionByName(flat(hoops, 1, F.col("idx"), none))
        .unionByName(flat(players, 2, F.col("tid"), F.col("team")))
    )
    key = ["part", "game", "frame"]
    rows = rows.withColumn("part", F.floor(F.col("frame") / stretch)).repartition("part", "game").sortWithinPartitions(*key)
    boxed = [F.array("cx", "cy").alias("center"), F.array(*SIDES).alias("box")]
    of = lambda kind, *fields: F.when(F.col("kind") == kind, F.struct(*fields))
    # built before the grouping, where expressions compile
    rows = rows.select(
        *key,
        of(0, *boxed).alias("b"),
        of(1, F.col("id").alias("idx"), F.struct(*boxed).alias("v")).alias("h"),
        of(2, F.col("id").alias("tid"), *boxed, "team").alias("p"),
    )
    return rows.groupBy(*key).agg(
        F.max("b").alias("ball"), F.sort_array(F.collect_list("h")).alias("h"), F.sort_array(F.collect_list("p")).alias("players")
    ).select("game", "frame", "part", "ball", F.col("h.v").alias("hoops"), "players")


def write_frame_lines(records, path):
    """One JSON line per frame, nulls spelled out."""
    line = F.to_json(
        F.struct("game", "frame", "ball", "hoops", "players"), {"ignoreNullFields": "false"}
    )
    with grouped_in_order(records.sparkSession):
        records.select(line.alias("value")).write.text(path)


def documents(records, fps=60.0, width=1280, height=720):
    """A document for each part of a game, frames in order, so no record grows with the game."""
    entry = F.struct(F.col("frame").cast("string"), F.struct("ball", "hoops", "players"))
    key = ["part", "game"]
    rows = records.select(*key, "frame", entry.alias("entry")).sortWithinPartitions(*key, "frame")
    docs = rows.groupBy(*key).agg(
        F.map_from_entries(F.collect_list("entry")).alias("frames"), F.count("*").alias("total_frames")
    )
    return docs.select(
        F.concat(F.lit("game_"), F.col("game").cast("string")).alias("video"),
        F.lit(fps).alias("fps"),
        F.lit(width).alias("frame_width"),
        F.lit(height).alias("frame_height"),
        "total_frames",
        "frames",
    )


def write_documents(records, path, **head):
    docs = documents(records, **head)
    with grouped_in_order(records.sparkSession):
        docs.write.option("ignoreNullFields", "false").json(path)


def read_documents(spark, path, multi_line=False):
    """Frame records of tracking documents: (video, frame, ball, hoops, players)."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", multi_line).json(path)
    rows = docs.select("video", F.explode("frames").alias("frame", "v"))
    return rows.select("video", F.col("frame").cast("bigint").alias("frame"), "v.ball", "v.hoops", "v.players")


def read_objects(spark, path, multi_line=False):
    """All objects of tracking documents, one row each: video, kind, frame, id, cx, cy, x1, y1, x2, y2, team.

    ``id`` is 0 for the ball, the place in the frame for hoops and the track for players. A document is
    parsed once, whatever the number of kinds asked for; a filter on ``kind`` comes after that.
    """

    c = F.col
    size = lambda a: F.coalesce(F.when(c(a).isNotNull(), F.size(a)), F.lit(0))
    frames = read_documents(spark, path, multi_line)
    frames = frames.withColumns({"nb": c("ball").isNotNull().cast("int"), "nh": size("hoops"), "np": size("players")})
    # counted instead of transformed: positions and picks compile, lambdas do not
    every = frames.select("*", F.posexplode(F.array_repeat(F.lit(True), c("nb") + c("nh") + c("np"))).alias("i", "one"))
    h, p = c("i") - c("nb"), c("i") - c("nb") - c("nh")
    is_ball, is_hoop = h < 0, p < 0
    pick = lambda ball, hoop, player: F.when(is_ball, ball).when(is_hoop, hoop).otherwise(player)
    box = lambda o: F.struct(o["center"].alias("center"), o["box"].alias("box"))
    player = F.get("players", p)
    every = every.select(
        "video", "frame",
        pick(F.lit("ball"), F.lit("hoop"), F.lit("player")).alias("kind"),
        pick(F.lit(0).cast("bigint"), h.cast("bigint"), player["tid"]).alias("id"),
        pick(box(c("ball")), box(F.get("hoops", h)), box(player)).alias("o"),
        F.when(~is_ball & ~is_hoop, player["team"]).alias("team"),
    )
    at = lambda k, i: F.get(c("o")[k], F.lit(i))
    return every.select(
        "video", "frame", "kind", "id", at("center", 0).alias("cx"), at("center", 1).alias("cy"),
        *[at("box", i).alias(s) for i, s in enumerate(SIDES)], "team",
    )
