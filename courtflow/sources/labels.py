"""Label tables, disagreement tables, polygon files, review sets and snapshots."""

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.geometry import d
from . import commits

LABEL_CSV = "ord BIGINT, frame_path STRING, visibility BIGINT, x DOUBLE, y DOUBLE"
DISAGREEMENT_CSV = (
    "ord BIGINT, frame_path STRING, label_x DOUBLE, label_y DOUBLE, pred_x DOUBLE, pred_y DOUBLE, "
    "pred_conf DOUBLE, distance_px DOUBLE, split STRING, category STRING"
)


def _columns(ddl):
    return [c.strip().split()[0] for c in ddl.split(",")]


def write_labels(labels, path):
    """Label CSVs, one folder per split; ``ord`` keeps the file order."""
    labels.select("split", *_columns(LABEL_CSV)).write.partitionBy("split").csv(path, header=True)


def read_labels(spark, path, split=None):
    """Label CSVs; hidden rows get the coordinates -1.  ``split`` prunes the other folders."""
    rows = spark.read.schema(LABEL_CSV + ", split STRING").csv(path, header=True)
    rows = rows if split is None else rows.where(F.col("split") == split)
    hidden = F.col("visibility") == 0
    return rows.withColumns(
        {c: F.when(hidden, d(-1)).otherwise(F.col(c)) for c in ("x", "y")}
    )


def write_disagreements(rows, path):
    """Disagreement CSVs in folders per split and category."""
    rows.select(*_columns(DISAGREEMENT_CSV)).write.partitionBy("split", "category").csv(path, header=True)


def read_disagreements(spark, path, split=None, category=None):
    rows = spark.read.schema(DISAGREEMENT_CSV).csv(path, header=True)
    for name, value in (("split", split), ("category", category)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def write_packed_polygons(lines, path):
    """Polygon lines packed into few files: image name, line number, annotation."""
    packed = F.concat_ws("\t", "file", F.col("line_no").cast("string"), "line")
    lines.select(packed.alias("value")).write.text(path)


def _polygon_columns():
    parts = F.split(F.trim("line"), r"\s+")
    return [
        parts[0].try_cast("bigint").alias("cls"),
        F.transform(F.slice(parts, 2, F.size(parts)), lambda v: v.try_cast("double")).alias("coords"),
    ]


def read_polygons(spark, path, packed=False):
    """Polygon annotations as (file, line_no, cls, coords).

    Either one text file per image, named after it, or lines packed by
    ``write_packed_polygons`` (the form for many images).
    """
    if packed:
        cell = F.split("value", "\t")
        rows = spark.read.text(path).select(
            cell[0].alias("file"), cell[1].cast("bigint").alias("line_no"), cell[2].alias("line")
        )
    else:
        text = spark.read.text(path, wholetext=True)
        rows = text.select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", ".jpg").alias("file"),
            F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"),
        ).withColumn("line_no", F.col("line_no").cast("bigint"))
    rows = rows.where(F.trim("line") != "")
    return rows.select("file", "line_no", *_polygon_columns())


def _review_columns(path):
    p = paths.unix_path(path)
    return [
        F.regexp_extract(p, r"([^/]+)/[^/]+/[^/]+$", 1).alias("category"),
        paths.game_of(path).alias("folder"),
        paths.file_stem(path).alias("stem"),
    ]


def read_review_tree(spark, path):
    """Images left in ``{category}/{game}/{stem}.jpg`` folders; their content is not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.jpg")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select(*_review_columns("path")).distinct()


def read_review_listing(spark, path):
    """The same from a written listing of paths, one per line (object-store inventories)."""
    rows = spark.read.text(path).where(F.col("value").endswith(".jpg"))
    return rows.select(*_review_columns("value")).distinct()


def read_review_list(spark, path):
    """``game/stem`` lines; blank lines, comments and lines without a game are skipped."""
    line = paths.unix_path(F.trim("value"))
    rows = spark.read.text(path).select(line.alias("line"))
    rows = rows.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit("/")))
    return rows.select(
        paths.game_of("line").alias("folder"), paths.file_stem("line").alias("stem")
    ).distinct()


def write_snapshot(labels, path, snapshot):
    """Keep a copy of a label table under a snapshot id, visible once it is whole; a retry replaces its own."""
    commits.commit({"labels": labels}, path, snapshot)


def read_snapshots(spark, path, schema):
    """All snapshots; ``schema`` ends in the column snapshot."""
    columns = schema.rpartition(",")[0]
    return commits.read(spark, path, "labels", columns).withColumnRenamed("version", "snapshot")


def read_latest_snapshot(spark, path, schema):
    """The newest snapshot (ids sort by time), found by the manifests; ``schema`` without the column snapshot."""
    return commits.read_latest(spark, path, "labels", schema)


def latest_snapshot(snapshots):
    """Rows of the newest snapshot (ids sort by time); empty when there is none."""
    newest = snapshots.agg(F.max("snapshot")).scalar()
    return snapshots.where(F.col("snapshot") == newest)
