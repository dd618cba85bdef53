"""Session helpers: a tuned builder for local work and the shared work folder."""

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus="*", partitions=8, memory="8g"):
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("courtflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_folder(spark, name):
    """A fresh folder for written tables and stream state.

    On a cluster this lies under the shared ``spark.checkpoint.dir``; a
    machine-local folder is made only for a local master without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="courtflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def tune(spark):
    """Runtime SQL settings the operators are written for; other settings stay as they are."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Rows already hashed by (game, slice) may join on (game, flight, slice) in place.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


@contextmanager
def grouped_in_order(spark):
    """Groups of rows that are sorted by their keys already are aggregated in that order, in one pass.

    For what is written inside, as plans are made then; the setting is put back afterwards.
    """
    name = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df, name):
    """Write an intermediate table to the shared work folder and go on from there.

    Used where several consumers follow: the work is done once, the lineage is cut at
    files that outlive a lost executor, readers still prune columns, and the planner
    knows the real size when it picks a join.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
