"""Versions of tables that appear as a whole or not at all.

A version may hold several tables. Each attempt writes their files into a folder of its own, and last of all a manifest of
one row per table: version, attempt, table, time. Readers start from the manifests, so a write that was killed, or is still
going on, cannot be seen, a version written again replaces the one before it in one step, and the newest version is found without
looking at any data. Nothing is moved or deleted; folders that no manifest names are left-overs.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

_MANIFEST = "version STRING, attempt STRING, name STRING, at TIMESTAMP"


def commit(tables, path, version):
    """Write ``tables`` ({name: rows}) under ``path`` as ``version``; they become visible together."""
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/data/{attempt}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = spark.createDataFrame([(version, attempt, name) for name in tables], "version STRING, attempt STRING, name STRING")
    # one file: it appears when Spark commits it
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/manifests")


def versions(spark, path):
    """The attempt that counts for each version: version, attempt, names; one row per version, by version."""
    try:
        manifests = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests")
    except AnalysisException:  # nothing was ever committed
        manifests = spark.createDataFrame([], _MANIFEST)
    each = manifests.groupBy("version", "attempt").agg(F.min("at").alias("at"), F.collect_set("name").alias("names"))
    last = F.max(F.struct("at", "attempt", "names")).alias("m")
    return each.groupBy("version").agg(last).select("version", "m.attempt", "m.names").orderBy("version")


def _folder(path, attempt, name):
    return f"{path}/data/{attempt}/{name}"


def read(spark, path, name, schema):
    """All versions of a table, with the column version."""
    rows = [r for r in versions(spark, path).collect() if name in r.names]
    out = spark.createDataFrame([], f"{schema}, version STRING")
    for r in rows:  # as many as there are versions
        given = spark.read.schema(schema).parquet(_folder(path, r.attempt, name))
        out = out.unionByName(given.withColumn("version", F.lit(r.version)))
    return out


def read_latest(spark, path, name, schema):
    """The table of the newest version (ids sort by time) that has it; empty when there is none. Only its files are read."""
    newest = versions(spark, path).where(F.array_contains("names", name)).orderBy(F.desc("version")).first()
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_folder(path, newest.attempt, name))
