"""Sliced windows equal windows over whole keys, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from courtflow.functions import slices
from courtflow.functions.slices import halo, numbered, own, row_blocks, running, slice_of


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    frames = sorted(rnd.sample(range(3000), 900))
    data = [(0 if rnd.random() < 0.7 else rnd.randrange(1, 4), f, rnd.random() if rnd.random() < 0.6 else None) for f in frames]
    return spark.createDataFrame(data, "k bigint, frame bigint, v double").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("size,group", [(7, 1024), (7, 5), (64, 3), (100000, 1)])
def test_running(rows, size, group, monkeypatch):
    """Carries over one level and over two, when slices outnumber a group."""
    monkeypatch.setattr(slices, "SLICES", group)
    w = Window.partitionBy("k").orderBy("frame")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "k", "frame",
        F.count("v").over(upto).alias("n"),
        F.min("v").over(upto).alias("lo"),
        F.last("v", True).over(upto).alias("l"),
        F.last("v", True).over(before).alias("p"),
        F.max("v").over(before).alias("pm"),
    )
    v = F.col("v")
    specs = {"n": ("count", v), "lo": ("min", v), "l": ("last", v), "p": ("prev", v), "pm": ("prevmax", v)}
    got = running(rows.withColumn("slice", slice_of("frame", size)), ["k"], ["frame"], specs)
    same(got.select("k", "frame", *specs), want)


@pytest.mark.parametrize("size", [16, 50])
def test_halo(rows, size):
    w = Window.partitionBy("k").orderBy("frame").rangeBetween(-9, 5)
    want = rows.select("k", "frame", F.count("v").over(w).alias("n"))
    v = Window.partitionBy("k", "slice").orderBy("frame").rangeBetween(-9, 5)
    got = own(halo(rows, before=9, after=5, size=size).withColumn("n", F.count("v").over(v)))
    same(got.select("k", "frame", "n"), want)


def test_row_blocks(rows):
    w = Window.partitionBy("k").orderBy("frame").rowsBetween(-6, 0)
    want = rows.select("k", "frame", F.count("v").over(w).alias("n"))
    v = Window.partitionBy("k", "block").orderBy("idx").rowsBetween(-6, 0)
    cut = row_blocks(rows, ["k"], before=6, size=25)
    got = own(cut.withColumn("n", F.count("v").over(v)))
    same(got.select("k", "frame", "n"), want)
    assert cut.groupBy("k", "block").count().agg(F.max("count")).first()[0] <= 25 + 6


def test_numbered_without_key(rows):
    got = numbered(rows, [], "frame", "pos", size=11).orderBy("frame")
    assert [r.pos for r in got.collect()] == list(range(1, 901))


def test_running_without_keys_counts_over_groups(rows, monkeypatch):
    monkeypatch.setattr(slices, "SLICES", 3)
    one = rows.dropDuplicates(["frame"])
    want = one.select("frame", F.row_number().over(Window.orderBy("frame")).cast("bigint").alias("i"))
    same(numbered(one.select("frame"), [], "frame", "i", size=20).select("frame", "i"), want)


def test_a_value_per_game_is_joined_slice_by_slice(spark):
    """No exchange of all rows hashed by the game alone."""
    from courtflow.operators import labels, tracks

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dets = spark.range(9000).selectExpr(
            "id % 2 AS game", "id AS frame", "id AS seq", "id % 3 AS tid", "1 AS x1", "1 AS y1", "2 AS x2", "2 AS y2"
        )
        files = spark.range(9000).selectExpr("id % 2 AS game", "id AS ord", "'a' AS stem")
        for df in (tracks.ghost_tracks(dets), tracks.lost_registry(dets), labels.split_tail(files)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            for at, line in enumerate(lines):
                if "Exchange hashpartitioning(game" in line and line.split("hashpartitioning(")[1].count(",") == 1:
                    assert "HashAggregate" in lines[at + 1], plan
        held = labels.split_tail(files).where("split = 'val'").groupBy("game").count().collect()
        assert {r["count"] for r in held} == {int(4500 * labels.VAL_SHARE)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
