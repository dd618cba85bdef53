"""Versions of tables: whole or not at all."""

import os

import pytest

from courtflow.sources import commits

ROW = "a BIGINT, b STRING"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ROW).repartition(2)


def test_versions_are_replaced_and_found(spark, tmp_path):
    path = str(tmp_path / "tables")
    assert commits.read_latest(spark, path, "x", ROW).count() == 0 and commits.read(spark, path, "x", ROW).count() == 0
    commits.commit({"x": table(spark, (1, "old"))}, path, "v1")
    commits.commit({"x": table(spark, (2, "new"), (3, None)), "y": table(spark)}, path, "v2")
    commits.commit({"x": table(spark, (4, "again"))}, path, "v1")
    assert [r.a for r in commits.read(spark, path, "x", ROW).where("version = 'v1'").collect()] == [4]
    newest = commits.read_latest(spark, path, "x", ROW)
    assert sorted(r.a for r in newest.collect()) == [2, 3]
    # only the files of that attempt are read
    attempt = {r.version: r.attempt for r in commits.versions(spark, path).collect()}["v2"]
    assert all(f"/{attempt}/x/" in f for f in newest.inputFiles())
    assert commits.read_latest(spark, path, "y", ROW).count() == 0 and commits.read_latest(spark, path, "z", ROW).count() == 0


def test_a_write_killed_half_way_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "tables")
    commits.commit({"x": table(spark, (1, "whole")), "y": table(spark, (1, "whole"))}, path, "v1")
    broken = table(spark, (2, "half")).selectExpr("a", "CAST(raise_error('killed') AS STRING) AS b")
    with pytest.raises(Exception, match="killed"):  # the first table is written, the second one is not
        commits.commit({"x": table(spark, (2, "half")), "y": broken}, path, "v2")
    assert len(os.listdir(tmp_path / "tables" / "data")) == 2
    for name in ("x", "y"):
        assert [(r.a, r.b) for r in commits.read_latest(spark, path, name, ROW).collect()] == [(1, "whole")]
        assert commits.read(spark, path, name, ROW).count() == 1
    commits.commit({"x": table(spark, (2, "done")), "y": table(spark, (2, "done"))}, path, "v2")
    assert [r.b for r in commits.read_latest(spark, path, "y", ROW).collect()] == ["done"]
