"""Tiles of a map: pruned reads equal full scans."""

import random

import pytest

from semloom.sources import tiles

SCHEMA = "id long, x double, y double, tags array<string>"


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(2)
    rows = [(i, r.gauss(0, 1), r.uniform(-3, 3), ["a", "b"]) for i in range(1500)] + [(2000 + i, 0.5, 0.5, []) for i in range(300)]
    return spark.createDataFrame([*rows, (5000, None, 1.0, None), (5001, float("nan"), 1.0, None)], SCHEMA)


def filters(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line][0].split("PartitionFilters: ")[1].split("]")[0]


def test_views_equal_the_full_scan(spark, points, tmp_path):
    made = tiles.write_tiles(points, str(tmp_path / "t"), target=40)
    assert made["level"] == 3 and made["points"] == 1800
    every = {r.id: (r.x, r.y) for r in points.collect()}
    for x0, y0, x1, y1 in [(-0.5, -1, 0.2, 0), (0.5, 0.5, 0.5, 0.5), (-9, -9, 9, 9), (5, 5, 6, 6), (1, 1, 0, 0), (-1, 2.9, 3, 9)]:
        got = tiles.viewport(spark, str(tmp_path / "t"), x0, y0, x1, y1)
        want = {i for i, (x, y) in every.items() if x is not None and x0 <= x <= x1 and y0 <= y <= y1}
        rows = got.collect()
        assert {r.id for r in rows} == want and len(rows) == len(want) and got.columns == ["id", "x", "y", "tags", "quadkey"]
    assert "tx" in filters(got) and "ty" in filters(got)
    small = tiles.viewport(spark, str(tmp_path / "t"), -0.1, -0.1, 0.1, 0.1)
    assert len(small.inputFiles()) >= 1 and {len(r.quadkey) for r in small.collect()} == {3}


def test_one_tile_one_point_and_none(spark, tmp_path):
    one = spark.createDataFrame([(1, 2.0, 3.0, None)], SCHEMA)
    assert tiles.write_tiles(one, str(tmp_path / "o"))["level"] == 0
    assert [tuple(r) for r in tiles.viewport(spark, str(tmp_path / "o"), 0, 0, 9, 9).collect()] == [(1, 2.0, 3.0, None, "")]
    tiles.write_tiles(one.where("id > 1"), str(tmp_path / "n"))
    with pytest.raises(FileNotFoundError):
        tiles.viewport(spark, str(tmp_path / "missing"), 0, 0, 1, 1)


def test_quadkeys_nest(spark):
    from pyspark.sql import functions as F

    rows = spark.range(16).select((F.col("id") % 4).cast("int").alias("x"), F.floor(F.col("id") / 4).cast("int").alias("y"))
    deep = {(r.x, r.y): r.k for r in rows.select("x", "y", tiles.quadkey(F.col("x"), F.col("y"), 2).alias("k")).collect()}
    assert len(set(deep.values())) == 16 and {k[0] for (x, y), k in deep.items() if x < 2 and y < 2} == {"0"} and deep[3, 2] == "31"


def test_labels_of_a_zoom(spark):
    labels = spark.createDataFrame([("macro", 0.0, 0.0), ("micro", 0.0, 0.0), ("micro", 5.0, 5.0)], "layer string, x double, y double")
    assert [tuple(r) for r in tiles.visible_labels(labels, 9.0, -1, -1, 1, 1).collect()] == [("micro", 0.0, 0.0)]
    assert tiles.visible_labels(labels, 1.0, -1, -1, 1, 1).first().layer == "macro"
