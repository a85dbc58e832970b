"""Plane geometry of clusters: bounds, radii, affinities, polygons, hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semloom.operators.relational import top_per_key
from semloom.operators.staging import few


def bounds(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"))


def scaled_radii(sizes: DataFrame, radius: float, fill: float, least: float) -> DataFrame:
    """(cluster, n, r): radii whose circles fill a share of the parent's area; one row per cluster."""
    r = F.sqrt("n") * radius * F.sqrt(F.lit(fill) / F.sum("n").over(Window.partitionBy()))
    return sizes.select("cluster", "n", F.greatest(F.lit(least), r).alias("r"))


def centroid_affinity(centers: DataFrame, m: int = 6) -> DataFrame:
    """(a, b, w): each cluster's m nearest others with weight by rank and distance; centers (cluster, cx, cy), one row per cluster."""
    b = centers.select(F.col("cluster").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    pairs = centers.select(F.col("cluster").alias("a"), "cx", "cy").join(few(b), F.col("a") != F.col("b"))
    d = pairs.select("a", "b", F.sqrt((F.col("cx") - F.col("bx")) ** 2 + (F.col("cy") - F.col("by")) ** 2).alias("d"))
    near = top_per_key(d, ["a"], [F.col("d"), F.col("b")], m)
    scale = F.max("d").over(Window.partitionBy("a"))
    far = F.coalesce(F.try_divide(F.col("d"), scale), F.lit(0.0))
    return near.select("a", "b", (1 - (F.col("rank") - 1) / m + F.greatest(F.lit(0.0), 1 - far) * 0.45).alias("w"))


def cluster_affinity(links: DataFrame, sizes: DataFrame, floor: float = 0.42) -> DataFrame:
    """(a, b, w): summed similarity above a floor between clusters, by their sizes, at most 3.2. links: a, b, sim."""
    over = F.greatest(F.lit(0.0), F.col("sim") - floor)
    sums = links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(over).alias("s"))
    n = sizes.select("cluster", "n")
    both = sums.join(n.withColumnsRenamed({"cluster": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"cluster": "b", "n": "nb"}), "b")
    return both.select("a", "b", F.least(F.lit(3.2), F.col("s") / F.greatest(F.lit(1.0), F.sqrt(F.col("na") * F.col("nb"))) * 9).alias("w"))


def spiral(points: DataFrame) -> DataFrame:
    """(cluster, id, x, y): members on a golden-angle spiral in id order, radius by the square root of the place."""
    w = Window.partitionBy("cluster")
    i = (F.row_number().over(w.orderBy("id")) - 1).cast("double")
    n = F.count("*").over(w)
    r, a = F.sqrt((i + 0.5) / n), i * 2.399963229728653
    return points.select("cluster", "id", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd test of a point in a polygon (array<struct<x, y>>)."""
    after = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    cross = F.zip_with(polygon, after, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]))
    return F.size(F.filter(cross, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def hits(points: DataFrame, probes: DataFrame, reach: float) -> DataFrame:
    """(probe, id, d): the nearest point within reach of each probe (probe, px, py); grid cells of the reach's size pair them."""
    cell = lambda c: F.floor(c / reach)
    p = points.select("id", "x", "y", cell(F.col("x")).alias("gx"), cell(F.col("y")).alias("gy"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = probes.withColumn("o", F.explode(near)).select("probe", "px", "py", (cell(F.col("px")) + F.col("o.i")).alias("gx"), (cell(F.col("py")) + F.col("o.j")).alias("gy"))
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    close = p.join(q, ["gx", "gy"]).withColumn("d", d).where(F.col("d") <= reach)
    best = close.groupBy("probe").agg(F.min(F.struct("d", "id")).alias("b"))
    return best.select("probe", F.col("b.id").alias("id"), F.col("b.d").alias("d"))
