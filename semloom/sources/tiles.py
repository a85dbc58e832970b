"""Points of a map in tiles: files dealt by a grid of quadtree cells, so that a viewport reads the tiles it shows alone."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.operators.search import layer_of_zoom
from semloom.sources.files import Files

MANIFEST = "tiles.json"
#: Points a tile should hold, and the deepest level: tiles are folders.
TARGET, DEEPEST = 50_000, 6


def column_of(x, low: float, high: float, level: int):
    """Grid column (or row) of a coordinate between low and high; the ends belong to the first and last."""
    cells = 1 << level
    if high <= low:
        return F.lit(0)
    return F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor((x - F.lit(low)) / F.lit(high - low) * cells))).cast("int")


def quadkey(tx, ty, level: int):
    """The cell's path from the whole map down: a digit 0 to 3 a level, so cells of one ancestor share its prefix."""
    digit = lambda i: (F.shiftright(tx, i).bitwiseAND(F.lit(1)) + 2 * F.shiftright(ty, i).bitwiseAND(F.lit(1))).cast("string")
    return F.concat(F.lit(""), *[digit(i) for i in range(level - 1, -1, -1)])


def write_tiles(points: DataFrame, path: str, level: int | None = None, target: int = TARGET) -> dict:
    """points (id, x, y, ...) as Parquet below path, partitioned by tile; what the manifest says. Points without a place are left out.

    The level is the least at which tiles of evenly spread points hold `target` rows. Rows of a tile are spread over several tasks by a hash of the id where it
    holds many, and lie in files in order of x and y, so that row groups are skipped too.
    """
    placed = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double")))
    n, x0, x1, y0, y1 = placed.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    box = [float(v) if v is not None else 0.0 for v in (x0, y0, x1, y1)]
    if level is None:
        level = min(DEEPEST, max(0, math.ceil(math.log(max(n, 1) / target, 4)))) if n > target else 0
    tx, ty = column_of(F.col("x"), box[0], box[2], level), column_of(F.col("y"), box[1], box[3], level)
    tiled = placed.withColumn("tx", tx).withColumn("ty", ty)
    sizes = tiled.groupBy("tx", "ty").agg(F.ceil(F.count("*") / (4 * target)).alias("parts"))  # a row per tile: at most 4 ** DEEPEST
    dealt = tiled.join(F.broadcast(sizes), ["tx", "ty"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt.repartition("tx", "ty", "part").drop("part", "parts").sortWithinPartitions("tx", "ty", "x", "y").write.mode("overwrite").partitionBy("tx", "ty").parquet(f"{path}/points")
    manifest = {"level": level, "box": box, "points": n, "schema": points.schema.simpleString()[7:-1]}
    Files(path).place(MANIFEST, json.dumps(manifest).encode())
    return manifest


def manifest_of(path: str) -> dict:
    found = Files(path).read(MANIFEST)
    if found is None:
        raise FileNotFoundError(f"no tiles below {path}")
    return json.loads(found)


def _cell(v: float, low: float, high: float, level: int) -> int:
    cells = 1 << level
    return 0 if high <= low else min(cells - 1, max(0, math.floor((v - low) / (high - low) * cells)))


def viewport(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The points with x0 <= x <= x1 and y0 <= y <= y1, and their tile's quadkey; other tiles' folders aren't read. A view beyond the map, or turned over, shows nothing."""
    m = manifest_of(path)
    low_x, low_y, high_x, high_y = m["box"]
    names = [c.split(":", 1)[0] for c in _columns(m["schema"])]
    rows = spark.read.schema(", ".join(c.replace(":", " ", 1) for c in _columns(m["schema"])) + ", tx int, ty int").parquet(f"{path}/points")
    at = lambda v, low, high: _cell(v, low, high, m["level"])
    rows = rows.where(F.col("tx").between(at(x0, low_x, high_x), at(x1, low_x, high_x)) & F.col("ty").between(at(y0, low_y, high_y), at(y1, low_y, high_y)))
    rows = rows.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return rows.select(*names, quadkey(F.col("tx"), F.col("ty"), m["level"]).alias("quadkey"))


def _columns(schema: str) -> list[str]:
    """The columns of a struct's simple string, parted at commas outside of brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def visible_labels(labels: DataFrame, zoom: float, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The labels (layer, ..., x, y) that a zoom shows, inside the view."""
    return labels.where((F.col("layer") == layer_of_zoom(F.lit(zoom))) & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
