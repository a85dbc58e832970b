"""Upper nodes of a Gray-order hierarchical Hamming index, as rows that Spark shuffles.

A node is a masked bit pattern (mask, fp & mask). Two 64-bit values within k differing bits agree on
whole blocks (pigeonhole), so they share a node; a node with many values is split again
over its free bits, by the same argument.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import written

FULL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], n: int) -> list[int]:
    """Masks of n nearly equal runs of these bit positions."""
    at = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(at, at[1:])]


def top_masks(blocks: int, keep: int) -> list[int]:
    """All unions of `keep` of `blocks` blocks: blocks - keep differing bits leave one of them intact."""
    return [sum(x) for x in combinations(_cut(list(range(64)), blocks), keep)]


def child_masks(mask: int, k: int) -> list[int]:
    """mask and one of k + 1 runs of its free bits; k differing bits leave one intact."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | x for x in _cut(free, k + 1) if x]


def gray_rank(fp):
    """Position of the value in Gray order: the prefix xor of its bits (read as unsigned)."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def node_rows(values: DataFrame, blocks: int, k: int, limit: int, levels: int = 3) -> DataFrame:
    """(top, mask, part, and the columns of values) for each node that a value `fp` belongs to; top: which of top_masks() the node stems from.

    Nodes of more than `limit` values are split over their free bits, up to `levels` times.
    Every pair of values within k differing bits shares at least one node.
    """
    spark = values.sparkSession
    masks = top_masks(blocks, blocks - k)
    rows = values.select("*", F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("top", "mask"))
    rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    done = []
    for _ in range(levels):
        hot = written(rows.groupBy("mask", "part").count().where(F.col("count") > limit).drop("count"), "hot")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, ["mask", "part"], "left_anti"))
        split = {m: child_masks(m, k) for m in masks}
        masks = sorted({c for m in masks for c in split[m]})
        kids = spark.createDataFrame(
            [(signed(m), signed(c)) for m in split for c in split[m]], "mask long, child long"
        )
        rows = rows.join(hot, ["mask", "part"], "left_semi").join(F.broadcast(kids), "mask")
        rows = rows.withColumn("mask", F.col("child")).drop("child")
        rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        rows = written(rows.distinct(), "split")
    for x in done:
        rows = rows.unionByName(x)
    return rows
