"""Exact cosine neighbours in blocks, and what follows from neighbour lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semloom.operators.staging import kept, kept_in_batches

#: Vectors of a block at least and at most; blocks of a table between; pairs of blocks that Python gets at a time.
BLOCK, LARGEST, BLOCKS, PAIRS = 2048, 16_384, 40, 4


def block_size(n: int) -> int:
    """Vectors of a block for n of them: each block meets all others, so what is shuffled falls as blocks grow, and there must be pairs enough for all tasks."""
    return min(max(BLOCK, -(-n // BLOCKS)), LARGEST)


def blocks(vectors: DataFrame, block: int | None = None) -> DataFrame:
    """One row per block of about `block` unit vectors (block_size if not given): (block, ids, rows), dealt by a hash of the id.

    Null vectors are dropped, zero vectors stay zero. A block's size is bounded by design, whatever the table's.
    """
    n = vectors.count()
    many = max(1, -(-n // (block or block_size(n))))
    dealt = vectors.where("embedding is not null").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int"))
    return dealt.groupBy("block").agg(F.collect_list(F.struct("id", "embedding")).alias("rows"))


def nearest(vectors: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(src, nbr, sim, rank) of the k most similar others of every vector (id, embedding); ties by id.

    Equal vectors fold to one, with their k + 1 least ids. Each unordered pair of blocks is one matrix product in a task, for both
    sides; it yields k + 1 rows per vector, and windows merge them. The work is quadratic in the different vectors.
    """
    rows = vectors.where("embedding is not null").select("id", "embedding")
    own = rows.groupBy("embedding").agg(F.min("id").alias("grp"))
    of = kept(rows.join(own, "embedding").select("id", "grp"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("id"))
    least = kept(of.withColumn("r", place).where(F.col("r") <= k + 1).select("grp", "id"))
    packed = kept(blocks(own.select(F.col("grp").alias("id"), "embedding"), block))
    i, j = packed.select(F.col("block").alias("i")), packed.select(F.col("block").alias("j"))
    pairs = i.join(j, F.col("i") <= F.col("j"))  # numbers of blocks, not their rows
    pairs = pairs.join(packed.select(F.col("block").alias("i"), F.col("rows").alias("q")), "i").join(packed.select(F.col("block").alias("j"), F.col("rows").alias("b")), "j")

    def work(batches):
        def matrix(rows):
            m = np.array([r["embedding"] for r in rows], np.float64)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            return np.array([r["id"] for r in rows], np.int64), np.divide(m, length, out=np.zeros_like(m), where=length > 0)

        def best(qi, bi, sim):
            """The k + 1 best of each row, ties by id."""
            keep = min(k + 1, sim.shape[1])
            edge = -np.partition(-sim, keep - 1, axis=1)[:, keep - 1]
            i, j = np.nonzero(sim >= edge[:, None])
            order = np.lexsort((bi[j], -sim[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, np.arange(len(qi)))
            top = np.arange(len(i)) - first[i] < keep
            return pd.DataFrame({"src": qi[i[top]], "nbr": bi[j[top]], "sim": sim[i[top], j[top]]})

        for pdf in batches:
            for one, two, q, b in zip(pdf["i"], pdf["j"], pdf["q"], pdf["b"]):
                (qi, qm), (bi, bm) = matrix(q), matrix(b)
                for at in range(0, len(qi), 256):
                    yield best(qi[at : at + 256], bi, qm[at : at + 256] @ bm.T)
                for at in range(0, len(bi) if one != two else 0, 256):
                    yield best(bi[at : at + 256], qi, bm[at : at + 256] @ qm.T)

    groups = Window.partitionBy("src").orderBy(F.desc("sim"), "nbr")
    found = pairs.mapInPandas(work, "src long, nbr long, sim double").withColumn("r", F.row_number().over(groups)).where(F.col("r") <= k + 1)
    found = kept_in_batches(found.drop("r"), PAIRS)
    ids = found.join(least.withColumnRenamed("grp", "nbr"), "nbr").withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "id")))
    ids = ids.where(F.col("r") <= k + 1).select(F.col("src").alias("grp"), F.col("id").alias("nbr"), "sim")
    out = of.withColumnRenamed("id", "src").join(ids, "grp").where("src <> nbr")
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "nbr")
    return out.select("src", "nbr", "sim", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def same_cluster_rate(neighbors: DataFrame, assigned: DataFrame) -> DataFrame:
    """(same_rate, pairs): share of neighbour pairs with one cluster, outliers (-1) aside; 0.0 without pairs."""
    a = assigned.where("cluster >= 0")
    both = neighbors.join(a.select(F.col("id").alias("src"), F.col("cluster").alias("c")), "src")
    both = both.join(a.select(F.col("id").alias("nbr"), F.col("cluster").alias("d")), "nbr")
    same = F.count_if(F.col("c") == F.col("d"))
    return both.agg(F.coalesce(F.try_divide(same, F.count("*")), F.lit(0.0)).alias("same_rate"), F.count("*").alias("pairs"))


def edges(neighbors: DataFrame) -> DataFrame:
    """Undirected weighted edges (src < dst) of a neighbour list, each once."""
    return neighbors.groupBy(F.least("src", "nbr").alias("src"), F.greatest("src", "nbr").alias("dst")).agg(F.max("sim").alias("weight"))


def modularity(graph: DataFrame, assigned: DataFrame) -> DataFrame:
    """(modularity) of the clusters on a weighted graph: sum over clusters of inside / m - (degree / 2m)^2."""
    c = assigned.select("id", "cluster")
    ends = graph.join(c.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src")
    ends = ends.join(c.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst")
    flat = ends.select(F.explode(F.array(F.struct(F.col("a").alias("k"), "weight", (F.col("a") == F.col("b")).alias("inside")), F.struct(F.col("b").alias("k"), "weight", F.lit(False).alias("inside")))).alias("e"))
    per = flat.groupBy("e.k").agg(F.sum("e.weight").alias("degree"), F.sum(F.when(F.col("e.inside"), F.col("e.weight")).otherwise(0.0)).alias("inside"))
    total = per.agg(F.sum("degree").alias("two_m"))
    part = per.crossJoin(F.broadcast(total))  # one row
    value = F.sum(2 * F.col("inside") / F.col("two_m") - F.pow(F.col("degree") / F.col("two_m"), 2))
    return part.agg(value.alias("modularity"))


def rerank(neighbors: DataFrame, context: DataFrame, keep: int) -> DataFrame:
    """Neighbour lists in the order of similarity plus context bonus: (src, nbr, sim, rank).

    context: id, macro, neighborhood, micro, genres, keywords. Missing assignments are equal to each other.
    Entries whose neighbour has no context row are dropped, of sources without one none are.
    """
    names = ["macro", "neighborhood", "micro", "genres", "keywords"]
    s = context.select(F.col("id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in names], F.lit(True).alias("known"))
    t = context.select(F.col("id").alias("nbr"), *[F.col(c).alias(f"t_{c}") for c in names], F.lit(True).alias("there"))
    both = neighbors.join(s, "src", "left").join(t, "nbr", "left").where(F.col("known").isNull() | F.col("there").isNotNull())
    shared = lambda c: F.size(F.array_intersect(f"s_{c}", f"t_{c}"))
    filled = lambda c: (F.size(f"s_{c}") > 0) & (F.size(f"t_{c}") > 0)
    bonus = F.lit(0.0)
    for layer, gain in (("macro", 0.008), ("neighborhood", 0.022), ("micro", 0.035)):
        bonus += F.when(F.col(f"s_{layer}").eqNullSafe(F.col(f"t_{layer}")), gain).otherwise(0.0)
    bonus += F.when(shared("genres") > 0, F.least(F.lit(0.026), 0.012 * shared("genres"))).when(filled("genres"), -0.022).otherwise(0.0)
    dark = F.array_contains("s_genres", "Horror") != F.array_contains("t_genres", "Horror")
    bonus += F.when(dark & ~F.col("s_neighborhood").eqNullSafe(F.col("t_neighborhood")), -0.035).otherwise(0.0)
    bonus += F.when(shared("keywords") > 0, F.least(F.lit(0.028), 0.006 * shared("keywords"))).when(filled("keywords"), -0.006).otherwise(0.0)
    scored = both.withColumn("adjusted", F.when(F.col("known"), F.col("sim") + bonus).otherwise(F.col("sim")))
    order = Window.partitionBy("src").orderBy(F.desc("adjusted"), F.desc("sim"), "rank")
    ranked = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return ranked.select("src", "nbr", "sim", F.col("place").alias("rank"))
