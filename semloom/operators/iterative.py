"""Clustering, projection and graph communities that iterate: Spark ML where it has them, else rounds of aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.vectors import doubles
from semloom.operators.clusters import allocate_children, remap_by_size
from semloom.operators.staging import few, kept

#: Numbers in the centers that are broadcast at once.
CENTERS = 4_000_000


def default_k(n: int) -> int:
    """Clusters for n rows where none are asked for: sqrt(n / 2), 2 to 15, at most n."""
    return min(max(2, min(15, max(2, round((n / 2) ** 0.5)))), n)


def kmeans(vectors: DataFrame, k: int | None = None, seeds: int = 3, seed: int = 42) -> DataFrame:
    """(id, cluster): k-means on unit vectors, the cheapest of several seeds; ids by size. No rows give none, one row cluster 0."""
    n = vectors.count()
    if n <= 1:
        return vectors.select("id", F.lit(0).cast("long").alias("cluster"))
    rows = vectors.select("id", array_to_vector(doubles("embedding")).alias("raw"))
    rows = Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(rows).select("id", "features").persist()  # Spark ML reads it in every step
    models = [KMeans(k=min(k or default_k(n), n), seed=seed + i, maxIter=50).fit(rows) for i in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    found = best.transform(rows).select("id", F.col("prediction").alias("cluster"))
    new = remap_by_size(found).select("cluster", "new_id")
    out = kept(found.join(few(new), "cluster").select("id", F.col("new_id").alias("cluster")))
    rows.unpersist()
    return out


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _nearest_center(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of each row's nearest center, ties to the first."""
    d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _by_parent(batches, centers: dict[int, np.ndarray]):
    for pdf in batches:
        for parent, part in pdf.groupby("parent"):
            x = _unit(part["embedding"])
            yield parent, part, x, *_nearest_center(x, centers[parent])


def _moved(rows: DataFrame, centers: dict[int, np.ndarray], size: int) -> dict[int, np.ndarray]:
    """Means of each center's rows: partial sums in every task, added up by Spark. A center without rows moves to a row far from its own center."""
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def work(batches):
        held: dict[tuple[int, int], list] = {}
        for parent, _, x, at, d in _by_parent(batches, sent.value):
            for child in np.unique(at):
                own = at == child
                far = int(np.flatnonzero(own)[d[own].argmax()])
                n, s, most, vector = held.get((parent, child), (0, np.zeros(size), -1.0, None))
                held[parent, child] = (n + int(own.sum()), s + x[own].sum(0), max(most, d[far]), x[far] if d[far] > most else vector)
        if held:
            yield pd.DataFrame([(p, c, n, s.tolist(), m, v.tolist()) for (p, c), (n, s, m, v) in held.items()], columns=["parent", "child", "n", "s", "far", "vector"])

    parts = rows.mapInPandas(work, "parent long, child long, n long, s array<double>, far double, vector array<double>")
    sums = F.array(*[F.sum(F.col("s")[i]) for i in range(size)])
    got = parts.groupBy("parent", "child").agg(F.sum("n").alias("n"), sums.alias("s"), F.max("far").alias("far"), F.max_by("vector", "far").alias("vector")).collect()  # a row per center
    new = {p: np.full_like(c, np.nan) for p, c in centers.items()}
    for r in got:
        new[r["parent"]][r["child"]] = np.array(r["s"]) / r["n"]
    far: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (-r["far"], r["child"])):
        far.setdefault(r["parent"], []).append(r)
    for p, c in new.items():
        for child, r in zip(np.flatnonzero(np.isnan(c[:, 0])), far[p]):
            c[child] = r["vector"]
        c[np.isnan(c)] = centers[p][np.isnan(c)]
    return new


def children(vectors: DataFrame, parents: DataFrame, total: int, seed: int = 42, rounds: int = 20) -> DataFrame:
    """(id, parent, child): each parent's members clustered among themselves, `total` children shared out by size.

    k-means for all parents at once, whatever their size: a round is one pass over the rows with the centers of a block of parents
    (at most CENTERS numbers, or one parent's) broadcast, partial sums in each task and one aggregate. Starts are the rows of least hash.
    Child ids follow the parents' order, larger children first. A parent with fewer different vectors than children may get fewer.
    """
    sizes = parents.groupBy("cluster").agg(F.count("*").alias("n")).withColumnRenamed("cluster", "parent")
    quota = kept(allocate_children(sizes, total))
    rows = kept(vectors.join(parents.withColumnRenamed("cluster", "parent"), "id").join(few(quota), "parent").select("id", "embedding", "parent", "children"))
    first = rows.first()
    if first is None:
        return vectors.select("id", F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("child"))
    size = len(first["embedding"])
    order = Window.partitionBy("parent").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    starts = kept(rows.withColumn("r", F.row_number().over(order)).where("r <= children").select("parent", "embedding", "r"))
    blocks, room = [[]], CENTERS
    for q in quota.orderBy("parent").toLocalIterator():  # a row per parent
        if q["children"] * size > room and blocks[-1]:
            blocks.append([])
            room = CENTERS
        blocks[-1].append(q["parent"])
        room -= q["children"] * size
    parts = []
    for block in blocks:
        lo, hi = block[0], block[-1]
        mine = rows.where(F.col("parent").between(lo, hi))
        centers: dict[int, list] = {}
        for r in starts.where(F.col("parent").between(lo, hi)).orderBy("parent", "r").collect():  # a block's centers
            centers.setdefault(r["parent"], []).append(r["embedding"])
        now = {p: _unit(c) for p, c in centers.items()}
        for _ in range(rounds):
            new = _moved(mine, now, size)
            still = all(np.abs(new[p] - now[p]).max() < 1e-6 for p in now)
            now = new
            if still:
                break
        sent = vectors.sparkSession.sparkContext.broadcast(now)

        def work(batches, sent=sent):
            for parent, part, _, at, _ in _by_parent(batches, sent.value):
                yield pd.DataFrame({"id": part["id"].to_numpy(), "parent": parent, "local": at})

        parts.append(mine.mapInPandas(work, "id long, parent long, local long"))
    found = kept(reduce(DataFrame.union, parts))
    per = found.groupBy("parent", "local").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    ids = per.withColumn("child", F.row_number().over(Window.orderBy("parent", F.desc("n"), "first")).cast("long") - 1)  # a row per cluster, of which `total` exist
    return found.join(few(ids.select("parent", "local", "child")), ["parent", "local"]).select("id", "parent", "child")


def hierarchy(vectors: DataFrame, macro: int, neighborhood: int, micro: int) -> DataFrame:
    """(id, macro, neighborhood, micro): three strictly nested levels."""
    top = kmeans(vectors, macro)
    mid = children(vectors, top, neighborhood)
    low = children(vectors, mid.select("id", F.col("child").alias("cluster")), micro)
    return top.withColumnRenamed("cluster", "macro").join(mid.select("id", F.col("child").alias("neighborhood")), "id").join(low.select("id", F.col("child").alias("micro")), "id")


def pca(vectors: DataFrame) -> DataFrame:
    """(id, x, y): centred projection on the two main axes, each with its largest loading positive. One row or one column give zeros."""
    rows = vectors.select("id", array_to_vector(doubles("embedding")).alias("v")).persist()
    first = rows.first()
    if first is None or rows.limit(2).count() < 2 or len(first["v"]) < 2:
        return vectors.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    axes = model.pc.toArray()
    sign = [1.0 if axes[np.abs(axes[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    flat = model.transform(rows).select("id", vector_to_array("p").alias("p"))
    mean = flat.agg(F.avg(F.col("p")[0]).alias("mx"), F.avg(F.col("p")[1]).alias("my"))
    both = flat.crossJoin(F.broadcast(mean))  # one row
    return both.select("id", ((F.col("p")[0] - F.col("mx")) * sign[0]).alias("x"), ((F.col("p")[1] - F.col("my")) * sign[1]).alias("y"))


def communities(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, cluster): weighted label propagation on undirected edges (src, dst, weight); ids by size.

    Each node takes the label of most weight among its neighbours and itself, ties to the least label; a node's own label weighs
    more each round, so labels come to rest. A round is one join and two aggregates, written; rounds end when no label changes, and it is an error if `rounds` don't do.
    """
    both = kept(edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")))
    label = kept(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for i in range(rounds):
        votes = both.join(label, both.dst == label.id).groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
        own = label.withColumn("w", F.lit(0.25 * (1 + i // 4)))
        new = votes.union(own.select("id", "label", "w")).groupBy("id", "label").agg(F.sum("w").alias("w"))
        new = kept(new.groupBy("id").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label")))
        changed = new.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count()
        label = new
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    sizes = remap_by_size(label.withColumnRenamed("label", "cluster")).select("cluster", "new_id")
    return label.join(sizes, label.label == sizes.cluster).select("id", F.col("new_id").alias("cluster"))
