"""Clustering methods side by side: each one's sizes, coherence, silhouette and scores; and the score that selects a hierarchy."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.operators import clusters as C
from semloom.operators import iterative, louvain, sweep
from semloom.operators import neighbors as N
from semloom.operators.staging import kept

#: The size to aim for, the size from which a cluster is broad, the least size that isn't tiny, and costs of shares.
IDEAL, BROAD, TINY, TINY_COST, OUTLIER_COST, SILHOUETTE = 14, 45, 5, 1.5, 2, 0.5
#: Weights of the selection score.
MACRO, NEIGHBORHOOD, MICRO, COHERENCE, GOOD, BAD, TINY_EACH, MISMATCH, FLAT = 6, 20, 24, 22, 0.7, 3.0, 0.03, 55, 18
METRICS = "method string, note string, entities long, clusters long, outliers long, average_size double, largest long, smallest long, tiny long, coherence double, coherence_min double, coherence_max double, silhouette double, labelability double, fragmentation double"


class Skipped(Exception):
    """A method that can't run here; its row says why."""


def evaluate(method: str, note: str, vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row of METRICS for assigned (id, cluster) of vectors (id, embedding); cluster -1 holds outliers."""
    rows = kept(vectors.select("id", "embedding").join(assigned.select("id", F.col("cluster").cast("long").alias("cluster")), "id"))
    counts = rows.agg(F.count("*").alias("entities"), F.count_if(F.col("cluster") < 0).alias("outliers"))
    per = C.coherence(rows.where("cluster >= 0"))
    sizes = per.agg(
        F.count("*").alias("clusters"), F.avg("n").alias("average_size"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.count_if(F.col("n") < TINY).alias("tiny"),
        F.avg("coherence").alias("coherence"), F.min("coherence").alias("coherence_min"), F.max("coherence").alias("coherence_max"),
    )
    m = counts.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(C.silhouette(rows)))  # one row each
    m = m.withColumn("silhouette", F.when(F.col("clusters") < F.col("entities") - F.col("outliers"), F.col("silhouette")))
    tiny = F.coalesce(F.try_divide("tiny", "clusters"), F.lit(1.0))
    outliers = F.coalesce(F.try_divide("outliers", "entities"), F.lit(1.0))
    cost = F.abs(F.coalesce("average_size", F.lit(0.0)) - IDEAL) / IDEAL + F.greatest(F.lit(0), F.coalesce("largest", F.lit(10_000)) - BROAD) / BROAD + tiny * TINY_COST + outliers * OUTLIER_COST
    score = F.coalesce("coherence", F.lit(0.0)) + F.coalesce("silhouette", F.lit(0.0)) * SILHOUETTE - cost
    m = m.withColumn("fragmentation", cost).withColumn("labelability", F.when(F.col("clusters") > 0, score)).withColumn("method", F.lit(method)).withColumn("note", F.lit(note))
    return m.select(*[F.col(c).cast(t).alias(c) for c, t in (x.strip().split(" ") for x in METRICS.split(","))])


def skipped(method: str, why: str, entities: DataFrame) -> DataFrame:
    """A row without metrics."""
    row = entities.agg(F.count("*").alias("entities"))
    return row.select(*[F.lit(method).alias(c) if c == "method" else F.lit(f"skipped: {why}").alias(c) if c == "note" else F.col(c) if c == "entities" else F.lit(None).cast(t).alias(c) for c, t in (x.strip().split(" ") for x in METRICS.split(","))])


def methods(vectors: DataFrame, k: int, neighbors: int) -> dict[str, tuple[str, Callable[[], DataFrame]]]:
    """Name -> (note, how to get assignments)."""
    graph = lambda: N.edges(N.nearest(vectors, neighbors))

    def no_density() -> DataFrame:
        raise Skipped("no density clustering is installed")

    return {
        "kmeans": ("k-means on unit vectors, the best of several seeds", lambda: iterative.kmeans(vectors, k)),
        "lloyd": ("k-means from hashed starts", lambda: sweep.fit(vectors, [k]).assignments()),
        "graph": ("communities of most modularity on the neighbour graph", lambda: louvain.louvain(graph())[0]),
        "propagation": ("label propagation on the neighbour graph", lambda: iterative.communities(graph())),
        "hdbscan": ("density clusters", no_density),
    }


def compare(vectors: DataFrame, names: list[str] | None = None, k: int = 10, neighbors: int = 5) -> DataFrame:
    """A row of METRICS for each method, in the order asked for; one that can't run gives a row without metrics. Unknown names are an error."""
    known = methods(vectors, k, neighbors)
    asked = list(dict.fromkeys(names or known))
    if missing := [n for n in asked if n not in known]:
        raise ValueError(f"unknown methods: {', '.join(missing)}")
    rows = []
    for n in asked:
        note, run = known[n]
        try:
            rows.append(evaluate(n, note, vectors, run()))
        except Skipped as e:
            rows.append(skipped(n, str(e), vectors))
    return reduce(DataFrame.unionByName, rows)


def selection(vectors: DataFrame, layers: DataFrame, neighbors: DataFrame, hits: DataFrame | None = None, mismatch: float | None = 0.0) -> DataFrame:
    """One row (macro, neighborhood, micro, coherence, good, bad, tiny, penalty, score) for a hierarchy.

    vectors: (id, embedding); layers: (id, macro, neighborhood, micro); neighbors: (src, nbr, rank), of which the first seven count; hits: labelling.pattern_hits;
    mismatch: share of members whose parent isn't their cluster's, None for layers that aren't nested.
    """
    near = kept(neighbors.where("rank <= 7"))
    names = ("macro", "neighborhood", "micro")
    row, per = None, None
    for c in names:
        own = layers.select("id", F.col(c).alias("cluster"))
        rate = N.same_cluster_rate(near, own).select(F.col("same_rate").alias(c))
        row = rate if row is None else row.crossJoin(F.broadcast(rate))  # one row each
        one = C.coherence(vectors.select("id", "embedding").join(own.where("cluster >= 0"), "id")).select("n", "coherence")
        per = one if per is None else per.unionByName(one)
    row = row.crossJoin(F.broadcast(per.agg(F.avg("coherence").alias("coherence"), F.count_if(F.col("n") < TINY).alias("tiny"))))
    row = row.crossJoin(F.broadcast(C.balance(layers.select("id", F.col("macro").alias("cluster"))).select("penalty")))
    if hits is not None:
        row = row.crossJoin(F.broadcast(hits.agg(F.count_if(F.col("hit") & F.col("good")).alias("good"), F.count_if(F.col("hit") & ~F.col("good")).alias("bad"))))
    else:
        row = row.withColumn("good", F.lit(0)).withColumn("bad", F.lit(0))
    nested = F.lit(-(mismatch or 0.0) * MISMATCH - (FLAT if mismatch is None else 0))
    gain = F.col("macro") * MACRO + F.col("neighborhood") * NEIGHBORHOOD + F.col("micro") * MICRO + F.coalesce("coherence", F.lit(0.0)) * COHERENCE + F.col("good") * GOOD
    return row.withColumn("score", gain + nested - F.col("bad") * BAD - F.col("tiny") * TINY_EACH - F.col("penalty"))
