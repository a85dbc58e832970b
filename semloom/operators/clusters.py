"""Cluster evidence, hierarchy and evaluation as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.vectors import cosine, doubles, unit
from semloom.operators.staging import few, kept


def centroids(vectors: DataFrame) -> DataFrame:
    """(cluster, pos, value): mean of each component of vectors (id, cluster, embedding), in long form."""
    long = vectors.select("cluster", F.posexplode(doubles("embedding")).alias("pos", "x"))
    return long.groupBy("cluster", "pos").agg(F.avg("x").alias("value"))


def centroid_arrays(vectors: DataFrame) -> DataFrame:
    """(cluster, centroid): an array per cluster, of the vectors' dimension."""
    rows = centroids(vectors).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("c"))
    return rows.select("cluster", F.transform("c", lambda s: s["value"]).alias("centroid"))


def coherence(vectors: DataFrame) -> DataFrame:
    """(cluster, n, coherence): mean pairwise cosine by its closed form (|sum of units|^2 - n) / (n (n - 1)); null below two.

    Linear in the rows, where pairs would be quadratic. Zero vectors count as no direction of their own.
    """
    u = vectors.select("cluster", unit(doubles("embedding")).alias("u"))
    sums = u.select("cluster", F.posexplode("u").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("q"))
    total = sums.groupBy("cluster").agg(F.sum(F.col("s") ** 2).alias("all"), F.sum("q").alias("own"))
    n = vectors.groupBy("cluster").agg(F.count("*").alias("n"))
    value = F.try_divide(F.col("all") - F.col("own"), (F.col("n") * (F.col("n") - 1)).cast("double"))
    return n.join(total, "cluster", "left").select("cluster", "n", value.alias("coherence"))


def representatives(vectors: DataFrame, top: int = 8) -> DataFrame:
    """(cluster, id, sim, rank): members nearest to their cluster's mean of raw vectors; ties by id."""
    joined = vectors.join(few(kept(centroid_arrays(vectors))), "cluster")  # a row per cluster: broadcast while they are few
    sim = joined.select("cluster", "id", cosine(doubles("embedding"), F.col("centroid")).alias("sim"))
    order = Window.partitionBy("cluster").orderBy(F.desc("sim"), "id")
    return sim.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def silhouette(vectors: DataFrame) -> DataFrame:
    """(silhouette): mean cosine silhouette by cluster sums, linear in rows x clusters; null without two clusters or three rows."""
    u = vectors.where("cluster >= 0").select("id", "cluster", unit(doubles("embedding")).alias("u"))
    sums = u.select("cluster", F.posexplode("u").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("s"))
    sums = sums.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("s"))
    sums = sums.select(F.col("cluster").alias("other"), F.transform("s", lambda z: z["s"]).alias("s"))
    n = u.groupBy(F.col("cluster").alias("other")).agg(F.count("*").alias("n"))
    table = F.broadcast(sums.join(n, "other"))  # a row per cluster
    inner = F.aggregate(F.zip_with("u", "s", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    own = F.col("cluster") == F.col("other")
    dist = F.when(own, F.try_divide(F.col("n") - inner, F.col("n") - 1)).otherwise(1 - inner / F.col("n"))
    each = u.crossJoin(table).select("id", own.alias("own"), dist.alias("d"), "n")
    ab = each.groupBy("id").agg(F.min(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"), F.min(F.when(F.col("own"), F.col("n"))).alias("n"))
    s = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.agg(F.when((F.count("b") >= 3), F.avg(s)).alias("silhouette"))


def size_stats(assigned: DataFrame, tiny: int = 5) -> DataFrame:
    """One row: clusters, mean, median, least and largest size, and how many are under `tiny`; outliers aside."""
    sizes = assigned.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("clusters"), F.avg("n").alias("avg_size"), F.expr("percentile(n, 0.5)").alias("median_size"),
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.count_if(F.col("n") < tiny).alias("tiny"),
    )


def majority_parent(pairs: DataFrame) -> DataFrame:
    """(child, parent, votes): most frequent parent of each child; ties go to the parent of the least id."""
    votes = pairs.groupBy("child", "parent").agg(F.count("*").alias("votes"), F.min("id").alias("first"))
    order = Window.partitionBy("child").orderBy(F.desc("votes"), "first")
    return votes.withColumn("r", F.row_number().over(order)).where("r = 1").select("child", "parent", "votes")


def mismatch_rate(pairs: DataFrame) -> DataFrame:
    """(checked, mismatched, rate): rows whose parent isn't their child cluster's majority parent."""
    best = majority_parent(pairs).select("child", F.col("parent").alias("best"))
    got = pairs.join(best, "child").agg(F.count("*").alias("checked"), F.count_if(F.col("parent") != F.col("best")).alias("mismatched"))
    return got.withColumn("rate", F.coalesce(F.try_divide("mismatched", "checked"), F.lit(0.0)))


def allocate_children(parents: DataFrame, total: int) -> DataFrame:
    """(parent, children): largest-remainder shares of `total` by (size - 1), one each at least, size at most.

    parents: parent, n. A window over all parents: there are few, one row per cluster.
    """
    every = Window.partitionBy()
    base = parents.where("n > 0").withColumn("cap", F.col("n") - 1).withColumn("caps", F.sum("cap").over(every))
    base = base.withColumn("left", F.least(F.lit(total), F.sum("n").over(every)) - F.count("*").over(every))
    exact = F.col("left") * F.col("cap") / F.nullif(F.col("caps"), F.lit(0))
    base = base.withColumn("exact", F.when(F.col("left") > 0, exact).otherwise(0.0))
    base = base.withColumn("extra", F.least(F.col("cap"), F.floor(F.coalesce("exact", F.lit(0.0)))))
    open_ = F.col("extra") + 1 < F.col("n")
    rank = Window.partitionBy().orderBy(open_.desc(), (F.col("extra") - F.col("exact")), F.desc("n"), "parent")
    base = base.withColumn("more", F.greatest(F.col("left"), F.lit(0)) - F.sum("extra").over(every)).withColumn("r", F.row_number().over(rank))
    bonus = (open_ & (F.col("r") <= F.col("more")) & (F.col("caps") > 0)).cast("long")
    return base.select("parent", (1 + F.col("extra") + bonus).cast("long").alias("children"))


def remap_by_size(assigned: DataFrame) -> DataFrame:
    """(cluster, new_id, n): ids by falling size, then by the least member; one row per cluster."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return sizes.select("cluster", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long").alias("new_id"), "n")


def balance(assigned: DataFrame) -> DataFrame:
    """(average, largest_ratio, smallest_ratio, penalty): how evenly clusters are filled; 80 without any."""
    sizes = assigned.where("cluster >= 0").groupBy("cluster").agg(F.count("*").alias("n"))
    mean = sizes.agg(F.avg("n").alias("average"))
    got = sizes.crossJoin(F.broadcast(mean)).agg(  # one row
        F.max("average").alias("average"), F.max("n").alias("hi"), F.min("n").alias("lo"), F.count_if(F.col("n") < F.col("average") * 0.25).alias("islands")
    )
    hi, lo = F.col("hi") / F.col("average"), F.col("lo") / F.col("average")
    penalty = F.greatest(F.lit(0.0), hi - 1.8) * 12 + F.greatest(F.lit(0.0), 0.45 - lo) * 28 + F.col("islands") * 2.5
    return got.select(
        F.coalesce("average", F.lit(0.0)).alias("average"), F.coalesce(hi, F.lit(1.0)).alias("largest_ratio"),
        F.coalesce(lo, F.lit(0.0)).alias("smallest_ratio"), F.when(F.col("average").isNull(), 80.0).otherwise(penalty).alias("penalty"),
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """(ari, nmi) of two labelings (a, b) from their contingency table; null below two rows."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    plogp = lambda x, n: x / n * F.log(x / n)
    n = cells.agg(F.sum("n").alias("total"))
    cell = cells.crossJoin(F.broadcast(n)).agg(F.sum(two(F.col("n"))).alias("ij"), (-F.sum(plogp(F.col("n"), F.col("total")))).alias("hab"), F.max("total").alias("total"))
    def side(c):
        s = cells.groupBy(c).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(n))
        return s.agg(F.sum(two(F.col("n"))).alias(f"s{c}"), (-F.sum(plogp(F.col("n"), F.col("total")))).alias(f"h{c}"))
    row = cell.crossJoin(side("a")).crossJoin(side("b"))  # one row each
    expect = F.col("sa") * F.col("sb") / two(F.col("total"))
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(most == expect, 1.0).otherwise((F.col("ij") - expect) / (most - expect))
    mean = (F.col("ha") + F.col("hb")) / 2
    nmi = F.when(mean == 0, 1.0).otherwise((F.col("ha") + F.col("hb") - F.col("hab")) / mean)
    ok = F.col("total") >= 2
    return row.select(F.when(ok, ari).alias("ari"), F.when(ok, nmi).alias("nmi"))
