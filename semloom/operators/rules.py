"""Rule tables on labels, points and neighbour lists; rule order is a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def final_labels(clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """clusters (cluster, label) with the label of the last rule (cluster, ord, new_label) that names the cluster."""
    last = rules.groupBy("cluster").agg(F.max_by("new_label", "ord").alias("new_label"))
    return clusters.join(last, "cluster", "left").select("cluster", F.coalesce("new_label", "label").alias("label"))


def label_log(clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """(cluster, ord, old, new) of the rules that changed the label as it then stood."""
    r = rules.join(clusters, "cluster")
    old = F.coalesce(F.lag("new_label").over(Window.partitionBy("cluster").orderBy("ord")), F.col("label"))
    return r.withColumn("old", old).where(~F.col("old").eqNullSafe(F.col("new_label"))).select("cluster", "ord", "old", F.col("new_label").alias("new"))


def neighbor_repair(lists: DataFrame, rules: DataFrame, base: float = 0.86, step: float = 0.025, cap: int = 12) -> DataFrame:
    """Neighbour lists with a rule's neighbours first, then the old ones up to the cap: (src, nbr, sim, rank).

    rules: src, nbr, pos from 0; a rule's similarity falls by its position. Repeats and the source itself are left out.
    """
    new = rules.select("src", "nbr", (F.floor((base - step * F.col("pos")) * 1e6 + 0.5) / 1e6).alias("sim"), F.col("pos").alias("at"), F.lit(0).alias("part"))
    old = lists.join(rules.select("src").distinct(), "src", "left_semi").select("src", "nbr", "sim", F.col("rank").alias("at"), F.lit(1).alias("part"))
    all_ = new.unionByName(old).where("src <> nbr")
    one = all_.groupBy("src", "nbr").agg(F.min_by(F.struct("part", "at", "sim"), F.struct("part", "at")).alias("b"))
    order = Window.partitionBy("src").orderBy("b.part", "b.at")
    ranked = one.withColumn("rank", F.row_number().over(order).cast("long")).where((F.col("rank") <= cap) | (F.col("b.part") == 0))
    rest = lists.join(rules.select("src").distinct(), "src", "left_anti").select("src", "nbr", "sim", F.col("rank").cast("long").alias("rank"))
    return ranked.select("src", "nbr", F.col("b.sim").alias("sim"), "rank").unionByName(rest)


def contradictions(labels: DataFrame, checks: DataFrame) -> DataFrame:
    """(id, layer, flag, severity): labels (id, layer, label, signal) that hold a check's label term without any of its signal terms.

    checks: flag, label_terms, signal_terms (arrays); a few rows, joined by containment. Macro labels aren't checked.
    """
    t = labels.where("layer <> 'macro'").join(F.broadcast(checks), F.exists("label_terms", lambda x: F.contains("label", x)))  # a fixed small table
    bad = t.where(~F.exists("signal_terms", lambda x: F.contains("signal", x)))
    return bad.select("id", "layer", "flag", F.when(F.col("layer") == "micro", 2).otherwise(1).alias("severity"))


def weak_clusters(evidence: DataFrame, top: int = 12) -> DataFrame:
    """Clusters (layer, cluster, coherence, share) of low coherence or of no dominant value, the weakest of each layer first."""
    weak = evidence.where((F.col("coherence") < 0.57) | (F.col("share") < 0.35))
    w = Window.partitionBy("layer").orderBy(F.coalesce("coherence", F.lit(0.0)), "share", "cluster")
    return weak.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def normalized_results(results: DataFrame, known: DataFrame) -> DataFrame:
    """Audit results of known ids, the first per id: verdict pass, mixed or fail (else mixed), severity 0 to 3."""
    first = results.join(known.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("verdict", "severity"), "ord").alias("r"))
    verdict = F.lower(F.col("r.verdict"))
    return first.select("id", F.when(verdict.isin("pass", "mixed", "fail"), verdict).otherwise("mixed").alias("verdict"), F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce("r.severity", F.lit(0)))).alias("severity"))
