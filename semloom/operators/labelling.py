"""Labels in context: parents' labels as warnings, labels of regions, patterns among neighbours, and notes on variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Warnings of a cluster below the top layer, limits of the notes, costs of a tiny cluster, of a noisy term and of medium weight.
GENERAL = "Do not borrow parent-specific terms unless this cluster evidence supports them."
KEEPS_COHERENCE, LOSES_CONFIDENCE = -0.01, -0.02
TINY, NOISE, MEDIUM = 0.02, 0.002, 0.03


def label_context(evidence: DataFrame, parents: DataFrame, labels: DataFrame, layer: str) -> DataFrame:
    """evidence (cluster, warnings, ...) of a layer with its parent's label and the general warning appended; the macro layer stays as it is.

    parents: (cluster, parent); labels: (parent, label). A cluster without a parent, or whose parent has no label, gets the general warning alone.
    """
    if layer == "macro":
        return evidence
    above = "macro" if layer == "neighborhood" else "neighborhood"
    one = parents.join(labels, "parent").groupBy("cluster").agg(F.min_by("label", "parent").alias("_label"))
    mine = F.when(F.col("_label").isNotNull(), F.array(F.concat(F.lit(f"Parent {above} label: "), "_label"))).otherwise(F.array().cast("array<string>"))
    warnings = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), mine, F.array(F.lit(GENERAL)))
    return evidence.join(one, "cluster", "left").withColumn("warnings", warnings).drop("_label")


def region_labels(labels: DataFrame, regions: DataFrame, layer: str) -> DataFrame:
    """(cluster, label, x, y, n, rank): labels (layer, cluster, label) of a layer at their regions (layer, cluster, x, y, size, points), largest first; n is the size, else the points."""
    own = labels.where(F.col("layer") == layer).select("cluster", "label")
    at = regions.where(F.col("layer") == layer).select("cluster", "x", "y", F.coalesce("size", "points", F.lit(0)).cast("long").alias("n"))
    rows = own.join(at, "cluster")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")).cast("long"))  # a row per region


def pattern_hits(neighbors: DataFrame, titles: DataFrame, patterns: DataFrame, top: int = 7) -> DataFrame:
    """(title, present, pattern, good, hit): whether a pattern of an audited title stands in a title of its first neighbours, whatever the case.

    neighbors: (src, nbr, rank); titles: (id, title), of equal titles the last id counts; patterns: (title, pattern, good). A title that isn't there hits nothing.
    """
    low = titles.groupBy(F.lower("title").alias("key")).agg(F.max("id").alias("src"))
    asked = patterns.withColumn("key", F.lower("title")).join(low, "key", "left")
    near = neighbors.where(F.col("rank") <= top).join(titles.select(F.col("id").alias("nbr"), F.lower("title").alias("other")), "nbr")
    found = asked.select("src", "pattern").distinct().join(near, "src").where(F.contains("other", "pattern")).select("src", "pattern", F.lit(True).alias("hit")).distinct()
    out = asked.join(found, ["src", "pattern"], "left")
    return out.select("title", F.col("src").isNotNull().alias("present"), "pattern", "good", F.coalesce("hit", F.lit(False)).alias("hit"))


def pattern_summary(hits: DataFrame) -> DataFrame:
    """(requested, present, bad_hits, good_hits) of pattern_hits."""
    return hits.agg(
        F.countDistinct("title").alias("requested"), F.countDistinct(F.when(F.col("present"), F.col("title"))).alias("present"),
        F.count_if(F.col("hit") & ~F.col("good")).alias("bad_hits"), F.count_if(F.col("hit") & F.col("good")).alias("good_hits"),
    )


def variant_notes(summaries: DataFrame, plain: str = "no_reviews", light: str = "light_reviews", medium: str = "medium_reviews") -> DataFrame:
    """One row (recommended, light_note, medium_note) of summaries (variant, confidence, coherence, tiny, noise).

    The variant to take has the largest of confidence + coherence less TINY for each tiny cluster, NOISE for each noisy term and MEDIUM for medium weight; ties to the first name. Missing values count as 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = zero("confidence") + zero("coherence") - TINY * zero("tiny") - NOISE * zero("noise") - F.when(F.col("variant") == medium, MEDIUM).otherwise(0.0)
    of = lambda c, v: F.max(F.when(F.col("variant") == v, zero(c)))
    there = lambda v: F.count_if(F.col("variant") == v) > 0
    m = summaries.agg(
        F.min_by("variant", F.struct((-score).alias("s"), "variant")).alias("recommended"), there(plain).alias("p"), there(light).alias("l"), there(medium).alias("m"),
        (of("confidence", light) - of("confidence", plain)).alias("dc"), (of("coherence", light) - of("coherence", plain)).alias("dh"),
        (of("confidence", medium) - of("confidence", light)).alias("mc"), (of("noise", medium) - of("noise", light)).alias("mn"),
    )
    return m.select(
        "recommended",
        F.when(~(F.col("p") & F.col("l")), "insufficient variants").when((F.col("dc") >= 0) & (F.col("dh") >= KEEPS_COHERENCE), "light helps or preserves").otherwise("light may hurt").alias("light_note"),
        F.when(~(F.col("l") & F.col("m")), "insufficient variants").when((F.col("mn") > 0) | (F.col("mc") < LOSES_CONFIDENCE), "medium is noisier").otherwise("medium adds no obvious noise").alias("medium_note"),
    )
