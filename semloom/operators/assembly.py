"""Assembly of exports, review lists and lookups: joins, unions and aggregates over clusters, labels and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions import text as X

LAYERS = ("macro", "neighborhood", "micro")


def flat_labels(labels: dict[str, DataFrame]) -> DataFrame:
    """(label_id, layer, cluster, label): labels (cluster, label) of all layers, ids of the form layer:cluster."""
    parts = [d.select(F.concat_ws(":", F.lit(n), F.col("cluster").cast("string")).alias("label_id"), F.lit(n).alias("layer"), "cluster", "label") for n, d in labels.items()]
    return reduce(DataFrame.unionByName, parts)


def cluster_export(layer: str, evidence: DataFrame, labels: DataFrame, parents: DataFrame) -> DataFrame:
    """(cluster, parent, size, label_id, label): every cluster of evidence (cluster, size), with its label and parent where it has them."""
    out = evidence.join(labels.select("cluster", "label", F.lit(True).alias("labelled")), "cluster", "left").join(parents.select("cluster", "parent"), "cluster", "left")
    return out.select("cluster", "parent", "size", F.when(F.col("labelled"), F.concat_ws(":", F.lit(layer), F.col("cluster").cast("string"))).alias("label_id"), "label")


def layer_summary(assigned: DataFrame, coherence: DataFrame, tiny: int = 5) -> DataFrame:
    """(layer, clusters, largest, tiny, average, least, most) of assigned (layer, id, cluster) and coherence (layer, cluster, coherence); clusters without coherence don't count in the last three."""
    sizes = assigned.groupBy("layer", "cluster").agg(F.count("*").alias("n"))
    rows = sizes.join(coherence.select("layer", "cluster", "coherence"), ["layer", "cluster"], "left")
    return rows.groupBy("layer").agg(
        F.count("*").alias("clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") < tiny).alias("tiny"),
        F.avg("coherence").alias("average"), F.min("coherence").alias("least"), F.max("coherence").alias("most"),
    )


def top_issues(reviewed: DataFrame, limit: int) -> DataFrame:
    """Reviewed rows (id, severity, verdict, flags) that failed or carry flags, worst first; ties by id. The limit is the report's."""
    odd = reviewed.where((F.col("verdict") != "pass") | (F.size("flags") > 0))
    fail = (F.col("verdict") == "fail").cast("int")
    return odd.orderBy(F.desc("severity"), fail.desc(), F.size("flags").desc(), "id").limit(limit)


def weakest_labels(labels: DataFrame, limit: int = 5) -> DataFrame:
    """The labels (cluster, label, confidence) of least confidence, then least cluster."""
    return labels.orderBy("confidence", "cluster").limit(limit)


def latest_by_title(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, id): for each of titles, the last entry (ord, id, title) of that title, whatever its case; titles without one are left out."""
    last = entries.groupBy(F.lower("title").alias("key")).agg(F.max_by("id", "ord").alias("id"))
    return titles.join(last, F.lower(titles["title"]) == F.col("key")).select("title", "id")


def find_titles(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """(title, id): for each wanted title, maybe with ' (year)', the entity (ord, id, title, year) of the same plain title: the first of that year, else the first of the least year (null as 0)."""
    part = X.split_title_year(F.col("title"))
    w = wanted.select("title", part["year"].alias("target"), X.plain_label(part["title"]).alias("key"))
    e = entities.select("ord", "id", F.coalesce("year", F.lit(0)).alias("year"), "title").select("ord", "id", "year", X.plain_label(F.coalesce("title", F.lit(""))).alias("key"))
    order = F.struct(F.when(F.col("year") == F.col("target"), 0).otherwise(1), F.when(F.col("year") == F.col("target"), 0).otherwise(F.col("year")), "ord")
    return w.join(e, "key").groupBy("title").agg(F.min_by("id", order).alias("id"))


def path_repeats(*labels: str) -> Column:
    """Whether any two of a path's labels are the same in plain form."""
    plain = F.array(*[X.plain_label(F.coalesce(F.col(c), F.lit(""))) for c in labels])
    return F.size(F.array_distinct(plain)) < len(labels)


def structural_flags(entities: DataFrame, points: DataFrame, paths: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(id, type, severity): entities without a point, and with repeated labels on their path (id, macro, neighborhood, micro); more: flags of the same form, of entities with a point."""
    missing = entities.join(points.select("id"), "id", "left_anti").select("id", F.lit("missing_point").alias("type"), F.lit(3).alias("severity"))
    there = entities.select("id").join(points.select("id"), "id", "left_semi")
    twice = there.join(paths.where(path_repeats(*LAYERS)), "id").select("id", F.lit("duplicate_path_label").alias("type"), F.lit(2).alias("severity"))
    out = missing.union(twice)
    return out if more is None else out.unionByName(more.join(there, "id", "left_semi").select("id", "type", "severity"))


def audit_rows(entities: DataFrame, flags: DataFrame, neighbors: DataFrame, top: int = 8) -> DataFrame:
    """(id, title, flags, worst, neighbors): one row per entity (id, title) with its flags by severity and name, and its first neighbours (src, nbr, rank) that are entities."""
    f = flags.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), "type"))).alias("f"))
    n = neighbors.where(F.col("rank") <= top).join(entities.select(F.col("id").alias("nbr")), "nbr", "left_semi")
    n = n.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "nbr"))).alias("n"))
    out = entities.join(f, "id", "left").join(n, "id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "id", "title", F.coalesce(F.transform("f", lambda x: x["type"]), none).alias("flags"), F.coalesce(-F.col("f")[0]["s"], F.lit(0)).alias("worst"),
        F.coalesce(F.transform("n", lambda x: x["nbr"]), F.array().cast("array<long>")).alias("neighbors"),
    )


def evidence_warnings(evidence: DataFrame, noisy: list[str], small: int = 3) -> DataFrame:
    """(cluster, noisy, small): the noisy ones among a cluster's terms (cluster, size, terms), in their order, and whether it has under `small` members."""
    return evidence.select("cluster", F.filter("terms", lambda t: t.isin(noisy)).alias("noisy"), (F.col("size") < small).alias("small"))


def neighbor_gap(circles: DataFrame, links: DataFrame) -> DataFrame:
    """(gap): mean distance between the rims of linked circles (cluster, x, y, r), by weight; of links (a, b, weight) in both directions the first by (a, b) counts; 0 without any."""
    c = lambda s: circles.select(F.col("cluster").alias(s), *[F.col(k).alias(f"{s}{k}") for k in "xyr"])
    pair = links.where("weight > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min_by("weight", F.struct("a", "b")).alias("weight"))
    at = pair.join(c("a"), "a").join(c("b"), "b")
    gap = F.greatest(F.lit(0.0), F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2) - F.col("ar") - F.col("br"))
    return at.agg(F.coalesce(F.try_divide(F.sum(gap * F.col("weight")), F.sum("weight")), F.lit(0.0)).alias("gap"))


def scaled(c, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """c moved from [low, high] to [to_low, to_high]; the middle where low = high."""
    ratio = F.try_divide(c - low, high - low)
    return F.coalesce(to_low + ratio * (to_high - to_low), F.lit((to_low + to_high) / 2))


def keyword_set(keywords, generic: list[str]) -> Column:
    """Different keywords in lower case, sorted, without empty and generic ones."""
    low = F.transform(keywords, F.lower)
    return F.array_sort(F.array_distinct(F.filter(low, lambda k: k.isNotNull() & (k != "") & ~k.isin(generic))))


def halton(index: Column, base: int) -> Column:
    """Halton's low-discrepancy value of a non-negative index: its digits mirrored behind the point."""
    digits = F.reverse(F.split(F.conv(index.cast("string"), 10, base), ""))
    return F.aggregate(F.zip_with(digits, F.sequence(F.lit(1), F.size(digits)), lambda d, i: F.conv(d, base, 10).cast("double") / F.pow(F.lit(float(base)), i)), F.lit(0.0), lambda s, x: s + x)


def cluster_evidence(assigned: DataFrame, values: DataFrame, representatives: DataFrame, coherence: DataFrame, top: int = 5, small: int = 3) -> DataFrame:
    """(cluster, size, values, representatives, coherence, small): one row per cluster of assigned (id, cluster), outliers (-1) aside.

    values (id, value): the `top` commonest of its members, as value:count, ties by value. representatives (cluster, id, rank), coherence
    (cluster, coherence). Sizes are counted on the assignments, so members without values count too.
    """
    own = assigned.where("cluster >= 0").select("id", "cluster")
    sizes = own.groupBy("cluster").agg(F.count("*").alias("size"))
    counted = own.join(values, "id").groupBy("cluster", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "value"))
    best = counted.withColumn("r", place).where(F.col("r") <= top)
    best = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "value", "n"))).alias("v"))
    reps = representatives.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("i"))
    out = sizes.join(best, "cluster", "left").join(reps, "cluster", "left").join(coherence.select("cluster", "coherence"), "cluster", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "cluster", "size", F.coalesce(F.transform("v", lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), none).alias("values"),
        F.coalesce(F.transform("i", lambda x: x["id"].cast("string")), none).alias("representatives"), "coherence", (F.col("size") < small).alias("small"),
    )


def specificity_suffix(words: Column, cascade: list[tuple[str, str]], otherwise: Column) -> Column:
    """The suffix of the first (part, suffix) whose part stands in the joined words, else otherwise."""
    low = F.lower(F.array_join(words, " "))
    out = None
    for part, suffix in cascade:
        out = F.when(F.contains(low, F.lit(part)), suffix) if out is None else out.when(F.contains(low, F.lit(part)), suffix)
    return otherwise if out is None else out.otherwise(otherwise)


def child_labels(children: DataFrame, parents: DataFrame, suffix: Column) -> DataFrame:
    """(cluster, label): labels of children (cluster, parent, label, ..), those that repeat the parent's plain label (cluster, label) with ': ' and suffix behind them."""
    p = parents.select(F.col("cluster").alias("parent"), F.col("label").alias("above"))
    same = X.plain_label(F.col("label")) == X.plain_label(F.col("above"))
    return children.join(p, "parent", "left").select("cluster", F.when(same, F.concat("label", F.lit(": "), suffix)).otherwise(F.col("label")).alias("label"))
