"""Keyed joins, first-wins dedupe, per-key top-k, counters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each key with their rank (long)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order. An aggregate, so map-side combined, where a window would move every row."""
    rest = [c for c in df.columns if c not in keys + order]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col("_first")[c].alias(c) for c in order + rest])


def counter(df: DataFrame, key: str, k: int) -> DataFrame:
    """(value, n, rank): commonest values; ties by value."""
    n = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "value").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")).cast("long"))


def missing_fields(df: DataFrame, key: str, fields: list[str], k: int) -> DataFrame:
    """(key, missing): names of null, empty or zero fields, for the k first rows that have any."""
    def gone(c):
        kind = dict(df.dtypes)[c]
        empty = F.col(c) == "" if kind == "string" else F.size(c) == 0 if kind.startswith("array") else F.col(c) == 0
        return F.col(c).isNull() | empty
    names = F.array_compact(F.array(*[F.when(gone(c), F.lit(c)) for c in fields]))
    return df.select(key, F.array_join(names, ", ").alias("missing")).where("missing <> ''").orderBy(key).limit(k)


def share(df: DataFrame, name: str, predicate: Column) -> DataFrame:
    """(name, hits, total, share): how many rows meet the predicate; 0.0 of none."""
    got = df.agg(F.count_if(predicate).alias("hits"), F.count("*").alias("total"))
    return got.select(F.lit(name).alias("name"), "hits", "total", F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)).alias("share"))


def cache_misses(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose content key isn't in the cache."""
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int"))


def status_tags(rating: Column, votes: Column, reach: Column) -> Column:
    """Array of reception, audience and status tags: independent ladders over rating, votes and reach (null: 0)."""
    r, v, p = (F.coalesce(c, F.lit(0)) for c in (rating, votes, reach))
    reception = (
        F.when((r >= 8.0) & (v >= 1000), "reception: widely acclaimed").when((r >= 7.2) & (v >= 1000), "reception: well liked")
        .when((r <= 5.5) & (v >= 500), "reception: poorly received").when((r > 5.5) & (r < 7.0) & (v >= 1000), "reception: mixed mainstream")
    )
    scale = F.when((v >= 8000) | (p >= 120), "audience scale: blockbuster visibility").when(v >= 2500, "audience scale: mainstream visibility").when(v < 500, "audience scale: niche visibility")
    small = F.when((r >= 7.0) & (v < 800), "status: small-audience favorite")
    odd = F.when((r < 6.0) & (v >= 1000), "status: possible b-movie or misfire")
    return F.array_compact(F.array(reception, scale, small, odd))
