"""Sanitised, sharded export, and append-only caches keyed by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.operators.relational import cache_misses

#: Columns that may leave: nothing else of an entity is exported.
PUBLIC = ("id", "title", "original_title", "year", "genres", "overview")


def public_points(entities: DataFrame, coordinates: DataFrame, layers: DataFrame) -> DataFrame:
    """(id, x, y, macro, neighborhood, micro) of all entities: missing places are 0.0, missing clusters null."""
    out = entities.select("id").join(coordinates, "id", "left").join(layers, "id", "left")
    return out.select("id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), "macro", "neighborhood", "micro")


def neighbor_shards(lists: DataFrame, shards: int = 100) -> DataFrame:
    """(shard, src, neighbors): a row per source with its neighbours in order."""
    packed = lists.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr", "sim"))).alias("neighbors"))
    return packed.withColumn("shard", F.pmod("src", F.lit(shards)).cast("int"))


def export(path: str, entities: DataFrame, coordinates: DataFrame, layers: DataFrame, lists: DataFrame, shards: int = 100) -> None:
    """Write movies, points and neighbours (a folder per shard, so that a reader of one id opens one)."""
    entities.select(*[c for c in PUBLIC if c in entities.columns]).write.mode("overwrite").json(f"{path}/movies")
    public_points(entities, coordinates, layers).write.mode("overwrite").json(f"{path}/points")
    neighbor_shards(lists, shards).repartition("shard").write.mode("overwrite").partitionBy("shard").json(f"{path}/neighbors")


def neighbors_of(spark: SparkSession, path: str, id: int, shards: int = 100) -> DataFrame:
    """One entity's neighbours: the shard filter prunes to one folder."""
    rows = spark.read.schema("src long, neighbors array<struct<rank:int,nbr:long,sim:double>>, shard int").json(f"{path}/neighbors")
    return rows.where((F.col("shard") == id % shards) & (F.col("src") == id))


def with_hash(profiles: DataFrame, model: str) -> DataFrame:
    """profiles (id, title, profile) with the content key of a model's vector."""
    return profiles.withColumn("hash", F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), "title", "profile")), 256))


def embed(profiles: DataFrame, cache: DataFrame, provider, limit_usd: float | None = None, usd_per_million: float = 0.13) -> tuple[DataFrame, DataFrame]:
    """(all vectors, new vectors) of profiles (id, hash, profile, tokens): cached ones are read, the others made by `provider`.

    provider: DataFrame (hash, profile) -> DataFrame (hash, embedding), such as a mapInPandas call of a remote service. Equal
    contents are made once. A run whose estimated cost exceeds limit_usd is refused before anything is made.
    """
    todo = cache_misses(profiles, cache, "hash").dropDuplicates(["hash"])
    if limit_usd is not None:
        cost = (todo.agg(F.sum("tokens")).first()[0] or 0) * usd_per_million / 1e6
        if cost > limit_usd:
            raise ValueError(f"estimated cost {cost:.4f} USD exceeds {limit_usd:.4f}")
    new = provider(todo.select("hash", "profile"))
    every = cache.select("hash", "embedding").unionByName(new.select("hash", "embedding"))
    return profiles.join(every, "hash").select("id", "hash", "embedding"), new


def hashing_provider(size: int = 64):
    """A provider without a service: words hashed to signed components, unit length."""

    def make(todo: DataFrame) -> DataFrame:
        words = todo.select("hash", F.explode(F.split(F.lower("profile"), r"\s+")).alias("w"))
        parts = words.select("hash", F.pmod(F.xxhash64("w"), F.lit(size)).cast("int").alias("pos"), F.when(F.xxhash64("w", F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("s"))
        sums = parts.groupBy("hash", "pos").agg(F.sum("s").alias("s"))
        maps = sums.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("pos", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") ** 2)).alias("n"))
        array = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i), F.col("n")), F.lit(0.0)))
        return maps.select("hash", array.alias("embedding"))

    return make
