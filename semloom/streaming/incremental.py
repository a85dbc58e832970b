"""Streams of profiles: each content is embedded once, whichever batch brings it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.sources.export import with_hash

PROFILE = "id long, title string, profile string"


def distinct_contents(stream: DataFrame, model: str) -> DataFrame:
    """The first row of each content key, by streaming state."""
    return with_hash(stream, model).dropDuplicates(["hash"])


def run(spark: SparkSession, source: str, cache: str, checkpoint: str, model: str, provider):
    """Read profile files from `source`, append the vectors of new contents to the Parquet cache; returns the query.

    A batch is matched with the cache before it is made, so a replayed batch adds nothing twice.
    """
    stream = spark.readStream.schema(PROFILE).json(source)

    def batch(rows: DataFrame, _: int) -> None:
        hashed = with_hash(rows, model).dropDuplicates(["hash"])
        try:
            known = spark.read.schema("hash string, embedding array<double>").parquet(cache)
        except Exception as e:  # the first batch finds no cache
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "hash string, embedding array<double>")
        new = hashed.join(known.select("hash"), "hash", "left_anti")
        provider(new.select("hash", "profile")).select("hash", F.col("embedding").cast("array<double>")).write.mode("append").parquet(cache)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
