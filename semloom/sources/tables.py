"""Readers of the driver's tables and entity views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster, embedding)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), "embedding")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, macro, neighborhood, micro): a nested hierarchy over the vectors' labels."""
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.floor(label / 4).cast("int").alias("macro"), F.floor(label / 2).cast("int").alias("neighborhood"), label.alias("micro")
    )
