"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, a temporary one if all runs in this process, as in tests, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: a lost executor rereads it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, for texts of 100 kB and more."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(col: str = "text"):
    """The text, '' for null."""
    return F.coalesce(F.col(col), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sample_texts(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """ids' columns and text for the first `rows` distinct rows of ids (doc_id, ...) by a hash of doc_id; one text of each, however often a doc_id repeats."""
    chosen = ids.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), *ids.columns).limit(rows)
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `rows` rows
    return found.groupBy(*ids.columns).agg(F.min("text").alias("text"))


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of undirected edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay the same. A node's
    smallest neighbour is a partial aggregate, and is joined back, so a hub's neighbours
    never meet in one task as a list; AQE splits a hub's join partition.
    Null nodes are dropped; no edges give no rows. Rounds grow with the log of the longest path; it is an error if `rounds` don't do.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc"
    )
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "cc")
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
