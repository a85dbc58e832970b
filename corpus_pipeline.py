"""From raw documents to shards: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Quality rules, near-dedup, decontamination and mixing judge each row by itself under a key of its own
(a 64-bit hash of all its columns), whatever its doc_id; near-dedup leaves one of rows equal in all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm import fertility_rules, ring_sharding, simhash_neardup, soft_mixing, template_decontam
from semloom.llm.common import documents, new_path
from semloom.llm.queries import TARGETS, domains, labels

SHARDS = 24


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with column row: a hash of all columns, in which null differs from any value."""
    return docs.withColumn("row", F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns]))


def _by_row(rows: DataFrame) -> DataFrame:
    """rows of _keyed with the key in place of doc_id."""
    return rows.withColumn("doc_id", F.col("row")).drop("row")


def _keep_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of _keyed whose key is among the doc_ids of keys, without the key."""
    return rows.join(keys.select(F.col("doc_id").alias("row")), "row", "left_semi").drop("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep."""
    rows = _keyed(docs)
    return _keep_rows(rows, fertility_rules.quality(_by_row(rows)).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row of least doc_id (null after all others, then by key); of rows equal in all columns, one."""
    rows = _keyed(docs)
    groups = simhash_neardup.near_duplicates(_by_row(rows)).select(F.col("doc_id").alias("row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    best = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(first.alias("first"))
    return rows.join(best.select("first.row"), "row", "left_semi").dropDuplicates(["row"]).drop("row")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents free of benchmark passages."""
    rows = _keyed(docs)
    found = template_decontam.contamination(_by_row(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keep_rows(rows, found.where(~F.col("contaminated")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Clean documents, and the others drawn by their rate, at most once each, so that their token shares beside the clean ones come to the targets."""
    rows = _keyed(docs)
    mixed = soft_mixing.mix(_by_row(rows), domains(labels(spark, sf_dir)), TARGETS, most=1.0, held="clean", texts=docs)
    return _keep_rows(rows, mixed.where("copies > 0"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and place in it."""
    return ring_sharding.op1(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The stages are models and graph searches, beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's table lies in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
