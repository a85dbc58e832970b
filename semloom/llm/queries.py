"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm import (
    fertility_rules,
    fuzzy_lines,
    lattice_lm,
    ngram_svm,
    periodic_runs,
    ring_sharding,
    simhash_neardup,
    skip_crf,
    soft_mixing,
    string_kernel,
    template_decontam,
    token_links,
    token_orc,
)
from semloom.llm.common import documents

#: Token shares of the mixture's domains.
TARGETS = {"clean": 0.90, "poor": 0.06, "toxic": 0.04}


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def bucket(n: int):
    """crc32 of doc_id as text, mod n: which rows are held out of learning. Null for a null doc_id, which has no label and isn't held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def domains(labelled: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled rows."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labelled.select("doc_id", domain.alias("domain"))


def op1_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_sharding.op1(documents(spark, sf_dir))


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.mix(documents(spark, sf_dir), domains(labels(spark, sf_dir)), TARGETS)


def op3_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = labels(spark, sf_dir).where(bucket(3) != 1).select("doc_id", F.col("quality").alias("label"))
    out = ngram_svm.quality(documents(spark, sf_dir), learn)
    return out.select("doc_id", F.coalesce(bucket(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(documents(spark, sf_dir))


def op6_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_crf.personal_data(documents(spark, sf_dir))


def op7_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(documents(spark, sf_dir))


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules.quality(documents(spark, sf_dir))


def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = labels(spark, sf_dir).where(bucket(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    out = string_kernel.toxicity(documents(spark, sf_dir), learn)
    return out.select("doc_id", F.coalesce(bucket(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.near_duplicates(documents(spark, sf_dir))


def repeated_tail(doc_id: int | None, words: list) -> list:
    """The words of a tenth of the documents end in a passage that repeats 3 to 11 times; a null doc_id changes nothing."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(documents(spark, sf_dir), repeated_tail)


def op12_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(documents(spark, sf_dir), bucket(10) == 0)


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.links(documents(spark, sf_dir))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict:
    return {}
