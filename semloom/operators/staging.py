"""Tables written once in the folder that all executors share, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is broadcast; beyond, Spark shuffles.
SMALL = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where none is set, a temporary one if all runs in this process, else an error: executors don't see the driver's own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table below spark.checkpoint.dir: what reads it twice computes it once, and a lost executor rereads it."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_in_batches(df: DataFrame, rows: int) -> DataFrame:
    """kept(df), in which Python gets so many rows at a time: Spark bounds batches by rows alone, 10,000 where nothing is set, whatever their bytes."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = conf.get(name)
    conf.set(name, str(rows))
    try:
        return kept(df)
    finally:
        conf.set(name, old)


def few(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df
