"""Caches keyed by content as versions of Parquet folders: upserts, seeding from other caches, reuse with a flag, compaction.

A version is a folder of new or changed rows; a small manifest, moved into its place, names the versions in order, so readers see a version whole or
not at all. Of rows of one key the latest version's counts. Compaction writes the rows that count as one version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semloom.sources.files import Files

MANIFEST = "manifest.json"
MANY = 16  # versions after which an upsert compacts


class Cache:
    """A cache of `schema` keyed by `key` below path."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key, self.files = spark, path.rstrip("/"), schema, key, Files(path.rstrip("/"))

    def versions(self) -> list[str]:
        found = self.files.read(MANIFEST)
        return json.loads(found)["versions"] if found else []

    def exists(self) -> bool:
        return self.files.exists(MANIFEST)

    def read(self) -> DataFrame:
        """One row a key: that of the latest version."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{v}").withColumn("_version", F.lit(n)) for n, v in enumerate(versions)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) == 1:
            return rows.drop("_version")
        last = Window.partitionBy(self.key).orderBy(F.desc("_version"))
        return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_version")

    def upsert(self, rows: DataFrame) -> None:
        """rows as the next version; of repeated keys within it the least row wins."""
        names = self.spark.createDataFrame([], self.schema).columns
        rest = [c for c in names if c != self.key]
        one = rows.select(*names).where(F.col(self.key).isNotNull())
        one = one.groupBy(self.key).agg(F.min(F.struct(*rest)).alias("r")).select(self.key, "r.*").select(*names)
        self._add(one, self.versions())
        if len(self.versions()) > MANY:
            self.compact()

    def compact(self) -> None:
        """The rows that count as one version. Folders of older versions stay for readers that have begun; see clean()."""
        if len(self.versions()) > 1:
            self._add(self.read(), [])

    def _add(self, rows: DataFrame, before: list[str]) -> None:
        name = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        self.files.place(MANIFEST, json.dumps({"versions": [*before, name]}).encode())

    def clean(self) -> list[str]:
        """Remove folders that no version needs; call it when no reader or writer is at work. Their names."""
        kept = set(self.versions())
        gone = [n for n in self.files.names("") if n.startswith("version-") and n not in kept]
        for n in gone:
            self.files.fs.delete_dir(f"{self.path}/{n}")
        return gone

    def seed(self, wanted: DataFrame, sources: list[DataFrame]) -> int:
        """Fill a cache that isn't there yet with the wanted keys' rows of other caches; later sources override. Keys in it then; nothing happens if it exists."""
        if not self.exists():
            names = self.spark.createDataFrame([], self.schema).columns
            every = [s.select(*names).withColumn("_from", F.lit(n)) for n, s in enumerate(sources)]
            if every:
                rows = every[0]
                for s in every[1:]:
                    rows = rows.unionByName(s)
                rows = rows.join(wanted.select(self.key).distinct(), self.key, "left_semi")
                last = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in names if c != self.key]), "_from").alias("r")).select(self.key, "r.*")
                if last.limit(1).count():
                    self.upsert(last)
        return self.read().count()

    def reuse(self, todo: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """todo (key, ...) with the cache's columns and `cached`: whether the row was there before. What is missing is made once for each key and added.

        make: DataFrame of one row a missing key -> DataFrame of the cache's columns; keys it leaves out come back without values.
        """
        before = self.read()
        missing = todo.join(before.select(self.key), self.key, "left_anti").where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        had = list(self.versions())
        if missing.limit(1).count():
            self.upsert(make(missing))
        old = Cache(self.spark, self.path, self.schema, self.key)
        old.versions = lambda: had
        known = old.read().select(self.key, F.lit(True).alias("cached"))
        rest = [c for c in before.columns if c != self.key]
        out = todo.drop(*rest).join(self.read(), self.key, "left").join(known, self.key, "left")
        return out.withColumn("cached", F.coalesce("cached", F.lit(False)))
