"""A resumable log: rows appended in batches that are committed whole and once, and what is still to do after a broken run.

Each task writes its rows to a file of its own attempt; the driver's commit names the files of the attempts that ended well in one small file, moved into its place.
Readers see only files that a commit names, so a task that is tried again doubles no row, and a batch that fails leaves none. A batch committed
before isn't written again when it is replayed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from semloom.sources.files import Files


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class JournalWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.batch, self.columns = options["path"], options.get("batch") or uuid.uuid4().hex, schema.fieldNames()

    def write(self, rows: Iterator[Row]) -> Written:
        files, n = Files(self.path), 0
        name = f"parts/{self.batch}-{uuid.uuid4().hex}.jsonl"  # of this attempt alone
        with files.writing(name) as out:
            for row in rows:
                out.write(json.dumps(row.asDict(True), default=str).encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        files = Files(self.path)
        done = [m for m in messages if m is not None]
        name = f"commits/{self.batch}.json"
        if files.exists(name):  # a replay
            return self.abort(messages)
        order = len(files.names("commits"))
        files.place(name, json.dumps({"order": order, "files": [m.name for m in done if m.rows], "rows": sum(m.rows for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files = Files(self.path)
        for m in messages:
            if m is not None:
                files.remove(m.name)


class Part(InputPartition):
    def __init__(self, name: str, order: int):
        self.name, self.order = name, order


class JournalReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns = options["path"], schema.fieldNames()

    def partitions(self) -> list[Part]:
        files = Files(self.path)
        commits = [json.loads(files.read(f"commits/{n}")) for n in files.names("commits") if n.endswith(".json")]
        return [Part(name, c["order"]) for c in commits for name in c["files"]] or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.name:
            return
        for place, line in enumerate((Files(self.path).read(partition.name) or b"").splitlines()):
            try:
                row = json.loads(line)
            except ValueError:
                continue  # a torn line
            if isinstance(row, dict):
                row |= {"batch": partition.order, "place": place}
                yield tuple(row.get(c) for c in self.columns)


class JournalSource(DataSource):
    """Format "journal": options path and, for writing, batch (a name; a batch is written once)."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def reader(self, schema: StructType) -> DataSourceReader:
        return JournalReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a journal is only appended to")
        return JournalWriter(self.options, schema)


def append(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """rows at the end of the journal; nothing if a batch of this name is there."""
    rows.sparkSession.dataSource.register(JournalSource)
    options = {"path": path} | ({"batch": batch} if batch else {})
    rows.write.format("journal").mode("append").options(**options).save()


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows with batch (order of the commits) and place; lines that aren't JSON are left out. No journal gives no rows."""
    spark.dataSource.register(JournalSource)
    return spark.read.format("journal").schema(f"{schema}, batch int, place int").option("path", path).load()


#: Rows of an audit's journal.
RESULT = "id long, model string, signature string, verdict string, reason string, tokens long"


def completed(log: DataFrame, model: str, signature: str) -> DataFrame:
    """(id, verdict, reason): the last result of each id under this model and signature; results without id or verdict don't count."""
    own = log.where((F.col("model") == model) & (F.col("signature") == signature) & F.col("id").isNotNull() & F.col("verdict").isNotNull())
    return own.groupBy("id").agg(F.max_by(F.struct("verdict", "reason"), F.struct("batch", "place")).alias("r")).select("id", "r.*")


def usage(log: DataFrame, model: str, signature: str) -> DataFrame:
    """(tokens): all tokens spent under this model and signature, repeated results included."""
    return log.where((F.col("model") == model) & (F.col("signature") == signature)).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def resume(todo: DataFrame, path: str, model: str, signature: str, ask: Callable[[DataFrame], DataFrame], batches: int = 8, name: str = "audit") -> DataFrame:
    """(id, verdict, reason) for every id of todo, asking only for those the journal doesn't have.

    ask: DataFrame of todo's rows -> DataFrame (id, verdict, reason, tokens), such as a mapInPandas call of a service. The pending ids are dealt to `batches` commits
    by a hash, so a broken run loses one batch at most; ids that a service leaves out stay pending for the next call.
    """
    spark = todo.sparkSession
    left = todo.join(completed(read(spark, path, RESULT), model, signature).select("id"), "id", "left_anti")
    run = uuid.uuid4().hex[:12]
    for n in range(batches):
        part = left.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == n)
        made = ask(part).select("id", F.lit(model).alias("model"), F.lit(signature).alias("signature"), "verdict", "reason", F.col("tokens").cast("long").alias("tokens"))
        append(made, path, f"{name}-{run}-{n:04d}")
    return todo.select("id").distinct().join(completed(read(spark, path, RESULT), model, signature), "id")
