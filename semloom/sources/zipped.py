"""CSV members of zip files, read by the executors: one partition a member, decompressed as a stream, no copy on a local disk."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType, StructType

from semloom.sources.files import Files


class Member(InputPartition):
    def __init__(self, name: str):
        self.name = name


def cast(x: str | None, kind):
    """The field as its column's type; null if it is empty or isn't one."""
    if x is None or x == "":
        return None
    try:
        if isinstance(kind, IntegralType):
            return int(x)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(x)
    except ValueError:
        return None
    return x.strip().lower() == "true" if isinstance(kind, BooleanType) else x


class ZippedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.zip = options["path"].rsplit("/", 1)
        self.suffix, self.columns = options.get("member", ".csv"), [(f.name, f.dataType) for f in schema]

    def opened(self) -> zipfile.ZipFile:
        files = Files(self.folder)
        return zipfile.ZipFile(files.fs.open_input_file(f"{files.path}/{self.zip}"))  # seeks: the directory, then a member's bytes

    def partitions(self) -> list[Member]:
        with self.opened() as z:
            return [Member(n) for n in sorted(z.namelist()) if n.endswith(self.suffix)] or [Member("")]

    def read(self, partition: Member) -> Iterator[tuple]:
        if not partition.name:
            return
        with self.opened() as z, z.open(partition.name) as raw:
            for row in csv.DictReader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")):
                yield tuple(partition.name if name == "member" else cast(row.get(name), kind) for name, kind in self.columns)


class ZippedSource(DataSource):
    """Format "zipped": options path (the zip file) and member (suffix of the members to read). A column named member tells where a row is from."""

    @classmethod
    def name(cls) -> str:
        return "zipped"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedReader(self.options, schema)


def read_zipped(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """Rows of all members with this suffix, by their headers: quoted fields may span lines, columns a member lacks and fields of another type are null. No such member gives no rows."""
    spark.dataSource.register(ZippedSource)
    return spark.read.format("zipped").schema(schema).option("path", path).option("member", member).load()
