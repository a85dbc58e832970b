"""A paged, filtered record service as a Spark data source, and lookups by id.

`spark.read.format("paged")` reads a service page by page: one partition a page, filters on the columns the service knows are pushed to it,
failed requests are tried again. The service is a client object, made from the option `client` ("module:function") with the options;
without it, `path` holds the pages as files (see FilePages), on any file system that pyarrow opens.

A client has total(params) -> number of pages, page(number, params) -> records as dicts, and details(id) -> a dict or None; params are the pushed filters,
(column, operator, value) each. A client raises Failed(status, wait) for an answer that isn't one.
"""

from __future__ import annotations

import datetime
import importlib
import json
import operator
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import DateType, StructType, TimestampType

from semloom.sources.files import Files

#: Statuses that are tried again.
AGAIN = frozenset({429, 500, 502, 503, 504})
ATTEMPTS = 4
OPERATORS = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda x, v: x in v, "there": lambda x, v: True}
PUSHED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", IsNotNull: "there"}


class Failed(Exception):
    """A request's answer with an error status; wait: seconds the service asks for, if it does."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait

    def __reduce__(self):
        return Failed, (self.status, self.wait)


def tried(ask: Callable, attempts: int = ATTEMPTS, backoff: float = 0.5, sleep: Callable = time.sleep):
    """ask(), again after AGAIN statuses and broken connections: after the wait asked for, else backoff, doubled each time. The last failure is raised."""
    for n in range(attempts):
        try:
            return ask()
        except (Failed, ConnectionError) as e:
            if n + 1 == attempts or isinstance(e, Failed) and e.status not in AGAIN:
                raise
            sleep(e.wait if isinstance(e, Failed) and e.wait is not None else backoff * 2**n)


class FilePages:
    """Pages as files page-000001.json .. of {"total_pages", "results"}, details as files details/ID.json; the filters are applied as the service would."""

    def __init__(self, path: str):
        self.files = Files(path)

    def read(self, name: str):
        found = self.files.read(name)
        return None if found is None else json.loads(found)

    def total(self, params: list) -> int:
        first = self.read("page-000001.json")
        return first["total_pages"] if first else 0

    def page(self, number: int, params: list) -> list[dict]:
        found = self.read(f"page-{number:06d}.json")
        rows = found["results"] if found else []
        return [r for r in rows if all(r.get(c) is not None and OPERATORS[op](r[c], v) for c, op, v in params)]

    def details(self, key):
        return self.read(f"details/{key}.json")


def client_of(options: dict):
    if name := options.get("client"):
        module, function = name.split(":")
        return getattr(importlib.import_module(module), function)(options)
    return FilePages(options["path"])


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options, self.params = [(f.name, f.dataType) for f in schema], dict(options), []
        self.known = [c.strip() for c in options.get("filterable", "").split(",") if c.strip()]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the service's columns go to it; the others are Spark's."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if type(f) in PUSHED and column in self.known:
                value = getattr(f, "value", None)
                value = list(value) if isinstance(value, (list, tuple)) else value
                if isinstance(value, (datetime.date, datetime.datetime)):
                    value = value.isoformat()  # as in the records
                self.params.append((column, PUSHED[type(f)], value))
            else:
                yield f

    def partitions(self) -> list[Page]:
        client = client_of(self.options)
        return [Page(n + 1) for n in range(tried(lambda: client.total(self.params)))] or [Page(0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.number:
            return
        client = client_of(self.options)
        for place, row in enumerate(tried(lambda: client.page(partition.number, self.params))):
            row = {**row, "page": partition.number, "place": place}
            yield tuple(self.value(row.get(name), kind) for name, kind in self.columns)

    @staticmethod
    def value(x, kind):
        if x is not None and isinstance(kind, DateType):
            return datetime.date.fromisoformat(x)
        if x is not None and isinstance(kind, TimestampType):
            return datetime.datetime.fromisoformat(x)
        return x


class PagedSource(DataSource):
    """Format "paged": options client or path, filterable (columns the service filters by), and those of the client. Columns page and place tell where a record stood."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


def paged(spark: SparkSession, schema: str, **options) -> DataFrame:
    """The service's records with columns page and place; filters on options["filterable"] reach the service."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").schema(f"{schema}, page int, place int").options(**options).load()


def discover(records: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The first record of each key, by page and place, in that order; at most `limit`."""
    order = F.struct("page", "place")
    first = records.groupBy(key).agg(F.min_by(F.struct(*records.columns), order).alias("r")).select("r.*")
    first = first.orderBy("page", "place")
    return first if limit is None else first.limit(limit)


def balanced(records: DataFrame, key: str, bucket, per_bucket: int) -> DataFrame:
    """At most `per_bucket` first records of each bucket (a column), then first wins for each key over all buckets in order."""
    from pyspark.sql import Window

    marked = records.withColumn("bucket", bucket)
    own = marked.withColumn("r", F.row_number().over(Window.partitionBy("bucket", key).orderBy("page", "place"))).where("r = 1")
    taken = own.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("page", "place"))).where(F.col("r") <= per_bucket)
    return taken.groupBy(key).agg(F.min_by(F.struct(*records.columns, "bucket"), F.struct("bucket", "page", "place")).alias("r")).select("r.*")


def lookup(ids: DataFrame, key: str, schema: str, **options) -> DataFrame:
    """(key, found, details): the service's details for each distinct id, asked once, many executors at a time; details as a struct of schema, null if there are none."""

    def work(batches):
        client = client_of(options)
        for pdf in batches:
            got = [tried(lambda i=i: client.details(i)) for i in pdf[key].tolist()]
            yield pd.DataFrame({key: pdf[key], "json": [None if g is None else json.dumps(g) for g in got]})

    kind = ids.schema[key].dataType.simpleString()
    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    rows = asked.mapInPandas(work, f"{key} {kind}, json string")
    return rows.select(key, F.col("json").isNotNull().alias("found"), F.from_json("json", schema).alias("details"))


def write_pages(rows: DataFrame, page: str, path: str) -> None:
    """rows as FilePages below path: column `page` numbers the pages from 1, a page's rows are a group of bounded size; other columns are the records, in order of all of them."""
    names = [c for c in rows.columns if c != page]
    total = rows.agg(F.max(page)).first()[0] or 0

    def work(batches):
        files = Files(path)
        for pdf in batches:
            for number, records in zip(pdf["page"], pdf["records"]):
                with files.writing(f"page-{number:06d}.json") as f:
                    f.write(b'{"page": %d, "total_pages": %d, "results": [%s]}' % (number, total, ",".join(records).encode()))
            yield pdf[["page"]]

    records = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    groups = rows.groupBy(F.col(page).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*names, records.alias("json")))), lambda r: r["json"]).alias("records"))
    groups.mapInPandas(work, "page int").agg(F.count("*")).collect()
