"""The paged source: pushed filters, retries, dedupe, truncation, lookups."""

import json

import pytest
from pyspark.sql import functions as F

from semloom.sources import paged as P

SCHEMA = "id long, title string, votes long, day string"


@pytest.fixture()
def folder(tmp_path):
    """Three pages of ten records; page 2 begins with the last record of page 1, and record 25 comes again as 3 with another title."""
    rows = [{"id": i, "title": f"t{i}", "votes": i * 10 if i % 7 else None, "day": f"20{10 + i % 15}-01-01"} for i in range(29)]
    pages = [rows[:10], rows[9:19], [*rows[19:28], {**rows[3], "title": "again"}]]
    for n, page in enumerate(pages, 1):
        (tmp_path / f"page-{n:06d}.json").write_text(json.dumps({"page": n, "total_pages": 3, "results": page}))
    (tmp_path / "details").mkdir()
    for i in (1, 2):
        (tmp_path / "details" / f"{i}.json").write_text(json.dumps({"runtime": i * 50, "tags": ["x", None], "other": 1}))
    return str(tmp_path)


def test_pages_are_partitions_and_filters_reach_the_service(spark, folder):
    rows = P.paged(spark, SCHEMA, path=folder, filterable="votes, day")
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 30
    asked = rows.where("votes >= 100 and day < '2020-01-01' and title <> 't12'")
    (kept,) = [line for line in asked._jdf.queryExecution().executedPlan().toString().split("\n") if line.strip(" +-*()0123456789").startswith("Filter")]
    assert "title" in kept and "votes" not in kept and "day" not in kept  # Spark keeps the title's alone
    assert {r.id for r in asked.collect()} == {i for i in range(28) if i % 7 and i >= 10 and i % 15 < 10 and i != 12}


def test_first_record_of_an_id_wins_and_the_limit_cuts(spark, folder):
    rows = P.paged(spark, SCHEMA, path=folder)
    got = P.discover(rows, "id").collect()
    assert [r.id for r in got] == list(range(28)) and got[3].title == "t3"
    assert [r.id for r in P.discover(rows, "id", 12).collect()] == list(range(12))
    got = P.balanced(rows, "id", F.col("page"), 4).collect()
    assert sorted((r.bucket, r.id) for r in got) == [(1, i) for i in range(4)] + [(2, i) for i in range(9, 13)] + [(3, i) for i in range(19, 23)]


def test_missing_pages_and_folders(spark, tmp_path):
    assert P.paged(spark, SCHEMA, path=str(tmp_path)).count() == 0
    (tmp_path / "page-000001.json").write_text(json.dumps({"total_pages": 2, "results": [{"id": 1}]}))
    assert [(r.id, r.title, r.page, r.place) for r in P.paged(spark, SCHEMA, path=str(tmp_path)).collect()] == [(1, None, 1, 0)]


def test_lookups_ask_once_for_each_id(spark, folder):
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id long")
    got = {r.id: (r.found, r.details) for r in P.lookup(ids, "id", "runtime int, tags array<string>", path=folder).collect()}
    assert got[1][1].runtime == 50 and got[2][1].tags == ["x", None] and got[3] == (False, None) and len(got) == 3


def test_retries():
    slept = []

    def failing(times, error):
        left = [error] * times

        def ask():
            if left:
                raise left.pop()
            return "answer"

        return ask

    assert P.tried(failing(3, P.Failed(503)), sleep=slept.append) == "answer" and slept == [0.5, 1.0, 2.0]
    assert P.tried(failing(1, P.Failed(429, 7.0)), sleep=slept.append) == "answer" and slept[-1] == 7.0
    assert P.tried(failing(2, ConnectionError()), sleep=slept.append) == "answer"
    with pytest.raises(P.Failed):
        P.tried(failing(4, P.Failed(500)), sleep=slept.append)
    n = len(slept)
    with pytest.raises(P.Failed):
        P.tried(failing(1, P.Failed(404)), sleep=slept.append)
    assert len(slept) == n


def flaky(options):
    """A client whose first answer for each page is a 503, kept in files so that tries of all workers count."""
    import os

    inner = P.FilePages(options["path"])

    class Client:
        total, details = inner.total, inner.details

        def page(self, number, params):
            mark = f"{options['path']}/asked-{number}"
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise P.Failed(503, 0.0)
            return inner.page(number, params)

    return Client()


def test_a_failing_service_is_asked_again_by_the_task(spark, folder):
    rows = P.paged(spark, SCHEMA, path=folder, client="test_paged:flaky")
    assert rows.count() == 30


def test_pages_written_by_spark_are_read_again(spark, tmp_path):
    rows = spark.range(95).select((F.floor(F.col("id") / 20) + 1).cast("int").alias("n"), "id", F.concat(F.lit('"q'), "id").alias("title"))
    P.write_pages(rows, "n", f"{tmp_path}/p")
    got = P.discover(P.paged(spark, "id long, title string", path=f"{tmp_path}/p", filterable="id").where("id >= 30"), "id", 40).collect()
    assert [(r.id, r.title, r.page) for r in got] == [(i, f'"q{i}', i // 20 + 1) for i in range(30, 70)]
