"""The journal's commits under failing tasks and replays; versioned caches."""

import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from semloom.operators.audit import last_results
from semloom.sources import journal as J
from semloom.sources.files import Files
from semloom.sources.versioned import Cache

LOG = J.RESULT


def results(spark, ids, verdict="pass", model="m", signature="s"):
    return spark.createDataFrame([(i, model, signature, verdict, None, 10) for i in ids], LOG)


def test_batches_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert J.read(spark, path, LOG).count() == 0
    J.append(results(spark, range(6)), path, "one")
    J.append(results(spark, range(6)), path, "one")  # a replay
    J.append(results(spark, [2, 3], "fail"), path, "two")
    J.append(results(spark, []), path, "none")
    rows = J.read(spark, path, LOG)
    assert rows.count() == 8 and len(os.listdir(f"{path}/commits")) == 3
    done = {r.id: r.verdict for r in J.completed(rows, "m", "s").collect()}
    assert done == {0: "pass", 1: "pass", 2: "fail", 3: "fail", 4: "pass", 5: "pass"}
    assert J.completed(rows, "other", "s").count() == 0 and J.usage(rows, "m", "s").first().tokens == 80
    order = rows.withColumn("ord", F.col("batch") * 1000 + F.col("place"))
    assert {r.id: r.verdict for r in last_results(order, "m").collect()} == done


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/log"
    J.append(results(spark, [1]), path, "first")

    @F.udf("string")
    def broken(i):
        if i == 7:
            raise ValueError("seven")
        return "pass"

    rows = results(spark, range(8)).repartition(4).withColumn("verdict", broken("id"))
    with pytest.raises(PythonException):
        J.append(rows, path, "second")
    assert [r.id for r in J.read(spark, path, LOG).collect()] == [1]
    J.append(results(spark, range(8)), path, "second")  # tried again as a whole
    assert J.read(spark, path, LOG).count() == 9


def test_attempts_that_ended_badly_and_torn_lines_are_not_read(spark, tmp_path):
    path = f"{tmp_path}/log"
    J.append(results(spark, [1, 2]).coalesce(1), path, "a")
    (name,) = os.listdir(f"{path}/parts")
    with open(f"{path}/parts/{name}", "ab") as f:
        f.write(b'{"id": 3, "model"\n[]\n')
    with Files(path).writing("parts/stray.jsonl") as f:  # an attempt nobody committed
        f.write(b'{"id": 9}\n')
    assert sorted(r.id for r in J.read(spark, path, LOG).collect()) == [1, 2]


def test_runs_go_on_where_they_broke(spark, tmp_path):
    path, asked = f"{tmp_path}/log", []
    todo = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, title string")

    def ask(part, left_out=(), stop=None):
        ids = [r.id for r in part.collect()]
        asked.extend(ids)
        if stop is not None and len(asked) > stop:
            raise RuntimeError("broken")
        rows = part.where(~F.col("id").isin(list(left_out)) if left_out else F.lit(True))
        return rows.select("id", F.lit("pass").alias("verdict"), F.lit(None).cast("string").alias("reason"), F.lit(5).alias("tokens"))

    with pytest.raises(RuntimeError):
        J.resume(todo, path, "m", "s", lambda p: ask(p, stop=9), batches=5)
    done = J.read(spark, path, LOG).count()
    assert 0 < done <= 9
    asked.clear()
    out = J.resume(todo, path, "m", "s", lambda p: ask(p, left_out=[19]), batches=2)
    assert len(asked) == 20 - done and len(set(asked)) == len(asked)
    assert {r.id for r in out.collect()} | {19} == set(range(20))


SCHEMA = "key string, value string, n int"


def test_later_versions_win_and_compaction_keeps_the_rows(spark, tmp_path):
    c = Cache(spark, f"{tmp_path}/c", SCHEMA, "key")
    assert c.read().count() == 0 and not c.exists()
    c.upsert(spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("b", "0", 1), (None, "x", 1)], SCHEMA))
    c.upsert(spark.createDataFrame([("b", "2", 2), ("c", "2", 2)], SCHEMA))
    want = [("a", "1", 1), ("b", "2", 2), ("c", "2", 2)]
    assert sorted(map(tuple, c.read().collect())) == want and len(c.versions()) == 2
    begun = c.read()
    c.compact()
    assert sorted(map(tuple, c.read().collect())) == want == sorted(map(tuple, begun.collect())) and len(c.versions()) == 1
    assert len(c.clean()) == 2 and sorted(map(tuple, c.read().collect())) == want


def test_a_version_that_fails_is_not_seen(spark, tmp_path):
    c = Cache(spark, f"{tmp_path}/c", SCHEMA, "key")
    c.upsert(spark.createDataFrame([("a", "1", 1)], SCHEMA))

    @F.udf("string")
    def broken(x):
        raise ValueError(x)

    with pytest.raises(PythonException):
        c.upsert(spark.createDataFrame([("a", "2", 2)], SCHEMA).withColumn("value", broken("value")))
    assert [tuple(r) for r in c.read().collect()] == [("a", "1", 1)]


def test_seeding_and_reuse(spark, tmp_path):
    c = Cache(spark, f"{tmp_path}/c", SCHEMA, "key")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "key string")
    one = spark.createDataFrame([("a", "one", 1), ("b", "one", 1), ("q", "one", 1)], SCHEMA)
    two = spark.createDataFrame([("b", "two", 2)], SCHEMA)
    assert Cache(spark, f"{tmp_path}/d", SCHEMA, "key").seed(wanted, []) == 0
    assert c.seed(wanted, [one, two]) == 2
    assert sorted(map(tuple, c.read().collect())) == [("a", "one", 1), ("b", "two", 2)]
    assert c.seed(wanted, [spark.createDataFrame([("z", "late", 3)], SCHEMA)]) == 2  # it is there
    made = []

    def make(missing):
        made.extend(r.key for r in missing.collect())
        return missing.where("key <> 'gone'").select("key", F.lit("new").alias("value"), F.lit(9).alias("n"))

    todo = spark.createDataFrame([("a", 1), ("z", 2), ("z", 3), ("gone", 4), (None, 5)], "key string, row int")
    got = {(r.key, r.row): (r.value, r.cached) for r in c.reuse(todo, make).collect()}
    assert got == {("a", 1): ("one", True), ("z", 2): ("new", False), ("z", 3): ("new", False), ("gone", 4): (None, False), (None, 5): (None, False)}
    assert sorted(made) == ["gone", "z"]
    assert all(r.cached for r in c.reuse(todo.where("key = 'z'"), make).collect()) and sorted(made) == ["gone", "z"]
