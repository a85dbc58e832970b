"""The sweep over k against single fits and plain Lloyd rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semloom.operators import sweep
from semloom.operators.clusters import coherence

SCHEMA = "id long, embedding array<double>"


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    means = r.normal(size=(7, 6)) * 2
    rows = [(i, (means[i % 7] + r.normal(size=6)).tolist()) for i in range(210)]
    return spark.createDataFrame(rows, SCHEMA)


def lloyd(data, k):
    """{id: center number} of plain Lloyd rounds from the same starts."""
    rows = data.withColumn("h", F.xxhash64("id", F.lit(42))).orderBy("h", "id").collect()
    x = np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[:k].copy()
    for _ in range(200):
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[at == j].mean(0) for j in range(k)])
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return {r.id: int(a) for r, a in zip(rows, at)}


def test_models_equal_lloyd_and_single_fits(spark, data):
    made = sweep.fit(data, "3, 7,5,3")
    got = {}
    for r in made.assignments().collect():
        got.setdefault(r.k, {})[r.id] = r.cluster
    assert set(got) == {3, 5, 7} and all(made.rounds[k] > 1 for k in got)
    for k, mine in got.items():
        want = lloyd(data, k)
        assert len({(mine[i], want[i]) for i in want}) == k == len(set(mine.values()))
    alone = sweep.fit(data, [5])
    assert {r.id: r.cluster for r in alone.assignments().collect()} == got[5]
    key = lambda r: (r.k, r.cluster)
    assert [tuple(r) for r in sorted(alone.clusters.collect(), key=key)] == [pytest.approx(tuple(r)) for r in sorted(made.clusters.where("k = 5").collect(), key=key)]


def test_metrics(spark, data):
    made = sweep.fit(data, [4, 6])
    rows = {r.k: r for r in sweep.metrics(made.clusters).collect()}
    for k, r in rows.items():
        one = made.assignments().where(F.col("k") == k).join(data, "id")
        want = coherence(one.select("id", "cluster", "embedding")).collect()
        assert (r.clusters, r.entities, r.largest, r.smallest, r.tiny) == (k, 210, max(w.n for w in want), min(w.n for w in want), sum(w.n < 5 for w in want))
        assert r.coherence == pytest.approx(np.mean([w.coherence for w in want])) and r.note == "too broad"
        assert r.score == pytest.approx(r.coherence - abs(r.average_size - 14) / 14 - max(0, r.largest - 40) / 40 - r.tiny / k * 2)
    assert sum(r.recommended for r in rows.values()) == 1 and max(rows.values(), key=lambda r: (r.score, r.k)).recommended
    shown = sweep.samples(made.clusters, made.assignments(), data, show=2, each=3).collect()
    assert sorted((r.k, r.cluster) for r in shown) == [(4, 0), (4, 1), (6, 0), (6, 1)] and all(len(r.ids) == 3 for r in shown)


def test_odd_tables(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(5, [0.0, 1.0]), (6, [0.0, 0.0]), (7, None)]
    made = sweep.fit(spark.createDataFrame(rows, SCHEMA), [2, 9])
    assert sorted((r.k, r.cluster, r.n) for r in made.clusters.collect())[-3:] == [(9, 0, 5), (9, 1, 1), (9, 2, 1)]
    assert made.assignments().count() == 14
    none = sweep.fit(spark.createDataFrame([], SCHEMA), [2])
    assert none.clusters.count() == 0 and sweep.metrics(none.clusters).count() == 0 and none.assignments().count() == 0
    for bad in ([], [1, 3], "x"):
        with pytest.raises(ValueError):
            sweep.parse_ks(bad)


def test_models_that_do_not_rest_are_an_error(data):
    with pytest.raises(RuntimeError):
        sweep.fit(data, [6], rounds=1)


def test_models_that_need_many_rounds_come_to_rest(spark):
    x = np.random.default_rng(3).normal(size=(4000, 32))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).coalesce(1)
    made = sweep.fit(data, [5])
    assert made.rounds[5] > 61 and made.clusters.agg(F.sum("n")).first()[0] == 4000
    want = lloyd(data, 5)
    mine = {r.id: r.cluster for r in made.assignments().collect()}
    assert len({(mine[i], want[i]) for i in want}) == 5
