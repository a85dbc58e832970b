"""The inverted-file index against all pairs."""

import numpy as np
import pandas as pd

from semloom.operators import ivf
from semloom.operators.neighbors import nearest
from semloom.sources.tables import vectors

SCHEMA = "id long, embedding array<double>"


def cloud(n, groups, size=16, seed=1, spread=0.25):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, size))
    return [(i, (centers[i % groups] + spread * r.normal(size=size)).tolist()) for i in range(n)]


def rows(df):
    return sorted((r.src, r["rank"], r.nbr, round(r.sim, 9)) for r in df.collect())


def brute(data, k):
    ids, m = np.array([i for i, _ in data]), np.array([v for _, v in data])
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sims = m @ m.T
    out = []
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-sims[a, b], ids[b]))[:k]
        out += [(int(i), n + 1, int(ids[b]), round(float(sims[a, b]), 9)) for n, b in enumerate(order)]
    return sorted(out)


def test_exact_search_equals_all_pairs_and_few_probes_find_most(spark):
    data = cloud(1500, 40)
    v = spark.createDataFrame(data, SCHEMA)
    index = ivf.build(v)
    assert len(index.centers) == 39 and index.members.count() == 1500
    assert rows(ivf.search(index, v, 6, probes=2, exact=True)) == brute(data, 6)
    got = ivf.recall(ivf.search(index, v, 6, probes=4), nearest(v, 6)).first()
    assert got.pairs == 9000 and got.recall >= 0.95
    assert ivf.pairs_compared(index, 4) < 1500 * 1500 / 3


def test_vectors_without_groups(spark):
    data = cloud(300, 300, size=8)
    v = spark.createDataFrame(data, SCHEMA)
    assert rows(ivf.search(ivf.build(v, 12), v, 5, probes=1, exact=True)) == brute(data, 5)


def test_a_cell_of_most_rows_is_many_packs(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PACK", 32)
    data = [(i, v) for i, (_, v) in enumerate(cloud(250, 1, spread=0.01) + cloud(50, 25, seed=2))]
    v = spark.createDataFrame(data, SCHEMA)
    index = ivf.build(v, 8)
    assert max(len(r["rows"]) for r in ivf._packs(index.members, ["id"]).collect()) < 90
    assert rows(ivf.search(index, v, 4, exact=True)) == brute(data, 4)


def test_odd_vectors(spark):
    data = cloud(40, 4, size=3) + [(90, [0.0, 0.0, 0.0]), (91, [0.0, 0.0, 0.0])] + [(50 + i, [1.0, 2.0, 3.0]) for i in range(5)]
    v = spark.createDataFrame([*data, (99, None)], SCHEMA)
    index = ivf.build(v, 5)
    assert rows(ivf.search(index, v, 7, probes=2, exact=True)) == brute(data, 7)
    few = spark.createDataFrame(data[:3], SCHEMA)
    assert rows(ivf.search(ivf.build(few), few, 10, exact=True)) == brute(data[:3], 10)
    none = spark.createDataFrame([], SCHEMA)
    assert ivf.search(ivf.build(none), none, 3).count() == 0 and ivf.search(ivf.build(none), few, 3).count() == 0
    assert ivf.search(index, none, 3).count() == 0


def test_pairs_grow_below_the_square(spark):
    small, large = (ivf.build(spark.createDataFrame(cloud(n, 60), SCHEMA)) for n in (400, 1600))
    assert ivf.pairs_compared(large) < 10 * ivf.pairs_compared(small)  # the square would be 16 times


def test_tuned_probes_reach_the_recall_on_the_given_table(spark, sf):
    v = vectors(spark, sf).select("id", "embedding")
    index = ivf.build(v)
    probes = ivf.tuned_probes(index, 10)
    assert ivf.recall(ivf.search(index, v, 10, probes), nearest(v, 10)).first().recall >= 0.95
    grouped = ivf.build(spark.createDataFrame(cloud(800, 28, spread=0.02), SCHEMA))
    assert ivf.tuned_probes(grouped, 5) <= 3
    assert ivf.tuned_probes(ivf.build(spark.createDataFrame([], SCHEMA)), 5) == 1


def test_python_yields_few_rows_of_a_query_and_a_cell_at_a_time():
    pdf = pd.DataFrame({"id": range(1000)})
    parts = list(ivf._parts([pdf, pdf[:0]], 300))
    assert max(len(p) * 300 for p in parts) <= ivf.ASKED and [i for p in parts for i in p["id"]] == list(range(1000))
    assert [len(p) for p in ivf._parts([pdf[:2]], 10**6)] == [1, 1]
