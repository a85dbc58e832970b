"""Methods side by side, and the selection score."""

import numpy as np
import pytest

from semloom.operators import comparison as M

SCHEMA = "id long, embedding array<double>"


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    means = r.normal(size=(4, 8)) * 3
    return spark.createDataFrame([(i, (means[i % 4] + 0.3 * r.normal(size=8)).tolist()) for i in range(80)], SCHEMA)


def test_metrics_of_known_clusters_and_outliers(spark, data):
    assigned = spark.createDataFrame([(i, -1 if i < 4 else i % 4) for i in range(80)], "id long, cluster int")
    m = M.evaluate("m", "n", data, assigned).first()
    assert (m.entities, m.clusters, m.outliers, m.largest, m.smallest, m.tiny, m.average_size) == (80, 4, 4, 19, 19, 0, 19.0)
    assert m.coherence > 0.9 and m.silhouette > 0.8
    cost = 5 / 14 + 4 / 80 * 2
    assert m.fragmentation == pytest.approx(cost) and m.labelability == pytest.approx(m.coherence + m.silhouette / 2 - cost)
    none = M.evaluate("m", "n", data, assigned.selectExpr("id", "-1 as cluster")).first()
    assert (none.clusters, none.outliers, none.labelability, none.silhouette) == (0, 80, None, None)
    alone = M.evaluate("m", "n", data, assigned.selectExpr("id", "id as cluster")).first()
    assert alone.silhouette is None and alone.coherence is None and alone.tiny == 80


def test_methods_in_the_order_asked_for(data):
    rows = M.compare(data, ["hdbscan", "lloyd", "hdbscan"], k=4).collect()
    assert [r.method for r in rows] == ["hdbscan", "lloyd"]
    assert rows[0].note.startswith("skipped") and rows[0].clusters is None and rows[0].entities == 80
    assert rows[1].entities == 80 and rows[1].clusters == 4
    with pytest.raises(ValueError):
        M.compare(data, ["other"])


def test_a_method_of_many_rounds_gives_its_row(spark):
    x = np.random.default_rng(3).normal(size=(4000, 32))
    row = M.compare(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).coalesce(1), ["lloyd"], k=5).first()
    assert (row.method, row.entities, row.clusters) == ("lloyd", 4000, 5)
