"""The ring in sharding's plan: the right arc of every position, and no expression for each virtual node."""

from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from semloom.llm import ring_sharding


@pytest.mark.parametrize("shards, vnodes", [(24, 32), (5, 3), (1, 1)])
def test_arcs_by_halving_are_those_of_the_sorted_points(spark, shards, vnodes):
    at, _ = ring_sharding.ring(shards, vnodes)
    places = [0, ring_sharding.RING - 1, *(p + d for p in at for d in (-1, 0, 1) if 0 <= p + d < ring_sharding.RING)]
    rows = spark.createDataFrame([(p,) for p in places], "p long")
    got = rows.withColumn("arc", ring_sharding._search(at, F.col("p"))).collect()
    assert all(g.arc == bisect_left(at, g.p) % len(at) for g in got)


def test_the_plan_has_no_branch_for_each_virtual_node(spark):
    """Planning 768 nested comparisons took the pipeline over the driver's memory."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    plan = ring_sharding.op1(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("if (") + plan.count("CASE WHEN") < 50
