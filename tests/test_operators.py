"""Operators on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from semloom.functions import text as X
from semloom.operators import clusters as C
from semloom.operators import layout as L
from semloom.operators import neighbors as N
from semloom.operators.staging import kept_in_batches
from semloom.operators import relational as R
from semloom.operators import rules as S
from semloom.operators import search as B

VEC = "id long, cluster int, embedding array<float>"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


def test_nearest_leaves_self_out_and_breaks_ties_by_id(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.0, 1.0]), (4, 1, [0.0, 2.0]), (5, 1, [0.0, 0.0]), (6, 1, None)], VEC)
    got = {(r.src, r["rank"]): r.nbr for r in N.nearest(v, 2, block=2).collect()}
    assert got[1, 1] == 2 and got[3, 1] == 4 and got[4, 1] == 3
    assert (5, 1) in got and got[5, 1] == 1  # a zero vector is as far from all
    assert not any(r == 6 for r, _ in got)


def test_coherence_equals_mean_pairwise_cosine(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 1.0]), (3, 0, [0.0, 2.0]), (4, 1, [1.0, 0.0])], VEC)
    got = {r.cluster: r.coherence for r in C.coherence(v).collect()}
    assert got[0] == pytest.approx((2 * math.sqrt(0.5) + 0) / 3) and got[1] is None


def test_allocation_keeps_its_total_and_caps(spark):
    p = spark.createDataFrame([(10, 12), (20, 5), (30, 1)], "parent int, n long")
    got = {r.parent: r.children for r in C.allocate_children(p, 9).collect()}
    assert sum(got.values()) == 9 and got[30] == 1 and all(1 <= got[k] <= n for k, n in ((10, 12), (20, 5)))
    assert all(r.children == 1 for r in C.allocate_children(p, 2).collect())


def test_agreement_of_relabelled_clusters_is_one(spark):
    p = spark.createDataFrame([(1, 7), (1, 7), (2, 5), (2, 5)], "a int, b int")
    assert tuple(C.agreement(p).first()) == (1.0, 1.0)


def test_empty_inputs(spark):
    v = spark.createDataFrame([], VEC)
    assert N.nearest(v, 3).count() == 0 and C.coherence(v).count() == 0
    assert C.silhouette(v).first()[0] is None and C.balance(v).first()["penalty"] == 80.0


def test_rerank_moves_the_contextual_neighbour_up(spark):
    n = spark.createDataFrame([(1, 2, 0.95, 1), (1, 3, 0.94, 2)], "src long, nbr long, sim double, rank int")
    c = spark.createDataFrame(
        [(1, 0, 0, 0, ["Horror"], ["witch"]), (2, 1, 1, 1, ["Comedy"], ["pie"]), (3, 0, 0, 0, ["Horror"], ["witch"])],
        "id long, macro int, neighborhood int, micro int, genres array<string>, keywords array<string>",
    )
    rows = N.rerank(n, c, 12).orderBy("rank").collect()
    assert [r.nbr for r in rows] == [3, 2] and rows[0].sim == 0.94  # the similarity itself stays


def test_text_functions(spark):
    assert one(spark, X.clean, " a \n b ") == "a b"
    assert one(spark, X.collapse_marks, "wow!!! so... ok") == "wow! so. ok"
    assert one(spark, lambda c: F.array_join(X.collapse_repeats(F.split(c, " ")), " "), "eerie Eerie eerie! night eerie") == "eerie Eerie night eerie"
    assert one(spark, lambda c: X.redact(c, F.array(F.lit("her"))), "There Her other") == "Te ot"
    assert one(spark, lambda c: X.budget(F.split(c, "/"), 6), "abcd/efgh/ij") == ["abcd", "ef"]
    assert one(spark, X.token_estimate, "") == 0 and one(spark, X.token_estimate, "one two three") == 5
    assert one(spark, lambda c: X.shorten(c, 6), "abcde fgh") == "abcde..."
    assert one(spark, lambda c: X.split_title_year(c)["year"], "Night (2010)") == 2010
    assert one(spark, X.clean, None) is None


def test_first_wins_and_cache(spark):
    d = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None)], "id long, ord int, v string")
    assert {(r.id, r.v) for r in R.first_wins(d, ["id"], ["ord"]).collect()} == {(1, "a"), (2, None)}
    assert R.cache_misses(d, d.where("v = 'a'"), "v").count() == 2


def test_rules_apply_in_order(spark):
    c = spark.createDataFrame([(1, "x"), (2, "y")], "cluster int, label string")
    r = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "cluster int, ord int, new_label string")
    assert dict(S.final_labels(c, r).collect()) == {1: "b", 2: "y"}
    assert sorted((x.ord, x.old, x.new) for x in S.label_log(c, r).collect()) == [(1, "x", "a"), (3, "a", "b")]


def test_search_and_geometry(spark):
    n = spark.createDataFrame([(1, "Moon", "1999", "Moon x"), (2, "Moonlit", "2000", "z"), (3, "Blue moon", "2001", "q")], "id long, title string, year string, everything string")
    assert [r.id for r in B.search(n, "moon").collect()] == [1, 2, 3] and B.search(n, "m").count() == 0
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "id long, x double, y double")
    q = spark.createDataFrame([(9, 0.1, 0.0), (8, 5.0, 5.0)], "probe long, px double, py double")
    assert [(r.probe, r.id) for r in L.hits(p, q, 0.5).collect()] == [(9, 1)]


def test_blocks_grow_with_the_table_and_python_gets_few_pairs_at_a_time(spark):
    assert N.block_size(10_000) == 2048 and N.block_size(300_000) == 7500 and N.block_size(3_000_000) == 16_384
    assert all((n / N.block_size(n)) ** 2 / 2 <= 810 for n in (50_000, 200_000, 600_000))  # pairs of blocks, each of which is shuffled
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []

    class Pairs:
        sparkSession = spark

        @property
        def write(self):
            seen.append(spark.conf.get(name))
            raise RuntimeError

    with pytest.raises(RuntimeError):
        kept_in_batches(Pairs(), 4)
    assert seen == ["4"] and spark.conf.get(name) == before
