"""Multi-level communities: modularity rises, equals a plain computation, beats label propagation."""

import random
from collections import defaultdict

import pytest

from semloom.operators import louvain as L
from semloom.operators import neighbors as N
from semloom.operators.iterative import communities
from semloom.sources.tables import vectors

SCHEMA = "src long, dst long, weight double"


def plain(edges, of):
    m, inside, degree = sum(w for *_, w in edges), defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        degree[of[a]] += w
        degree[of[b]] += w
        if of[a] == of[b]:
            inside[of[a]] += w
    return sum(inside[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def planted(groups, size, inner, outer, seed=1):
    r = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0 + r.random()) for a in range(n) for b in range(a + 1, n) if r.random() < (inner if a // size == b // size else outer)]


def test_planted_groups_are_found(spark):
    edges = planted(6, 12, 0.6, 0.02)
    found, risen = L.louvain(spark.createDataFrame(edges, SCHEMA))
    of = {r.id: r.cluster for r in found.collect()}
    assert all(a < b for a, b in zip(risen, risen[1:])) and risen[-1] == pytest.approx(plain(edges, of))
    assert plain(edges, of) >= plain(edges, {i: i // 12 for i in range(72)}) - 1e-9
    sizes = [list(of.values()).count(c) for c in range(max(of.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True)


def test_two_cliques_pairs_loops_and_repeats(spark):
    clique = [(a, b, 1.0) for o in (0, 5) for a in range(o, o + 5) for b in range(a + 1, o + 5)]
    edges = [*clique, (4, 5, 0.5), (20, 21, 1.0), (21, 20, 1.0), (30, 30, 2.0)]
    found, risen = L.louvain(spark.createDataFrame(edges, SCHEMA))
    of = {r.id: r.cluster for r in found.collect()}
    assert len({of[i] for i in range(5)}) == 1 and len({of[i] for i in range(5, 10)}) == 1 and of[0] != of[9]
    assert of[20] == of[21] and list(of.values()).count(of[30]) == 1 and risen[-1] == pytest.approx(plain(edges, of))
    none, risen = L.louvain(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and risen == []


def test_at_least_label_propagation_on_the_neighbour_graph(spark, sf):
    graph = N.edges(N.nearest(vectors(spark, sf), 5)).persist()
    found, risen = L.louvain(graph)
    other = N.modularity(graph, communities(graph)).first().modularity
    assert risen[-1] >= other and N.modularity(graph, found).first().modularity == pytest.approx(risen[-1])
    graph.unpersist()


def test_rounds_write_no_tables_and_equal_plain_moves(spark, monkeypatch):
    written, kept = [], L.kept
    monkeypatch.setattr(L, "kept", lambda df: written.append(df) or kept(df))
    edges = planted(6, 12, 0.6, 0.02)
    _, risen = L.louvain(spark.createDataFrame(edges, SCHEMA))
    assert len(written) <= 2 + 2 * (len(risen) + 1)  # a level's graph and its packs, however many its rounds
