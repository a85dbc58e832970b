"""Invariants of iterative operators, sources, export and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from semloom.operators import iterative as I
from semloom.sources import export as E
from semloom.sources import records as R
from semloom.streaming import incremental as S

VEC = "id long, embedding array<double>"


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.eye(4)[i % 4] * 5 + r.normal(size=4) * 0.2]) for i in range(80)]
    return spark.createDataFrame(rows, VEC)


def test_kmeans_finds_blobs_and_small_cases(spark, blobs):
    got = {r.id: r.cluster for r in I.kmeans(blobs, 4).collect()}
    assert all((got[i] == got[j]) == (i % 4 == j % 4) for i in range(40) for j in range(40))
    assert I.kmeans(blobs.where("id < 0")).count() == 0
    assert I.kmeans(blobs.where("id = 3")).first()["cluster"] == 0


def test_hierarchy_is_strictly_nested(spark, blobs):
    rows = I.hierarchy(blobs, 2, 4, 8).collect()
    assert len(rows) == 80
    for low, high, n in (("micro", "neighborhood", 8), ("neighborhood", "macro", 4)):
        up = {}
        for r in rows:
            assert up.setdefault(r[low], r[high]) == r[high]
        assert len(up) == n


def test_pca_equals_the_centred_projection(spark, blobs):
    x = np.array([r.embedding for r in blobs.orderBy("id").collect()])
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    want = c @ v[:2].T
    got = np.array([(r.x, r.y) for r in I.pca(blobs).orderBy("id").collect()])
    for j in range(2):
        assert np.allclose(got[:, j], want[:, j], atol=1e-6) or np.allclose(got[:, j], -want[:, j], atol=1e-6)
    assert tuple(I.pca(blobs.where("id = 1")).first())[1:] == (0.0, 0.0)


def test_nested_kmeans_in_blocks_of_parents_and_equal_vectors(spark, blobs, monkeypatch):
    monkeypatch.setattr(I, "CENTERS", 8)
    parents = blobs.select("id", (F.col("id") % 2).cast("long").alias("cluster"))
    rows = I.children(blobs, parents, 4).collect()
    assert len(rows) == 80 and len({r.child for r in rows}) == 4
    got = {r.id: r.child for r in rows}
    assert all((got[i] == got[j]) == (i % 4 == j % 4) for i in range(40) for j in range(40))
    same = blobs.where("id < 6").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    assert {r.child for r in I.children(same, parents.where("id < 6"), 4).collect()} <= {0, 1, 2, 3}
    assert I.children(blobs.where("id < 0"), parents.where("id < 0"), 4).count() == 0


def test_neighbours_of_equal_vectors_in_several_blocks(spark):
    from semloom.operators import neighbors as N

    r = np.random.default_rng(4)
    rows = [(i, [1.0, 0.0, 0.0] if i < 5000 else [0.0, 0.0, 0.0] if i < 5010 else [float(x) for x in r.normal(size=3)]) for i in range(5100)]
    got = {}
    for n in N.nearest(spark.createDataFrame(rows, VEC), 3, block=16).collect():
        got.setdefault(n.src, {})[n.rank] = n.nbr
    assert [got[i] for i in (0, 2, 4999)] == [{1: 1, 2: 2, 3: 3}, {1: 0, 2: 1, 3: 3}, {1: 0, 2: 1, 3: 2}]
    x = np.array([v for _, v in rows])
    x = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    for i in range(5010, 5100):
        sim = np.round(x @ x[i], 12)
        sim[i] = -9
        assert [got[i][k] for k in (1, 2, 3)] == np.lexsort((np.arange(len(x)), -sim))[:3].tolist()
    assert len(got) == 5100


def test_communities(spark):
    edges = spark.createDataFrame([(a + 10 * g, b + 10 * g, 1.0) for g in range(2) for a in range(4) for b in range(a)] + [(0, 10, 0.1)], "src long, dst long, weight double")
    c = {r.id: r.cluster for r in I.communities(edges).collect()}
    assert len(set(c.values())) == 2 and c[1] == c[2] != c[11]


def test_normalize_and_enrich(spark, tmp_path):
    detail = {
        "id": 501, "imdb_id": None, "external_ids": {"imdb_id": "tt1"}, "title": " Salt  Road ", "release_date": "2011-06-01", "runtime": 97, "original_language": "en",
        "overview": "A town.", "genres": [{"name": "Drama"}, {"name": " "}], "keywords": {"keywords": [{"name": "sea"}]}, "vote_count": 50,
        "credits": {"cast": [{"name": f"P{i}"} for i in range(12)], "crew": [{"job": "Director", "name": "Lena Ort"}, {"job": "Writer", "name": "Ann"}]}, "reviews": {"results": [{"content": "x" * 600}]},
    }
    (tmp_path / "d.json").write_text(json.dumps({"results": [detail, {"id": 502}]}))
    rows = {r.id: r for r in R.normalize(R.read_details(spark, str(tmp_path / "d.json"))).collect()}
    a = rows[501]
    assert (a.imdb_id, a.title, a.year, a.genres, a.directors, len(a.cast), len(a.reviews[0])) == ("tt1", "Salt Road", 2011, ["Drama"], ["Lena Ort"], 10, 500)
    assert rows[502].genres == [] and rows[502].title == ""
    assert [r.id for r in R.eligible(R.read_details(spark, str(tmp_path / "d.json")), 2000, "2024-01-01", 40, 10).collect()] == [501]
    links = spark.createDataFrame([(1, 501), (2, 501), (3, 999)], "movieId int, tmdbId long")
    scores = spark.createDataFrame([(2, 5, 0.9), (2, 6, 0.9), (2, 7, 0.1), (2, 8, 0.5), (1, 5, 0.99)], "movieId int, tagId int, relevance double")
    tags = spark.createDataFrame([(5, "sea"), (6, "town"), (7, "low")], "tagId int, tag string")
    e = R.normalize(R.read_details(spark, str(tmp_path / "d.json")))
    signals = R.tag_signals(e, links, scores, tags)
    assert [tuple(r) for r in signals.collect()] == [(501, ["town", "sea"])]
    syn = spark.createDataFrame([(0, "tt1", ["a"], "old"), (1, "tt1", ["b"], "new"), (2, "", ["c"], "no")], "ord int, imdb_id string, plot_tags array<string>, synopsis string")
    out = {r.id: r for r in R.enrich(e, signals, syn).collect()}
    assert out[501].synopsis == "new" and out[502].tags == [] and out[502].synopsis is None


def test_export_leaves_private_columns_out(spark, tmp_path):
    e = spark.createDataFrame([(i, f"t{i}", "secret") for i in range(5)], "id long, title string, reviews string")
    xy = spark.createDataFrame([(1, 0.5, 0.5)], "id long, x double, y double")
    layers = spark.createDataFrame([(1, 0, 0, 0)], "id long, macro int, neighborhood int, micro int")
    lists = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2), (102, 1, 0.7, 1)], "src long, nbr long, sim double, rank int")
    E.export(str(tmp_path / "out"), e, xy, layers, lists)
    assert spark.read.json(str(tmp_path / "out/movies")).columns == ["id", "title"]
    assert spark.read.json(str(tmp_path / "out/points")).where("x = 0").count() == 4
    assert [n.nbr for n in E.neighbors_of(spark, str(tmp_path / "out"), 1).first()["neighbors"]] == [2, 3]


def test_embedding_cache_and_stream(spark, tmp_path):
    p = spark.createDataFrame([(1, "a", "one two"), (2, "b", "three"), (3, "a", "one two")], S.PROFILE).withColumn("tokens", F.lit(1_000_000))
    hashed = E.with_hash(p, "m")
    none = spark.createDataFrame([], "hash string, embedding array<double>")
    every, new = E.embed(hashed, none, E.hashing_provider(8))
    assert every.count() == 3 and new.count() == 2
    assert E.embed(hashed, new, E.hashing_provider(8))[1].count() == 0
    with pytest.raises(ValueError, match="exceeds"):
        E.embed(hashed, none, E.hashing_provider(8), limit_usd=0.01)
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps({"id": r.id, "title": r.title, "profile": r.profile}) for r in p.collect()))
        S.run(spark, str(tmp_path / "in"), str(tmp_path / "cache"), str(tmp_path / "state"), "m", E.hashing_provider(8)).awaitTermination(60)
    got = {r.hash: r.embedding for r in spark.read.parquet(str(tmp_path / "cache")).collect()}
    assert got == {r.hash: r.embedding for r in new.collect()} and spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_providers_retry_halve_and_coerce(spark):
    from semloom.operators import providers as P

    seen = []

    def flaky(items):
        seen.append(len(items))
        if "bad" in items:
            raise ValueError
        return ['x {"label": " A  b ", "confidence": 7} y'] * len(items)

    assert P.ask(flaky, ["a", "bad", "c"], tries=1, wait=0)[1] is None and max(seen) == 3
    a = spark.createDataFrame([(1, 'x {"label": " A  b ", "confidence": 7} y'), (2, "junk"), (3, '{"label": "c", "confidence": "often"}'), (4, None)], "id long, answer string")
    got = {r.id: r for r in P.labels(a).collect()}
    assert (got[1].label, got[1].confidence) == ("A b", 1.0) and got[2].label is None and got[3].confidence == 0.5 and got[4].label is None
    p = spark.createDataFrame([(5, ["r"], ["g"], ["k"], ["t", "u"])], "id long, r array<string>, g array<string>, k array<string>, t array<string>")
    prompts = p.select("id", P.evidence_prompt(F.col("id"), F.col("r"), F.col("g"), F.col("k"), F.col("t")).alias("prompt"))
    assert P.labels(P.answers(prompts, P.template_labeler)).first()["label"] == "T U K"


def test_reports(spark):
    from semloom.operators import reports as M

    text = M.report("Map", {"Sizes": spark.createDataFrame([("a|b", 1234, 0.5, None)], "name string, n long, share double, none string"), "Note": "fine"})
    assert "| a\\|b | 1,234 | 0.500 | n/a |" in text and text.startswith("# Map") and M.percent(1, 0) == "0.0% (1/0)"
