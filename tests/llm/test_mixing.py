"""Mixing by labels that the model doesn't see as such: what stays of each labelled domain."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from semloom.llm import queries, soft_mixing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    tokens = {r.doc_id: len(r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return {r.doc_id: (r.domain, tokens[r.doc_id]) for r in queries.domains(queries.labels(spark, SF)).collect()}


def test_labelled_shares_meet_the_targets(spark, labelled):
    """Labelled documents are a sample of all. Toxic ones hold 15.6 % of its tokens, 12 % of all by the model, so their share may lie that much higher."""
    mass = Counter()
    for r in queries.op2_soft_mixing(spark, SF).collect():
        if r.doc_id in labelled:
            domain, tokens = labelled[r.doc_id]
            mass[domain] += tokens * r.rate
    share = {d: mass[d] / mass.total() for d in queries.TARGETS}
    assert share["clean"] == pytest.approx(0.90, abs=0.03) and share["poor"] == pytest.approx(0.06, rel=1 / 3)
    assert share["toxic"] * 12 / 15.6 == pytest.approx(0.04, rel=1 / 3)


def test_stage_keeps_its_share_of_each_domain(spark, labelled):
    """Clean documents stay. Of the others so many are drawn as their targets ask for beside them, within three deviations of the draw."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert max(left.values()) == 1
    before, after, squares = Counter(), Counter(), Counter()
    for i, (domain, tokens) in labelled.items():
        before[domain] += tokens
        after[domain] += tokens * left[i]
        squares[domain] += tokens**2
    assert after["clean"] >= 0.99 * before["clean"]
    for domain in ("poor", "toxic"):
        rate = before["clean"] * queries.TARGETS[domain] / queries.TARGETS["clean"] / before[domain]
        assert abs(after[domain] - rate * before[domain]) < 3 * (rate * (1 - rate) * squares[domain]) ** 0.5, domain
        assert sum(left[i] for i, (d, _) in labelled.items() if d == domain) >= 5


def test_calibration_recovers_posteriors():
    r = np.random.default_rng(3)
    y = r.choice(3, 3000, p=[0.8, 0.15, 0.05])
    margins = np.eye(3)[y] * 1.5 + r.normal(0, 1, (3000, 3))
    p = soft_mixing.softmax(np.concatenate([margins, np.ones((3000, 1))], 1) @ soft_mixing.calibration(margins, y, 3))
    want = soft_mixing.softmax(1.5 * margins + np.log([0.8, 0.15, 0.05]))
    assert np.abs(p - want).mean() < 0.02 and p.mean(0) == pytest.approx([0.8, 0.15, 0.05], abs=0.02)


def test_domains_without_rows_and_no_rows():
    ids, ones = [np.array([i, i + 1], np.int32) for i in range(20)], np.ones(20, np.int64)
    made = soft_mixing.Domains(ids, np.repeat([0, 1], 10), ones, 3)
    p = made.posteriors(np.zeros((1, 3)))
    assert p[0, 2] == 0 and p.sum() == pytest.approx(1)
    assert made.confusion(40).sum(1) == pytest.approx([1, 1, 1]) and (made.confusion(40)[2] == [0, 0, 1]).all()
    assert made.confusion(20) == pytest.approx(made.own) and made.confusion(10**12) == pytest.approx(made.out)
    none = soft_mixing.Domains([], np.zeros(0, np.int64), ones[:0], 3)
    assert none.posteriors(np.zeros((1, 3)))[0] == pytest.approx([1 / 3] * 3)
    one = soft_mixing.Domains(ids[:2], np.array([1, 1]), ones[:2], 3)
    assert one.posteriors(np.zeros((1, 3)))[0] == pytest.approx([0, 1, 0]) and (one.confusion(5) == np.eye(3)).all()


def test_targets_allow_for_confusion(spark):
    """With posteriors that mistake 0.2 of a domain, true shares come to the targets all the same."""
    mixed = np.array([[0.8, 0.2], [0.1, 0.9]])
    truth = np.array([0] * 300 + [1] * 100)
    rows = [(i, 10, *map(float, mixed[t])) for i, t in enumerate(truth)]
    made = soft_mixing.rates(spark.createDataFrame(rows, "doc_id long, tokens long, p0 double, p1 double"), [0.5, 0.5], confusion=lambda _: mixed).collect()
    mass = np.bincount(truth, weights=[r.rate * 10 for r in sorted(made)])
    assert mass / mass.sum() == pytest.approx([0.5, 0.5], abs=0.01)
