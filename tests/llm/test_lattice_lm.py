"""Lattice likelihood against sums over all segmentations, and the base model against plain counts."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from semloom.llm import lattice_lm, packs, queries

SCHEMA = "doc_id long, text string, train boolean, stretch string, n long"
MODEL = public_tokenizers.path(lattice_lm.VOCABULARY)


def paths(text, pieces):
    """All segmentations of text, as lists of piece numbers."""
    if not text:
        return [[]]
    return [[i, *rest] for i, p in enumerate(pieces) if text.startswith(p) for rest in paths(text[len(p) :], pieces)]


def test_sums_over_all_segmentations():
    pieces = [bytes([b]) for b in b"abc "] + [b"ab", b"bc", b"abc", b" a", b" ab", b"aaaa", b"cab"]
    r = np.random.default_rng(2)
    logs = np.log(r.dirichlet(np.ones(len(pieces))))
    lattice = lattice_lm.Lattice(pieces, logs)
    texts = [bytes(r.choice(list(b"abc "), r.integers(0, 11)).tolist()) for _ in range(60)] + [b"a" * 9, b""]
    counts = r.integers(0, 4, len(texts)).astype(float)
    got, expected = lattice.run(texts, counts)
    want = np.zeros(len(pieces))
    for text, log, n in zip(texts, got, counts):
        found = paths(text, pieces)
        each = [math.exp(sum(logs[p] for p in path)) for path in found]
        assert log == pytest.approx(math.log(sum(each)))
        for path, share in zip(found, each):
            for p in path:
                want[p] += n * share / sum(each)
    assert expected == pytest.approx(want)


def test_recursion_in_parts_and_on_long_words(monkeypatch):
    pieces, logs = lattice_lm.vocabulary(MODEL)
    assert np.exp(logs).sum() == pytest.approx(1) and set(bytes([b]) for b in range(256)) <= set(pieces)
    lattice = lattice_lm.Lattice(pieces, logs)
    texts = [b" the", "日本語のテキスト".encode(), b" " * 40, b"x" * 3000, b"\xff\x00"] * 3
    whole = lattice.run(texts)[0]
    monkeypatch.setattr(lattice_lm, "AT_ONCE", 64)
    assert lattice.run(texts)[0] == pytest.approx(whole)
    assert np.isfinite(whole).all() and (whole < 0).all()


def test_cuts_lie_where_no_piece_runs_on():
    pieces, logs = lattice_lm.vocabulary(MODEL)
    lattice = lattice_lm.Lattice(pieces, logs)
    r = np.random.default_rng(4)
    marks = ["a", "the", " ", "  ", "\n", "\r", "\t", "é", " ", "　", "日", ";", "\x01", "12", "▁", "}\r", "'s"]
    for _ in range(150):
        text = "".join(r.choice(marks, r.integers(1, 14))).encode()
        parts = packs.pieces_of(text)
        assert b"".join(parts) == text
        assert lattice.run([text])[0][0] == pytest.approx(lattice.run(parts)[0].sum())


def test_packs_keep_all_rows_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(packs, "PACK", 50)
    monkeypatch.setattr(packs, "GROUP", 120)
    texts = ["w" * n for n in (0, 10, 49, 51, 400, 3, 3, 60, 0, 60)]
    table = packs.packed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1), "p")
    got = [(r.gid, packs.unpacked(r.pack).to_pylist()) for r in table.collect()]
    assert sorted((r["doc_id"], r["text"]) for _, rows in got for r in rows) == list(enumerate(texts))
    assert all(len(rows) == 1 or sum(len(r["text"]) for r in rows) <= 50 for _, rows in got)
    size = Counter()
    for gid, rows in got:
        size[gid] += sum(len(r["text"]) for r in rows)
    assert len(size) > 3 and all(n <= 120 or n == 400 for n in size.values())


def base(rows, held):
    """{doc place: (n_tokens, n_known, train_tokens, base_score)} by plain counting."""
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    words = [[*(t or "").encode().translate(low).split(), None] for _, t in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = c.total(), len(c)
    score = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(len(ws), sum(w in c for w in ws), n, sum(map(score, ws))) for ws in words]


def reference(rows, held, rounds):
    """log10 probability of each text, from whole texts and plain EM over them."""
    pieces, first = lattice_lm.vocabulary(MODEL)
    texts = [(t or "").encode() for _, t in rows]
    train = [t for t, h in zip(texts, held) if not h]
    logs, end = lattice_lm.maximise(np.zeros(len(first)), first, len(train))
    for _ in range(rounds):
        got = lattice_lm.Lattice(pieces, logs).run(train, np.ones(len(train)))[1]
        logs, end = lattice_lm.maximise(got, first, len(train))
    return ((lattice_lm.Lattice(pieces, logs).run(texts)[0] + end) / math.log(10)).tolist()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packs, "PACK", 64)
    monkeypatch.setattr(packs, "GROUP", 300)
    texts = ["The cat sat on the mat", None, "", " \n\t ", "The THE the", "naïve Café x\n\nnew  line", "日本語のテキスト", "cat " * 400, "▁odd▁ x", "a\r\nb\rc", "the cat"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the cat"), (4, texts[4])]
    held = [i is not None and i % 5 == 4 for i, _ in rows]
    frame = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], SCHEMA)
    got = lattice_lm.score_texts(frame, F.col("doc_id") % 5 == 4).collect()
    want = [(i, h, *b, s) for (i, _), h, b, s in zip(rows, held, base(rows, held), reference(rows, held, lattice_lm.ROUNDS))]
    key = lambda x: tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in x)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert lattice_lm.score_texts(spark.createDataFrame([], SCHEMA), F.col("doc_id") % 5 == 4).count() == 0
    alone = lattice_lm.score_texts(frame.where("doc_id = 4"), F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in alone] == [(0, 0, 0.0)] * 2


def test_query_equals_whole_text_model(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = [crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    got = {r.doc_id: r for r in queries.op12_lattice_likelihood(spark, sf).collect()}
    assert len(got) == len(rows)
    better = []
    for (i, _), h, b, s in zip(rows, held, base(rows, held), reference(rows, held, lattice_lm.ROUNDS)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, *b[:3])
        assert r.base_score == pytest.approx(b[3], rel=1e-9) and r.score == pytest.approx(s, rel=1e-9)
        better += [r.score > first for first in [reference_first(i, rows)] if h]
    assert len(better) > 5 and sum(better) > 0.9 * len(better)


FIRST = {}


def reference_first(doc_id, rows):
    """log10 probability under the vocabulary's first weights."""
    if not FIRST:
        FIRST.update(zip([i for i, _ in rows], reference(rows, [True] * len(rows), 0)))
    return FIRST[doc_id]
