"""Periodic runs against a search over all periods and places."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from semloom.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string, start long, words string"


def brute(words):
    """All (start, length, period), by comparing words at every distance."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if j > i and len(stretch) >= max(6, 4 * q) and not any(stretch[e:] == stretch[:-e] for e in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(words):
    """n_runs to collapsed_sha256, by the contract's words."""
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    times = runs and 1000 * best[1] // best[2]
    return len(runs), *best, times or None, sha256(lines.encode()).hexdigest(), sha256(left.encode()).hexdigest()


def sequences(r, count):
    def near(most=9):
        return [r.choice("xyz") for _ in range(r.randrange(most))]

    for i in range(count):
        n = r.randrange(90)
        unit = [r.choice("abcdef") for _ in range(r.randrange(1, 14))]
        yield [
            [r.choice("ab") for _ in range(n)],
            near() + unit * r.randrange(3, 9) + unit[: r.randrange(len(unit) + 1)] + near(),
            ["a"] * n,
            (["a"] * r.randrange(1, 9) + ["b"]) * r.randrange(1, 9),
            (unit * 4 + ["s"]) * 4,
            [str(i) for i in range(n)],
        ][i % 6]


def test_runs_of_many_texts_at_once():
    r = random.Random(3)
    for _ in range(60):
        texts = list(sequences(r, r.randrange(1, 13)))
        for words, (start, length, period, keep) in zip(texts, periodic_runs.text_runs(texts)):
            want = brute(words)
            assert list(zip(start.tolist(), length.tolist(), period.tolist())) == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert [i for i, k in enumerate(keep) if not k] == sorted(gone)


def test_few_cells_at_once_give_the_same(monkeypatch):
    texts = list(sequences(random.Random(5), 12))
    want = [[x.tolist() for x in f] for f in periodic_runs.text_runs(texts)]
    monkeypatch.setattr(periodic_runs, "CELLS", 16)
    assert [[x.tolist() for x in f] for f in periodic_runs.text_runs(texts)] == want


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_transforms_are_exact(size):
    r = np.random.default_rng(size)
    blocks, windows = r.integers(0, 1 << 20, (5, size)).astype(np.uint64), r.integers(0, 1 << 20, (5, 2 * size)).astype(np.uint64)
    windows[2, size - 1 : 2 * size - 1] = blocks[2]
    prime, generator = periodic_runs.PRIMES[0]
    got = periodic_runs.correlation(blocks, windows, prime, generator)
    want = [[sum(int(w[d + j]) * int(b[j]) for j in range(size)) % prime for d in range(size)] for b, w in zip(blocks, windows)]
    assert got.tolist() == want
    assert (2, size - 1) in set(zip(*(x.tolist() for x in periodic_runs.zero_mismatches(blocks, windows))))


def test_long_texts_take_little():
    same = ["a"] * 100_000
    ((start, length, period, keep),) = periodic_runs.text_runs([same])
    assert (start.tolist(), length.tolist(), period.tolist(), int(keep.sum())) == ([0], [100_000], [1], 1)
    unit = [str(i) for i in range(20_000)]
    ((start, length, period, _),) = periodic_runs.text_runs([["x"] + unit * 5])
    assert (start.tolist(), length.tolist(), period.tolist()) == ([1], [100_000], [20_000])


def test_odd_rows(spark):
    texts = ["a b " * 3, None, "", " \t\n", "one", "x y " * 6, "a b c d " * 40 + "z", "é ü\r\n" * 9, "lone words stand here"]
    rows = [(i, t, 1, "w") for i, t in enumerate(texts)] + [(None, texts[0], 1, "w"), (6, texts[6], 1, "w")]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda x: repr(x)
    want = [(i, *row([w.decode() for w in (t or "").encode().split()])) for i, t, _, _ in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert set(got) == set(docs)
    tried = sorted((i for i in docs if len(docs[i]) < 6000), key=lambda i: crc32(str(i).encode()) % 10)[:60]
    for i in tried:
        h, words = crc32(str(i).encode()), [w.decode() for w in docs[i].encode().split()]
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(len(words))]
        assert got[i] == row(words), i
