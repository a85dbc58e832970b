"""Runs of repeated word sequences, found by block convolution.

A run is a maximal stretch of words whose smallest period q fits at least four times, and of MIN_WORDS words or more. Words are numbered
within their text. At each dyadic scale L the text is cut into blocks of L words. A run of period L <= q < 2L holds two neighbouring blocks that recur
q words on; so the first of them is looked for at the distances L .. 2L-1: the sum of squared differences between the block and the words
that follow, at all these distances at once, by number-theoretic transforms over enough primes to be exact. A sum of zero is an occurrence.
Blocks with a word that doesn't recur within 2L-1 words can't have one and are left out beforehand. Each occurrence is a seed: it is
extended to both sides as far as words at its distance are equal, by names of all stretches of dyadic length.

Texts are worked on in Arrow batches, a few at a time, without any shuffle: a text costs n log(n)^2 steps at most. Null text has no words. Repeated
rows and null doc_ids get results of their own. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from semloom.llm.common import small_batches, text_of
from semloom.llm.token_cache import WordTable
from semloom.llm.token_orc import by_bytes

#: NTT primes c * 2**k + 1 with a generator of their multiplicative groups.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
REPEATS, MIN_WORDS = 4, 6
CELLS = 1 << 20  # words of all windows that are transformed at once


def roots(size: int, prime: int, generator: int) -> np.ndarray:
    """Powers 0 .. size/2-1 of a root of unity of order size."""
    root = pow(generator, (prime - 1) // size, prime)
    out = np.ones(max(size // 2, 1), np.uint64)
    done = 1
    while done < len(out):
        out[done : 2 * done] = out[:done] * np.uint64(pow(root, done, prime)) % np.uint64(prime)
        done *= 2
    return out


def forward(x: np.ndarray, prime: int, powers: np.ndarray) -> np.ndarray:
    """Transform of each row, in bit-reversed order: halves are added and subtracted, the differences turned."""
    p, size = np.uint64(prime), x.shape[1]
    width = size
    while width > 1:
        x = x.reshape(-1, 2, width // 2)
        turn = powers[:: size // width][: width // 2]
        x = np.stack([(x[:, 0] + x[:, 1]) % p, (x[:, 0] + p - x[:, 1]) * turn % p], 1)
        width //= 2
    return x.reshape(-1, size)


def backward(x: np.ndarray, prime: int, powers: np.ndarray) -> np.ndarray:
    """Inverse of forward, times the size."""
    p, size = np.uint64(prime), x.shape[1]
    width = 2
    while width <= size:
        x = x.reshape(-1, 2, width // 2)
        turned = x[:, 1] * powers[:: size // width][: width // 2] % p
        x = np.stack([(x[:, 0] + turned) % p, (x[:, 0] + p - turned) % p], 1)
        width *= 2
    return x.reshape(-1, size)


def correlation(blocks: np.ndarray, windows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """sum_j window[d + j] * block[j] mod prime for d = 0 .. L-1, for each row of L and of 2L values."""
    size = windows.shape[1]
    powers = roots(size, prime, generator)
    back = powers.copy()
    back[1:] = (np.uint64(prime) - powers[1:])[::-1]  # the inverse root's powers
    padded = np.zeros_like(windows)
    padded[:, 0] = blocks[:, 0]
    padded[:, -1 : -blocks.shape[1] : -1] = blocks[:, 1:]  # read backwards: a product of transforms correlates
    both = forward(windows, prime, powers) * forward(padded, prime, powers) % np.uint64(prime)
    out = backward(both, prime, back)[:, : blocks.shape[1]]
    return out * np.uint64(pow(size, prime - 2, prime)) % np.uint64(prime)


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, d) where the block of a row equals its window from place d on: L values, 2L values, d in 0 .. L-1."""
    size = blocks.shape[1]
    bound = size * int(max(blocks.max(initial=0), windows.max(initial=0))) ** 2
    zero, product = np.ones(blocks.shape, bool), 1
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        sums = np.concatenate([np.zeros((len(windows), 1), np.uint64), np.cumsum(windows * windows % p, 1)], 1)
        around = (sums[:, size : 2 * size] - sums[:, :size] + (blocks * blocks % p).sum(1, keepdims=True)) % p
        zero &= around == 2 * correlation(blocks, windows, prime, generator) % p
        product *= prime
        if product > bound:
            return np.nonzero(zero)
    raise OverflowError("a text of so many different words needs more primes")


_TABLE = [WordTable()]


def numbered(texts: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words one after the other, three ways: numbers that no two texts share, numbers from 0 in each text, and the words to the
    next occurrence in the same text (the number of words where there is none)."""
    if _TABLE[0].full():
        _TABLE[0] = WordTable()
    rows = np.concatenate([np.zeros(0, np.int64), *(_TABLE[0].rows(w) for w in texts)])
    _TABLE[0].fresh.clear()
    n, text = len(rows), np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    bits = max(n, 1).bit_length()
    order = np.sort(((text * (len(_TABLE[0]) + 1) + rows) << bits) + np.arange(n))
    key, place = order >> bits, order & ((1 << bits) - 1)
    same = key[1:] == key[:-1]
    words, gap = np.zeros(n, np.int64), np.full(n, n, np.int64)
    words[place[1:]] = np.cumsum(~same)
    gap[place[:-1][same]] = np.diff(place)[same]
    _, first = np.unique(text, return_index=True)
    least = np.minimum.reduceat(words, first) if n else words
    return words, words - np.repeat(least, np.diff(np.append(first, n))), gap


class Names:
    """Names of all stretches of 1, 2, 4 .. words: two stretches are equal if their names are."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]
        while 2 << (len(self.levels) - 1) <= len(words):
            last, half = self.levels[-1].astype(np.int64), 1 << (len(self.levels) - 1)
            both = last[:-half] * (int(last.max()) + 1) + last[half:]
            self.levels.append(np.unique(both, return_inverse=True)[1].astype(np.int32))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches that begin at a and at b (a < b)."""
        a, b = a.copy(), b.copy()
        begun = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            fits = np.flatnonzero(b < len(names))
            step = fits[names[a[fits]] == names[b[fits]]]
            a[step] += 1 << k
            b[step] += 1 << k
        return a - begun

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest equal stretches that end before a and before b (a < b)."""
        a, b = a.copy(), b.copy()
        begun = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[k], 1 << k
            fits = np.flatnonzero(a >= size)
            step = fits[names[a[fits] - size] == names[b[fits] - size]]
            a[step] -= size
            b[step] -= size
        return begun - a


def seeds(words: np.ndarray, values: np.ndarray, gap: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of block occurrences in texts as numbered gives them; longest: words of the longest text."""
    places, distances = [], []
    size = 1
    while REPEATS * size <= longest:
        blocks = len(gap)
        pair = np.flatnonzero((gap[: blocks - 1] < 2 * size) & (gap[1:] < 2 * size)) if blocks > 1 else np.zeros(0, np.int64)
        for i in range(0, len(pair), max(1, CELLS // (2 * size))):
            at = pair[i : i + max(1, CELLS // (2 * size))] * size
            block = values[at[:, None] + np.arange(size)]
            inside = np.minimum(at[:, None] + np.arange(size, 3 * size), len(values) - 1)
            row, d = zero_mismatches(block.astype(np.uint64), values[inside].astype(np.uint64))
            places.append(at[row])
            distances.append(d + size)
        half = gap[: len(gap) // 2 * 2].reshape(-1, 2).max(1)
        gap, size = half, 2 * size
    at, d = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, distances))
    ok = at + d < len(words)  # further on lies the padding
    ok[ok] = words[at[ok]] == words[at[ok] + d[ok]]  # another text's words have other numbers
    return at[ok], d[ok]


def runs_of(words: np.ndarray, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs that hold the seeds (at, d), by start, then period."""
    if not len(at):
        return at, at, at
    names = Names(words)
    back = names.common_before(at, at + d)
    start, length = at - back, back + names.common(at, at + d) + d
    ok = length >= np.maximum(MIN_WORDS, REPEATS * d)
    start, length, d = start[ok], length[ok], d[ok]
    order = np.lexsort((d, length, start))
    start, length, d = start[order], length[order], d[order]
    first = np.ones(len(start), bool)  # multiples of the smallest period have the same stretch
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, d = start[first], length[first], d[first]
    order = np.lexsort((d, start))
    return start[order], length[order], d[order]


def text_runs(texts: list[list]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of the runs of each text, given as its words, and which of its words a run doesn't repeat."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes)
    words, values, gap = numbered(texts)
    at, d = seeds(words, values, gap, int(sizes.max(initial=0)))
    text = np.searchsorted(ends, at, side="right")
    hit = np.zeros(len(texts), bool)
    hit[text] = True
    kept = np.repeat(hit, sizes)  # stretches are named in texts with seeds alone
    shift = np.cumsum(np.where(hit, 0, sizes))
    start, length, period = runs_of(words[kept], at - shift[text], d)
    start += shift[np.flatnonzero(hit)[np.searchsorted(np.cumsum(sizes[hit]), start, side="right")]] if len(start) else start
    turn = np.zeros(len(words) + 1, np.int64)
    np.add.at(turn, start + period, 1)
    np.add.at(turn, start + length, -1)
    keep = np.cumsum(turn[:-1]) == 0
    cut = np.searchsorted(start, np.append(ends - sizes, len(words)))
    for i, (n, end) in enumerate(zip(sizes, ends)):
        mine = slice(cut[i], np.searchsorted(start, end))
        yield start[mine] - (end - n), length[mine], period[mine], keep[end - n : end]


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(words: list[bytes], found: tuple) -> tuple:
    """n_runs to collapsed_sha256 of a text."""
    start, length, period, keep = found
    lines = b"".join(b"%d,%d,%d\n" % x for x in zip(start.tolist(), length.tolist(), period.tolist()))
    left = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
    best = (None,) * 4
    if len(start):
        i = np.lexsort((period, start, -length))[0]
        best = int(start[i]), int(length[i]), int(period[i]), int(1000 * length[i] // period[i])
    return len(start), *best, sha256(lines).hexdigest(), sha256(b" ".join(left)).hexdigest()


def periodic_runs(docs: DataFrame, words_of=None) -> DataFrame:
    """SCHEMA for every row of docs (doc_id, text). words_of(doc_id, words): the words to look at, if not the text's own."""
    small_batches(docs.sparkSession)

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            done = 0
            for part in by_bytes(batch.column("text").cast(pa.binary()).to_pylist()):
                texts = [raw.split() for raw in part]
                if words_of:
                    texts = [words_of(i, w) for i, w in zip(ids[done:], texts)]
                rows = [(i, *digest(w, f)) for i, w, f in zip(ids[done:], texts, text_runs(texts))]
                done += len(part)
                columns = [pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(COLUMNS, zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, COLUMNS)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, SCHEMA)
