"""Naive Bayes support vector machine for document quality.

Features are n-gram indicators: words, word pairs, word beginnings, and triples of word shapes (case,
trailing marks, repeated or not). Class log-count ratios scale the indicators; a hinge-loss linear
model is fitted to them by dual coordinate descent, and mixed with the ratios' own mean weight.

The fit takes at most SAMPLE labelled rows, the first by a hash of doc_id: a documented bound; texts
are turned into indicators on the executors. Scoring covers every whole text in Arrow batches, with one broadcast
weight vector of fixed size.

Null and empty texts have no features: their score is the model's offset alone. Labels that are null or
whose document is missing are left out. With one class only, all scores are that class's (0.0 or
1.0), without labels 0.5. Repeated rows score alike; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import sample_texts, small_batches, text_of
from semloom.llm.token_cache import WordTable

BITS = 18
SAMPLE = 4000
EDGES = re.compile(r"^\W+|\W+$")
LETTERS = re.compile(r"[^\W\d_]+")
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
MIX = np.uint32(0x9E3779B1)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


@lru_cache(maxsize=1 << 14)
def shape_code(shape: str) -> int:
    return crc32(re.sub(r"\d+", "9", shape)[:12].encode("utf-8", "surrogatepass"), 2)


def word_codes(raw: bytes) -> tuple[int, int, int]:
    """32-bit hashes of a word without its marks, of its beginning, and of its shape. Letters with marks behind them take a short path."""
    body = raw.rstrip(MARKS)
    if body.isalpha():  # ASCII letters alone
        case = "a" if body.islower() else "A" if body.isupper() and len(body) > 1 else "Aa" if body[0] < 97 else "a"
        low = body.lower()
        return crc32(low), crc32(low[:4], 1), shape_code(case + raw[len(body) :][:11].decode())
    word = raw.decode("utf-8", "replace")
    body = word.rstrip(MARKS.decode())
    if body.isalpha():
        bare, tail = body.lower(), word[len(body) :][:11]
        shape = ("a" if body.islower() else "A" if body.isupper() and len(body) > 1 else "Aa" if body[0].isupper() else "a") + tail
    else:
        bare = EDGES.sub("", word.lower()) or word
        shape = LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", word)
    return crc32(bare.encode()), crc32(bare[:4].encode(), 1), shape_code(shape[:64])


class Indicators:
    """Ids below 2**BITS of the n-grams that a text has, each once and sorted; word codes are cached in each worker."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.words, self.codes, self.n = WordTable(), np.zeros((3, 1 << 14), np.uint32), 0

    def of(self, text: str) -> np.ndarray:
        return self.of_words(words_of(text)).astype(np.int32)

    def of_words(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.intp)
        if self.words.full():
            self.reset()
        rows = self.words.rows(words)
        if fresh := self.words.fresh:
            while self.n + len(fresh) > self.codes.shape[1]:
                self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)], 1)
            self.codes[:, self.n : self.n + len(fresh)] = np.array([word_codes(w) for w in fresh], np.int64).T.astype(np.uint32)
            self.n += len(fresh)
            self.words.fresh = []
        bare, begin, shape = np.take(self.codes, rows, axis=1)
        shape[1:] += rows[1:] == rows[:-1]
        pair = (bare[:-1] * MIX) ^ bare[1:]
        triple = ((shape[:-2] * MIX) ^ shape[1:-1]) * MIX ^ shape[2:]
        ids = np.concatenate([bare, pair, begin, triple, shape])
        ids *= MIX
        ids >>= np.uint32(32 - BITS)
        ids.sort()
        once = np.ones(len(ids), bool)
        np.not_equal(ids[1:], ids[:-1], out=once[1:])
        return ids[once].astype(np.intp)


_INDICATORS = Indicators()


def sample_rows(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(ids, labels, numbers of words) of at most `rows` rows of labelled (doc_id, label int)."""
    small_batches(docs.sparkSession)
    chosen = labelled.where("label is not null").select("doc_id", "label")

    def work(batches):
        for pdf in batches:
            words = [words_of(t) for t in pdf["text"]]
            ids = [_INDICATORS.of_words(w).astype(np.int32).tobytes() for w in words]
            yield pd.DataFrame({"label": pdf["label"], "ids": ids, "words": [len(w) for w in words]})

    got = (
        sample_texts(docs, chosen, rows)
        .select("label", "text")
        .mapInPandas(work, "label int, ids binary, words long")
        .collect()
    )
    got = sorted(got, key=lambda r: (r["label"], bytes(r["ids"])))
    return [np.frombuffer(r["ids"], np.int32) for r in got], *(np.array([r[c] for r in got], np.int64) for c in ("label", "words"))


def sample_indicators(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """(ids, labels) of sample_rows."""
    return sample_rows(docs, labelled, rows)[:2]


def log_ratio(ids: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of smoothed indicator counts, class 1 over class 0."""
    size = 1 << BITS
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(x for x, c in zip(ids, y) if c == k)]), minlength=size) for k in (1, 0)]
    p, q = ((c + 1.0) / (c.sum() + size) for c in counts)
    return np.log(p / q)


def fit(ids: list[np.ndarray], y: np.ndarray, beta: float = 0.25, cost: float = 1.0, epochs: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and offset of the classifier of y in {0, 1}."""
    n, size = len(ids), 1 << BITS
    if n == 0 or y.min() == y.max():
        return np.zeros(size, np.float32), 0.0 if n == 0 else (50.0 if y[0] else -50.0)
    ratio = log_ratio(ids, y)
    norm = [1 / max(np.linalg.norm(ratio[x]), 1e-9) for x in ids]
    rows = [ratio[x] * s for x, s in zip(ids, norm)]
    sign = np.where(y == 1, 1.0, -1.0)
    most = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum())) * cost
    w, b, alpha = np.zeros(size), 0.0, np.zeros(n)
    order = np.random.default_rng(seed)
    for _ in range(epochs):  # L1-loss dual; the offset is a feature of value 1
        for i in order.permutation(n):
            g = sign[i] * (w[ids[i]] @ rows[i] + b) - 1
            now = min(max(alpha[i] - g / 2.0, 0.0), most[i])
            if now != alpha[i]:
                step = (now - alpha[i]) * sign[i]
                w[ids[i]] += step * rows[i]
                b += step
                alpha[i] = now
    mean = np.abs(w).sum() / max(np.count_nonzero(w), 1)
    return ((beta * mean + (1 - beta) * w) * ratio).astype(np.float32), float(b)


class Model:
    """One or more linear models over indicators, of fixed size. A feature's weights and squared ratios lie side by side, so that one gather fetches them."""

    def __init__(self, ids: list[np.ndarray], targets: list[np.ndarray]):
        fitted = [fit(ids, y) for y in targets]
        ratios = [log_ratio(ids, y) ** 2 for y in targets]
        columns = [*(w for w, _ in fitted), *ratios]
        self.table = np.zeros((1 << BITS, 1 << (len(columns) - 1).bit_length()), np.float32)  # rows of 8, 16, 32 .. bytes
        self.table[:, : len(columns)] = np.stack(columns, 1)
        self.offsets = np.array([b for _, b in fitted])

    def margins(self, words: list[bytes]) -> np.ndarray:
        return self.margins_of(_INDICATORS.of_words(words))

    def margins_of(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return self.offsets
        sums = np.ones(len(ids), np.float32) @ np.take(self.table, ids, axis=0, mode="clip")
        k = len(self.offsets)
        return sums[:k] / np.maximum(np.sqrt(sums[k : 2 * k]), 1e-9) + self.offsets


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row: the logistic of the margin."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for pdf in batches:
            m = np.array([sent.value.margins(words_of(t))[0] for t in pdf["text"]], np.float64)
            yield pdf[["doc_id"]].assign(score=1 / (1 + np.exp(-np.clip(2 * m, -60, 60))))

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(work, "doc_id long, score double")


def quality(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted): labelled (doc_id, label) holds the rows to learn from."""
    ids, y = sample_indicators(docs, labelled, rows)
    out = score(docs, Model(ids, [y]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
