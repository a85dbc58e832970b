"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Units are the words of sentences (runs of single letters join to one, long words are cut to
overlapping windows). The kernel of two units counts common subsequences of three and four
characters, gaps decaying by DECAY, word ends included as characters; it is normalised by length.
Inserted characters and gaps only lower it. Nystroem features of a unit are its kernels with a few hundred landmark
units, whitened; a hinge-loss linear model on them, fitted by dual coordinate descent, collapses
to one weight per subsequence code, so scoring a unit is a gather over its subsequences.

Sentences carry their document's label, so most units in toxic sentences are innocent. Units count as
toxic for the fit if they stand in toxic sentences in so many different contexts that chance gives
under one such unit; the rest are negatives, and the hardest of them are added in two further rounds. A document's score is the logistic of its
two highest unit margins, calibrated on the same labelled rows. The fit takes at most SAMPLE labelled rows.

Null and empty texts have no units and get the margin LOWEST, like texts of harmless words. Null labels are left out.
Without two classes or without toxic units all scores are the share of toxic labels. Repeated rows score alike;
empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import sample_texts, small_batches, text_of, written
from semloom.llm.token_cache import WordTable

SAMPLE = 6000
DECAY = 0.6
SPAN = 3  # most characters skipped inside a subsequence
LONG = 22  # characters of a unit; longer words are cut to windows of this length
LANDMARKS = 192
NEGATIVES = 8_000
GATES = (0.02, 0.1, 0.3)  # most clean contexts of a toxic unit for each toxic one; the next where the first leaves none, as under label noise
HARD = 4_000
CODES = (1 << 18) + (1 << 20)  # all triples of 64 letters, and hashed quadruples
LOWEST = -3.0
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
MARKS = re.compile(r"[\W_]+")
ALIKE = str.maketrans("01345@$", "oieasas")
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")

_TABLES: dict[int, tuple] = {}


def letters(unit: str) -> list[int]:
    """Codes 0-63: the word's start 0 and end 1, a-z 2-27, other characters folded onto 28-63."""
    return [0, *(ord(c) - 95 if "a" <= c <= "z" else 28 + ord(c) % 36 for c in unit), 1]


def subsequences(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Positions and weights of the triples and quadruples within SPAN gaps in a unit of n letters, and the length norm."""
    if n not in _TABLES:
        found = [[], []]
        for start in range(n):
            for i, p in enumerate((3, 4)):
                for rest in combinations(range(start + 1, min(n, start + p + SPAN)), p - 1):
                    found[i].append((start, *rest))
        at = [np.array(x, np.int64).reshape(-1, p) for x, p in zip(found, (3, 4))]
        w = [DECAY ** (x[:, -1] - x[:, 0] + 1 - p) if len(x) else np.zeros(0) for x, p in zip(at, (3, 4))]
        _TABLES[n] = (*at, *w, float(np.sqrt(sum((x**2).sum() for x in w)) or 1.0))
    return _TABLES[n]


def codes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence codes, weights over the norm) of units of one length; chars: units x letters."""
    three, four, w3, w4, norm = subsequences(chars.shape[1])
    a = (chars[:, three[:, 0]] << 12) | (chars[:, three[:, 1]] << 6) | chars[:, three[:, 2]]
    b = (chars[:, four[:, 0]] << 18) | (chars[:, four[:, 1]] << 12) | (chars[:, four[:, 2]] << 6) | chars[:, four[:, 3]]
    b = np.uint32(1 << 18) + (b * np.uint32(0x9E3779B1) >> np.uint32(12))  # wraps at 32 bits
    return np.concatenate([a, b], 1), (np.concatenate([w3, w4]) / norm).astype(np.float32)


def by_length(units: list[str]):
    """(positions, letters) of the units of each length."""
    rows: dict[int, list[int]] = {}
    for i, u in enumerate(units):
        rows.setdefault(len(u), []).append(i)
    for at in rows.values():
        yield np.array(at), np.array([letters(units[i]) for i in at], np.uint32)


def windows(word: str) -> list[str]:
    return [word] if len(word) <= LONG else [word[i : i + LONG] for i in range(0, len(word) - LONG // 2, LONG // 2)]


def bare(word: bytes) -> str:
    """The word's letters and digits, lower case; digits and signs inside a word stand for the letters they look like."""
    u = EDGES.sub("", word.decode("utf-8", "replace").lower())
    if u.isalpha():
        return u
    if any(c.isalpha() for c in u):
        u = u.translate(ALIKE)
    return MARKS.sub("", u)


def units_of(sentence: str) -> list[str]:
    """Units in order: words without outer marks; two or more single characters in a row make one unit."""
    out, run = [], []
    for w in [*sentence.encode("utf-8", "surrogatepass").split(), b""]:
        u = bare(w)
        if len(u) == 1:
            run.append(u)
            continue
        if len(run) > 2:
            out.append("".join(run)[:LONG])
        run = []
        if u:
            out += windows(u)
    return out


class Machine:
    """Weight of each subsequence code, offset, and the logistic's weights."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset, self.logistic = weights, offset, np.array([1.0, 0.0, 0.0])

    def scores(self, two: np.ndarray) -> np.ndarray:
        """Documents' scores from their two highest margins."""
        return 1 / (1 + np.exp(-np.clip(two @ self.logistic[:2] + self.logistic[2], -60, 60)))

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), LOWEST)
        for at, chars in by_length(units):
            for i in range(0, len(at), 2048):
                c, w = codes(chars[i : i + 2048])
                out[at[i : i + 2048]] = self.weights[c] @ w + self.offset
        return out


class Reader:
    """The two highest unit margins of texts; margins of words are cached in each worker."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.reset()

    def reset(self):
        self.words, self.margin, self.single, self.n, self.units = WordTable(), np.zeros(1 << 14), np.zeros(1 << 14, bool), 0, {}

    def highest(self, text: str) -> tuple[float, float]:
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return LOWEST, LOWEST
        if self.words.full():
            self.reset()
        rows = self.words.rows(words)
        if fresh := self.words.fresh:
            plain = [bare(w) for w in fresh]
            parts = [windows(u) if u else [] for u in plain]
            new = [x for x in dict.fromkeys(x for p in parts for x in p) if x not in self.units]
            self.units.update(zip(new, self.machine.margins(new).tolist()))
            while self.n + len(fresh) > len(self.margin):
                self.margin, self.single = (np.concatenate([x, np.zeros_like(x)]) for x in (self.margin, self.single))
            for i, p in enumerate(parts):
                self.margin[self.n + i] = max((self.units[x] for x in p), default=LOWEST)
                self.single[self.n + i] = len(plain[i]) == 1
            self.n += len(fresh)
            self.words.fresh = []
        found = self.margin[rows]
        alone = self.single[rows]
        if (alone[2:] & alone[1:-1] & alone[:-2]).any():  # spelt out letter by letter
            edge = np.flatnonzero(np.diff(np.r_[0, alone.astype(np.int8), 0]))
            runs = ["".join(bare(words[i]) for i in range(s, e)) for s, e in zip(edge[::2], edge[1::2]) if e - s > 2]
            found = np.concatenate([found, self.machine.margins([x for r in runs for x in windows(r)])])
        two = np.partition(np.r_[LOWEST, LOWEST, np.maximum(found, LOWEST)], -2)[-2:]
        return float(two[1]), float(two[0])


def _features(units: list[str], place: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernels of units with the landmarks; place: each code's row of the table (the last, of zeros, for codes that no landmark has)."""
    out = np.zeros((len(units), table.shape[1]), np.float32)
    none = len(table) - 1
    for at, chars in by_length(units):
        for i in range(0, len(at), 128):
            c, w = codes(chars[i : i + 128])
            row = place[c]
            hit, col = np.nonzero(row != none)
            if len(hit):
                part = table[row[hit, col]] * w[col, None].astype(np.float32)
                start = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1]])
                out[at[i + hit[start]]] = np.add.reduceat(part, start, 0)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: float, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Hinge-loss linear model by dual coordinate descent; the offset is a feature of value 1."""
    sign = np.where(y, 1.0, -1.0)
    most = np.where(y, len(y) / (2 * max(y.sum(), 1)), 1.0) * cost
    q = (x.astype(float) ** 2).sum(1) + 1
    w, b, alpha, order = np.zeros(x.shape[1]), 0.0, np.zeros(len(y)), np.random.default_rng(3)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            g = sign[i] * (w @ x[i] + b) - 1
            now = min(max(alpha[i] - g / q[i], 0.0), most[i])
            if now != alpha[i]:
                step = (now - alpha[i]) * sign[i]
                w += step * x[i]
                b += step
                alpha[i] = now
    return w, b


def train(toxic: list[str], clean: list[str], near: list[str]) -> Machine:
    """Machine of toxic and clean units; near: clean units that make the other half of the landmarks."""
    marks = toxic[: LANDMARKS // 2] + (near or clean)[: LANDMARKS - min(len(toxic), LANDMARKS // 2)]
    entries = []
    for at, chars in by_length(marks):
        c, w = codes(chars)
        entries.append((np.repeat(at, c.shape[1]), c.ravel(), np.tile(w, len(c))))
    mark, code, weight = (np.concatenate(x) for x in zip(*entries))
    columns, col = np.unique(code, return_inverse=True)
    table = np.zeros((len(columns) + 1, len(marks)), np.float32)
    np.add.at(table, (col, mark), weight)
    values, vectors = np.linalg.eigh((table.T @ table).astype(float))
    good = values > 1e-4 * values[-1]
    white = vectors[:, good] / np.sqrt(values[good])
    units = toxic + clean
    place = np.full(CODES, len(columns), np.int32)
    place[columns] = np.arange(len(columns))
    x = _features(units, place, table) @ white
    w, b = _svm(x, np.arange(len(units)) < len(toxic), 1.0)
    weights = np.zeros(CODES, np.float32)
    weights[columns] = table[:-1] @ (white @ w)
    return Machine(weights, float(b))


def _logistic(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the logistic fit of y on the columns of m and a constant, by damped Newton steps."""
    x = np.column_stack([m, np.ones(len(m))])
    w, small = np.zeros(x.shape[1]), np.diag([0.05] * m.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + small
        w = w - np.linalg.solve(h, x.T @ (p - y) + small @ w) * 0.7
    return w


def fit(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE) -> tuple[Machine | None, float]:
    """(machine or None, share of toxic labels) from at most `rows` rows of labelled (doc_id, label)."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labelled.where("label is not null").select("doc_id", "label")
    sample = written(sample_texts(docs, chosen, rows).select("label", "text"), "labelled")

    def units(batches):
        for pdf in batches:
            got = set()
            for label, text in zip(pdf["label"], pdf["text"]):
                for sentence in SENTENCE.split(text):
                    before = ""
                    for u in units_of(sentence):
                        got.add((u, int(label), before))
                        before = u
            yield pd.DataFrame(sorted(got), columns=["unit", "label", "before"])

    seen = sample.mapInPandas(units, "unit string, label int, before string").distinct()
    counted = written(
        seen.groupBy("unit").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")), "units"
    )
    share = sample.agg(F.avg("label")).first()[0]
    if not share or share >= 1:
        return None, float(share or 0.0)
    sizes = counted.groupBy(F.least(F.col("bad") + F.col("good"), F.lit(200)).alias("n")).count().collect()
    enough = next((c for c in range(2, 200) if sum(r["count"] for r in sizes if r["n"] >= c) * share**c < 1), 200)
    toxic: list[str] = []
    for gate in GATES:
        picked = counted.where((F.col("bad") >= enough) & (F.col("good") <= F.col("bad") * gate))
        toxic = toxic or [r["unit"] for r in picked.orderBy(F.desc("bad"), "unit").limit(2 * LANDMARKS).collect()]
    if not toxic:
        return None, float(share)
    others = counted.where(F.col("good") > 0).select("unit")
    clean = [r["unit"] for r in others.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVES).collect()]
    known = set(toxic)
    clean = [u for u in clean if u not in known]
    near: list[str] = []
    for _ in range(3):
        machine = train(toxic, clean + near, near)
        sent = spark.sparkContext.broadcast(machine)

        def hardest(batches, sent=sent):
            for pdf in batches:
                yield pdf.assign(m=sent.value.margins(list(pdf["unit"])))

        scored = others.mapInPandas(hardest, "unit string, m double").orderBy(F.desc("m"), "unit").limit(HARD)
        found = [r["unit"] for r in scored.collect() if r["unit"] not in known]
        have = set(near)
        near = [u for u in found if u not in have][: HARD // 2] + near
    machine = train(toxic, clean + near, near)
    sent = spark.sparkContext.broadcast(machine)

    def highest(batches):
        reader = Reader(sent.value)
        for pdf in batches:
            two = np.array([reader.highest(t) for t in pdf["text"]], np.float64).reshape(-1, 2)
            yield pd.DataFrame({"label": pdf["label"].to_numpy(), "m": two[:, 0], "n": two[:, 1]})

    got = sample.mapInPandas(highest, "label int, m double, n double").toPandas().sort_values(["label", "m", "n"])  # at most `rows` rows
    machine.logistic = _logistic(got[["m", "n"]].to_numpy(), got["label"].to_numpy())
    return machine, float(share)


def toxicity(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs (doc_id, text)."""
    machine, share = fit(docs, labelled, rows)
    if machine is None:
        out = docs.select("doc_id", F.lit(share).alias("score"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(machine)

        def work(batches):
            reader = Reader(sent.value)
            for pdf in batches:
                two = np.array([reader.highest(t) for t in pdf["text"]], np.float64).reshape(-1, 2)
                yield pdf[["doc_id"]].assign(score=sent.value.scores(two))

        out = docs.select("doc_id", text_of().alias("text")).mapInPandas(work, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
