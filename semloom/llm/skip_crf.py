"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans come from four patterns (email, ip, card, phone); each is looked for run by run, in time linear in the text. The field labels
the tokens of a document as none or one of the four kinds: a chain links neighbouring tokens, skip edges link consecutive tokens
that repeat or resemble each other (the same letters and digits, the same long beginning of them, the same digits or last digits)
wherever they stand, and loopy sum-product messages make their labels agree. Tokens under base spans are observed: their
labels are fixed, and spread along the edges. Other tokens that the field marks with at least SURE belief
become further spans (a local number after the full one, an address without its end, a card number with a slip); base spans stay as they are.

Tokens are the words with a digit or an @ and the words beside them. Features tell of shape and neighbours, not whether a pattern
matches. The field is trained piecewise on the base spans of at most SAMPLE documents that have candidates (the
first by a hash of doc_id): the token factor by softmax regression, where half the tokens under base spans show a masked shape, so that
neighbours and edges count; the chain and skip factors by label-pair ratios.

Null text counts as empty: no spans. Repeated rows and null doc_ids get results of their own. Without candidates anywhere the field adds
nothing. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import sample_texts, small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP_REST = re.compile(r"(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[0-9@]")
CORE = re.compile(r"[\W_]+")
SAMPLE = 2000
SURE = 0.97
SLOTS = 1 << 12
FEATURES = 11
ROUNDS = 12


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def runs(text: str, run: re.Pattern, rest: re.Pattern):
    """Leftmost matches of run and rest behind it, not overlapping. rest can't start inside a run, so each run is tried once."""
    at = run.search(text)
    while at:
        found = rest.match(text, at.end())
        if found:
            yield at.start(), found.end()
        at = run.search(text, found.end() if found else at.end())


def in_bounds(ip: str) -> bool:
    return all(len(p) < 4 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in ip.split(".")))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(s, e, 0) for s, e in runs(text, LOCAL, DOMAIN)]
    if DIGIT.search(text):
        if "." in text:
            found += [(s, e, 1) for s, e in runs(text, DIGITS, IP_REST) if in_bounds(text[s:e])]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, KINDS[k]) for s, e, k in found]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the words with a digit or an @, and of the words beside them."""
    if not MARKED.search(text):
        return []
    words = [m.span() for m in WORD.finditer(text)]
    held = {j for i, (s, e) in enumerate(words) if MARKED.search(text, s, e) for j in (i - 1, i, i + 1)}
    return [words[i] for i in sorted(held) if 0 <= i < len(words)]


def features(text: str, spans: list[tuple[int, int]], masked: np.ndarray | None = None) -> np.ndarray:
    """FEATURES slots for each token: its shape, counts and ends (left out where masked), and the words beside it."""
    words = [text[s : min(e, s + 64)] for s, e in spans]
    shapes = [re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 6)}", w))[:24] for w in words]
    plain = [w.strip(".,;:!?\"'()[]#*$%&|").lower()[:16] for w in words]
    out = np.zeros((len(words), FEATURES), np.int64)
    for i, w in enumerate(words):
        left = i and spans[i][0] - spans[i - 1][1] == 1
        right = i + 1 < len(words) and spans[i + 1][0] - spans[i][1] == 1
        digits = sum(map(str.isdigit, w))
        own = (shapes[i], f"d{min(digits, 20)}", f"@{w.count('@')}", f".{min(w.count('.'), 4)}", f"s{w[0] if not w[0].isalnum() else 'x'}", f"m{bool(digits or '@' in w)}")
        if masked is not None and masked[i]:
            own = ("masked",) * len(own)
        told = (*own, f"l{shapes[i - 1] if left else '-'}", f"r{shapes[i + 1] if right else '-'}", f"p{plain[i - 1] if left else '-'}", f"n{plain[i + 1] if right else '-'}", "one")
        out[i] = [(xxhash.xxh32_intdigest(f"{j}{x}") % (SLOTS - 1)) for j, x in enumerate(told)]
    return out


def edges(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Chain pairs (one space apart), and skip pairs: consecutive marked tokens that agree in their core (three characters or more), its first eight characters, six digits or more, or the last seven digits."""
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] == 1]
    last: dict[str, int] = {}
    skip = set()
    for i, (s, e) in enumerate(spans):
        if not MARKED.search(text, s, e):
            continue
        core = CORE.sub("", text[s:e].lower())
        digits = re.sub("[^0-9]", "", core)
        keys = {core} if len(core) > 2 else set()
        if len(core) > 8:
            keys.add("^" + core[:8])
        if len(digits) > 5:
            keys |= {"#" + digits, "$" + digits[-7:]}
        for key in keys:
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    pairs = sorted(skip - set(chain))
    return np.array(chain, np.int64).reshape(-1, 2), np.array(pairs, np.int64).reshape(-1, 2)


def gold(spans: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> np.ndarray:
    """Label of each token: 0, or 1 + the kind of the first base span that overlaps it. Both lists ascend."""
    out = np.zeros(len(spans), np.int64)
    at = 0
    longest = max((e - s for s, e, _ in base), default=0)
    for i, (s, e) in enumerate(spans):
        while at < len(base) and base[at][0] + longest <= s:
            at += 1
        for a, b, k in base[at:]:
            if a >= e:
                break
            if b > s:
                out[i] = 1 + KINDS.index(k)
                break
    return out


class Field:
    """Token weights, and log factors of chain and skip pairs."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    def beliefs(self, feats: np.ndarray, chain: np.ndarray, skip: np.ndarray, observed: np.ndarray | None = None) -> np.ndarray:
        """Label beliefs of each token by loopy sum-product in the log domain, damped by half. observed: labels that are known, 0 where they aren't."""
        unary = self.weights[feats].sum(1)
        unary = unary - np.logaddexp.reduce(unary, 1, keepdims=True)
        if observed is not None and observed.any():
            known = np.flatnonzero(observed)
            unary[known] = -30.0
            unary[known, observed[known]] = 0.0
        pairs = np.concatenate([chain, skip])
        if not len(pairs):
            return np.exp(unary)
        factor = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        factor = np.concatenate([factor, factor.transpose(0, 2, 1)])
        half = len(pairs)
        back = np.r_[np.arange(half, 2 * half), np.arange(half)]
        message = np.zeros((2 * half, unary.shape[1]))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            new = np.logaddexp.reduce(out[:, :, None] + factor, 1)
            new -= np.logaddexp.reduce(new, 1, keepdims=True)
            if np.abs(new - message).max() < 1e-4:
                break
            message = (new + message) / 2
        total = unary.copy()
        np.add.at(total, target, message)
        return np.exp(total - np.logaddexp.reduce(total, 1, keepdims=True))


def train(sample: list[tuple]) -> Field:
    """Piecewise fit on (features, labels, chain, skip) of documents."""
    k = len(KINDS) + 1
    x = np.concatenate([s[0] for s in sample])
    y = np.concatenate([s[1] for s in sample])
    w = np.zeros((SLOTS, k))
    rate = np.zeros((SLOTS, 1)) + 1e-6
    for _ in range(120):  # softmax regression, step sizes adapted to each slot
        z = w[x].sum(1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = np.zeros_like(w)
        for j in range(x.shape[1]):
            np.add.at(g, x[:, j], p)
        g = g / len(y) + 1e-5 * w
        rate += (g**2).sum(1, keepdims=True)
        w -= 0.5 * g / np.sqrt(rate)

    def ratio(at: int, free: float) -> np.ndarray:
        counts = np.full((k, k), free)
        for s in sample:
            if len(s[at]):
                np.add.at(counts, (s[1][s[at][:, 0]], s[1][s[at][:, 1]]), 1)
                np.add.at(counts, (s[1][s[at][:, 1]], s[1][s[at][:, 0]]), 1)
        p = counts / counts.sum()
        return np.clip(np.log(p) - np.log(p.sum(1))[:, None] - np.log(p.sum(0))[None, :], -3, 3)

    agree = np.eye(k) * 10  # prior of the skip factor: similar tokens agree
    skip = ratio(3, 1.0)
    return Field(w, ratio(2, 1.0), np.clip(skip + agree - agree.mean(), -8, 8))


def added(text: str, base: list[tuple[int, int, str]], field: Field) -> list[tuple[int, int, str]]:
    """Spans of tokens that the field is sure of and no base span touches."""
    spans = tokens(text)
    if not spans:
        return []
    observed = gold(spans, base)
    belief = field.beliefs(features(text, spans), *edges(text, spans), observed)
    out = []
    for (s, e), b, known in zip(spans, belief, observed):
        best = int(b.argmax())
        if best and b[best] >= SURE and not known and MARKED.search(text, s, e):
            core = text[s:e].strip(".,;:!?\"'[]#*$%&|")
            if core:
                at = s + text[s:e].index(core)
                if out and out[-1][2] == KINDS[best - 1] and at - out[-1][1] == 1:  # the next word of the same span
                    at = out.pop()[0]
                out.append((at, s + text[s:e].index(core) + len(core), KINDS[best - 1]))
    return out


def masks(text: str, spans: list[tuple[int, int]], labels: np.ndarray) -> np.ndarray:
    """Which labelled tokens of a training text show no shape: half of them, by a hash of the token."""
    return np.array([bool(y) and xxhash.xxh32_intdigest(text[s:e].encode("utf-8", "surrogatepass")) % 2 == 0 for (s, e), y in zip(spans, labels)], bool)


def fit(docs: DataFrame, rows: int = SAMPLE) -> Field | None:
    small_batches(docs.sparkSession)
    some = docs.where(F.col("text").rlike("[0-9@]"))
    some = sample_texts(some, some.select("doc_id"), rows)

    def work(batches):
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                spans = tokens(t)
                labels = gold(spans, base_spans(t))
                out.append(pickle.dumps((features(t, spans, masks(t, spans, labels)).astype(np.int16), labels, *edges(t, spans))))
            yield pd.DataFrame({"made": out})

    got = sorted(bytes(r["made"]) for r in some.mapInPandas(work, "made binary").collect())
    return train([pickle.loads(x) for x in got]) if got else None


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """SCHEMA's row for every row of docs (doc_id, text)."""
    field = fit(docs, rows)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]

    def one(text: str) -> tuple:
        base = base_spans(text)
        more = added(text, base, sent.value) if sent.value else []
        spans = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        return (*(sum(k == kind for *_, k in base) for kind in KINDS), digest, joined(spans), len(more))

    def work(batches):
        for pdf in batches:
            out = pd.DataFrame([one(t) for t in pdf["text"]], columns=names, index=pdf.index)
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(work, SCHEMA)
