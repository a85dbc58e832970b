"""Mixing to target weights with soft membership.

A classifier learnt from a labelled table predicts each document's domain posterior. Its margins are turned into posteriors by a softmax of linear
functions of all margins, fitted to the margins that labelled rows get while they are kept out of the model (FOLDS parts in turn). How far posteriors of
one domain's documents lie in others is measured on the labelled rows too, kept out and as the model knows them: the targets are turned into the posterior totals that
the wanted mixture would show under this confusion. Document rates
r >= 0 minimise the squared distance of the expected domain token shares, sum_i r_i t_i p_ik / T, from the
targets, by Newton steps on the K multipliers of the dual. Each step is one aggregate of K and K x K sums
over all documents; rates stay in the table, never on the driver. Whole copies: floor(rate) and one more with the fraction's
probability, by a hash of doc_id.

Null text has no tokens (rate as the posterior of an empty text says; it adds nothing). Domains without labels get posterior 0. Without any labels
every posterior is uniform. Repeated rows are rated alike; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import small_batches, text_of, written
from semloom.llm.ngram_svm import SAMPLE, Model, sample_rows, words_of

#: Steps at most; residual at which they end; weight of the squared distance from rate 1, which keeps the multipliers finite where targets are out of reach.
STEPS = 100
TOLERANCE = 1e-4
RIDGE = 1e-6
MOST = float("inf")
FOLDS = 5
PRIOR = 0.1  # weight of the squared calibration weights


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def calibration(margins: np.ndarray, y: np.ndarray, k: int, steps: int = 30) -> np.ndarray:
    """Weights (margins and offset x domains) of the softmax that makes y likeliest, by Newton steps."""
    x = np.concatenate([margins, np.ones((len(margins), 1))], 1)
    w, truth = np.zeros((x.shape[1], k)), np.eye(k)[y]
    loss = lambda w: PRIOR / 2 * (w**2).sum() - np.log(np.maximum(softmax(x @ w)[np.arange(len(y)), y], 1e-300)).sum()
    for _ in range(steps):
        p = softmax(x @ w)
        slope = x.T @ (p - truth) + PRIOR * w
        curve = np.einsum("ni,nj,nab->iajb", x, x, p[:, :, None] * (np.eye(k) - p[:, None, :])).reshape(w.size, w.size) + PRIOR * np.eye(w.size)
        step, size = np.linalg.solve(curve, slope.ravel()).reshape(w.shape), 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


class Domains:
    """The model of all labelled rows (sorted by label), weights of calibration by kept-out rows, and the mean posteriors of each domain's words: kept out, and in the
    model's own rows. Domains without rows get posterior 0."""

    def __init__(self, ids: list[np.ndarray], y: np.ndarray, words: np.ndarray, k: int):
        self.model, self.weights, self.words = Model(ids, [(y == j).astype(int) for j in range(k)]), np.zeros((k + 1, k)), int(words.sum())
        self.out, self.own = np.eye(k), np.eye(k)
        there = np.flatnonzero(np.bincount(y, minlength=k))
        if 0 < len(there) < k:
            self.weights[k, np.setdiff1d(np.arange(k), there)] = -1e3
        if len(there) < 2:
            return
        part, margins = np.arange(len(y)) % FOLDS, np.zeros((len(y), k))
        for f in range(FOLDS):
            other = Model([x for x, g in zip(ids, part) if g != f], [(y[part != f] == j).astype(int) for j in range(k)])
            for i in np.flatnonzero(part == f):
                margins[i] = other.margins_of(ids[i])
        self.weights[:, there] = calibration(np.clip(margins, -60, 60), np.searchsorted(there, y), len(there))
        for table, p in ((self.out, self.posteriors(margins)), (self.own, self.posteriors(np.array([self.model.margins_of(x) for x in ids])))):
            for j in there:
                table[j] = (words[y == j] + 1.0) @ p[y == j] / (words[y == j] + 1.0).sum()

    def posteriors(self, margins: np.ndarray) -> np.ndarray:
        return softmax(np.clip(margins, -60, 60) @ self.weights[:-1] + self.weights[-1])

    def confusion(self, words: int) -> np.ndarray:
        """Row j: mean posteriors of domain j's words in a corpus of so many words, the labelled rows among them."""
        own = min(1.0, self.words / max(words, 1))
        return own * self.own + (1 - own) * self.out


def fitted(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = SAMPLE) -> Domains:
    """Domains of at most `rows` rows of labelled (doc_id, domain) and their texts in docs."""
    index = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    known = labelled.where(F.col("domain").isin(domains)).select("doc_id", index.alias("label"))
    return Domains(*sample_rows(docs, known, rows), len(domains))


def posteriors(docs: DataFrame, made: Domains) -> DataFrame:
    """(doc_id, tokens, p0 .. pK-1) of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(made)
    names = [f"p{j}" for j in range(len(made.out))]

    def work(batches):
        for pdf in batches:
            words = [words_of(t) for t in pdf["text"]]
            margins = np.array([sent.value.model.margins(w) for w in words], np.float64).reshape(len(pdf), -1)
            out = pd.DataFrame(sent.value.posteriors(margins), columns=names, index=pdf.index)
            out.insert(0, "tokens", np.array([len(w) for w in words], np.int64))
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    schema = "doc_id long, tokens long, " + ", ".join(f"{c} double" for c in names)
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(work, schema)


def rates(members: DataFrame, targets: list[float], steps: int = STEPS, most: float = MOST, held: int | None = None, confusion=None) -> DataFrame:
    """members (doc_id, tokens, p0 ..) with columns rate in [0, most] and residual, the largest error of a domain's share.

    The rates nearest to 1 that meet the targets are 1 less a sum of posteriors weighted by K multipliers, clipped. Newton steps on the
    multipliers, the best of six lengths each, go on until the residual is below TOLERANCE or no step helps, at most `steps`. held: the domain whose documents (those where its posterior is greatest) keep rate 1; the
    targets then are its mass, which isn't asked for, and the others' in proportion to it, at most what there is of them. confusion(words): mean posteriors (columns) of each domain's words (rows).
    """
    k = len(targets)
    names = [f"p{i}" for i in range(k)]
    target = np.array(targets, float) / sum(targets)
    total = members.agg(
        F.sum("tokens").alias("t"),
        *[F.sum(F.col("tokens") * F.col(a)).alias(a) for a in names],
    ).first()
    if not total["t"]:
        return members.withColumn("rate", F.lit(1.0)).withColumn("residual", F.lit(0.0))
    free, mixed = F.lit(True), np.eye(k) if confusion is None else confusion(total["t"])
    if held is not None:
        there = np.array([total[c] for c in names]) / total["t"]
        there = np.maximum(0, np.linalg.lstsq(mixed.T, there)[0])  # the domains' own masses
        target = np.minimum(there, there[held] * target / target[held])
        free = F.col(names[held]) < F.greatest(F.lit(0.0), *names)
    target = mixed.T @ target
    weigh = np.zeros(k)
    asked = np.arange(k) != held  # the held domain is as it is

    def wanted(v):
        return 1 - sum((F.lit(float(e)) * F.col(c) for e, c in zip(v, names)), F.lit(0.0))

    def rate(v):
        return F.when(free, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), wanted(v)))).otherwise(1.0)

    def at(tried):
        """(gap, curvature, residual) at each of these multipliers, in one aggregate."""
        sums = []
        for n, v in enumerate(tried):
            r, t = rate(v), F.col("tokens")
            inner = (free & wanted(v).between(0.0, float(most))).cast("double")  # bounds included: with most 1, all rates begin there
            sums += [F.sum(t * r * F.col(c)).alias(f"g{n}{c}") for c in names]
            sums += [F.sum(t * inner * F.col(c) * F.col(d)).alias(f"h{n}{c}{d}") for c in names for d in names]
        got = members.agg(*sums).first()
        for n, v in enumerate(tried):
            error = (np.array([got[f"g{n}{c}"] for c in names]) / total["t"] - target) * asked
            yield error - RIDGE * v, np.array([[got[f"h{n}{c}{d}"] for d in names] for c in names]) / total["t"], float(np.abs(error).max())

    gap, curve, residual = next(at([weigh]))
    for _ in range(steps):
        if residual < TOLERANCE or np.abs(gap).max() < RIDGE:
            break
        move = np.linalg.solve(curve * asked * asked[:, None] + RIDGE * np.eye(k), gap)
        tried = [weigh + move * f for f in (1.0, 0.5, 0.2, 0.05, 0.01, 0.001)]
        found = list(at(tried))
        best = min(range(len(tried)), key=lambda n: float(found[n][0] @ found[n][0]))
        if found[best][0] @ found[best][0] >= gap @ gap * (1 - 1e-6):
            break
        weigh, (gap, curve, residual) = tried[best], found[best]
    return members.withColumn("rate", rate(weigh)).withColumn("residual", F.lit(residual))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rows: int = SAMPLE, steps: int = STEPS, most: float = MOST, held: str | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, tokens, domain, posterior of each domain, rate, copies, residual) for every row of docs; held: see rates; texts: where the labelled rows' texts are, if not docs."""
    domains = sorted(targets)
    made = fitted(docs if texts is None else texts, labelled, domains, rows)
    members = written(posteriors(docs, made), "posteriors")
    out = rates(members, [targets[d] for d in domains], steps, most, None if held is None else domains.index(held), made.confusion)
    names = [f"p{i}" for i in range(len(domains))]
    best = F.greatest(*names) if len(names) > 1 else F.col("p0")
    domain = F.coalesce(*[F.when(F.col(c) == best, F.lit(d)) for c, d in zip(names, domains)])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return out.select(
        "doc_id", "tokens", domain.alias("domain"), *[F.col(c).alias(f"p_{d}") for c, d in zip(names, domains)], "rate", copies.alias("copies"), "residual"
    )
