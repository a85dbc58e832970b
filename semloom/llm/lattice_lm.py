"""Log probability of whole texts under a subword lattice.

The pieces of an existing public vocabulary, and all single bytes, span a lattice over a text's bytes: every way to cut the text into pieces
is a path. A unigram model gives each piece a probability; a text's probability is the sum over all paths, by forward recursion in log space,
times the probability of its end. Pieces never run across the start of a word's white space, so the recursion is done once for each
distinct piece of text between such places (a stretch: a word and the white space before it), in Spark tables, not once for each text.

The vocabulary's scores are ranks, not log probabilities; they give the weights to begin with, falling as one over the rank. ROUNDS
of expectation maximisation over all paths of all training texts then give the model's probabilities, with the first weights as pseudo-counts: expected
counts are summed over the distinct stretches of the whole corpus, and only one number a piece reaches the driver.

Beside it stands the base model: add-0.1 counts of lower-case words and ends over the training texts.

Null text counts as empty: its end alone. Rows of null doc_id are learnt from and not held out. Repeated rows count each. Empty tables give no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import small_batches, text_of, written
from semloom.llm.packs import beside_facts, bucketed, by_group, packed, pieces_of, unpacked
from semloom.llm.token_cache import WordTable

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
BEGIN = 10  # added to a rank before it is turned into a weight
PSEUDO = 1.0  # pseudo-counts for each piece, on average
SMOOTH = 0.1  # fixed value: of the base model
AT_ONCE = 1 << 16  # bytes of stretches in one recursion
SHORT = 20  # bytes up to which stretches of one length are worked on as rows of a table
UNKNOWN_SCORE = -1e8  # pieces scored below it have no rank


def vocabulary(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a byte piece once for each byte) and their first log weights."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ranks = {bytes([b]): math.inf for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            piece, score = model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i)
            ranks[piece] = min(ranks.get(piece, math.inf), -score if score > UNKNOWN_SCORE else math.inf)
    pieces = sorted(ranks)
    rank = np.array([ranks[p] for p in pieces])
    weight = 1 / (BEGIN + np.where(np.isinf(rank), len(pieces), rank))
    return pieces, np.log(weight / weight.sum())


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exp of the terms, of which one at least is finite."""
    top = terms[0] if len(terms) == 1 else np.maximum.reduce(terms)
    return top + np.log(sum(np.exp(t - top) for t in terms)) if len(terms) > 1 else top


class Lattice:
    """Forward and backward recursion over many byte strings at once."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        nodes: dict[tuple[int, int], int] = {}
        ends = [0] * len(pieces)
        for i, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                node = nodes.setdefault((node, byte), len(nodes) + 1)
            ends[i] = node
        self.next = np.zeros((len(nodes) + 2, 256), np.int32)  # node 0 is the root, and no node; the last has no way on
        keys = np.array(list(nodes), np.int64).reshape(-1, 2)
        self.next[keys[:, 0], keys[:, 1]] = np.fromiter(nodes.values(), np.int32, len(nodes))
        self.piece = np.full(len(nodes) + 2, -1, np.int32)
        self.piece[ends] = np.arange(len(pieces))
        self.logs = np.asarray(logs, np.float64)

    def edges(self, flat: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in flat that stay before end_of their start."""
        starts, ends, pieces = [], [], []
        at, node, depth = np.arange(len(flat)), np.zeros(len(flat), np.int32), 0
        while len(at):
            node = self.next[node, flat[at + depth]]
            depth += 1
            found = self.piece[node]
            hit = found >= 0
            starts.append(at[hit])
            ends.append(at[hit] + depth)
            pieces.append(found[hit])
            on = (node > 0) & (at + depth < end_of[at])
            at, node = at[on], node[on]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends, pieces))

    def run(self, texts: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each text's sum over all paths and, if counts are given, the pieces' expected counts, a text counting so many times."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out, expected = np.zeros(len(texts)), None if counts is None else np.zeros(len(self.logs))
        for size in range(1, SHORT + 1):
            same = np.flatnonzero(sizes == size)
            for part in np.split(same, range(AT_ONCE // size, len(same), AT_ONCE // size)):
                if len(part):
                    self._table(b"".join([texts[i] for i in part]), size, part, out, counts, expected)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > SHORT]
        cut = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // AT_ONCE)) + 1
        for part in np.split(order, cut):
            if len(part):
                self._run(b"".join([texts[i] for i in part]), sizes[part], part, out, counts, expected)
        return out, expected

    def _table(self, flat, size, part, out, counts, expected):
        """The recursion for texts of one size: depth by depth the pieces of all places, then place by place all sums."""
        letters = np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(-1, size).T)
        node, weights, pieces = np.zeros(letters.shape, np.int32), [], []
        for depth in range(size):
            node = self.next[node[: size - depth], letters[depth:]]
            if not node.any():
                break
            pieces.append(self.piece[node])
            weights.append(np.where(pieces[-1] >= 0, self.logs[pieces[-1]], -np.inf))
            node[node == 0] = len(self.piece) - 1  # a path that has ended stays at its end
        alpha = np.zeros((size + 1, len(part)))
        for end in range(1, size + 1):
            alpha[end] = log_sum([alpha[end - d - 1] + w[end - d - 1] for d, w in enumerate(weights[:end])])
        out[part] = alpha[size]
        if counts is not None:
            beta = np.zeros((size + 1, len(part)))
            for start in range(size - 1, -1, -1):
                beta[start] = log_sum([beta[start + d + 1] + w[start] for d, w in enumerate(weights[: size - start])])
            for d, (piece, w) in enumerate(zip(pieces, weights)):
                there = np.nonzero(piece >= 0)
                share = np.exp(alpha[: len(w)][there] + w[there] + beta[d + 1 :][there] - alpha[size][there[1]]) * counts[part][there[1]]
                expected += np.bincount(piece[there], weights=share, minlength=len(expected))

    def _run(self, flat, sizes, part, out, counts, expected):
        flat = np.frombuffer(flat, np.uint8)
        last = np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        offset = np.arange(len(flat)) - (last - sizes)[text]
        start, end, piece = self.edges(flat, last[text])
        weight, text = self.logs[piece], text[start]
        # place p of text t is cell p + t: texts have one more place than bytes
        begin, close = start + text, end + text
        place = offset[start] + end - start
        alpha = np.zeros(len(flat) + len(sizes))
        self._sweep(alpha, place, close, begin, weight)
        total = alpha[last + np.arange(len(sizes))]
        out[part] = total
        if counts is not None:
            beta = np.zeros(len(alpha))
            left = (last - sizes)[text] + sizes[text] - start  # places from the start to the text's end
            self._sweep(beta, left, begin, close, weight)
            share = np.exp(alpha[begin] + weight + beta[close] - total[text]) * counts[part][text]
            expected += np.bincount(piece, weights=share, minlength=len(expected))

    @staticmethod
    def _sweep(sums, step, to, source, weight):
        """sums[to] = log of the sum of exp(sums[source] + weight) over its edges, in order of step."""
        order = np.lexsort((to, step))
        step, to, source, weight = step[order], to[order], source[order], weight[order]
        bounds = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            v = sums[source[a:b]] + weight[a:b]
            first = np.flatnonzero(np.diff(to[a:b], prepend=-1))
            top = np.maximum.reduceat(v, first)
            total = np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(first, b - a)))), first)
            sums[to[a + first]] = top + np.log(total)


_LATTICES: list = [None, None]  # key and lattice of this worker


def lattice(sent) -> Lattice:
    if _LATTICES[0] != sent.id:
        _LATTICES[:] = sent.id, Lattice(*sent.value)
    return _LATTICES[1]


class Sent:
    """A broadcast model with an id of its own."""

    def __init__(self, spark, pieces, logs):
        self.held = spark.sparkContext.broadcast((pieces, logs))
        self.id = self.held._jbroadcast.id()

    @property
    def value(self):
        return self.held.value


def stretches(packs: DataFrame) -> DataFrame:
    """(gid, stretch, n): the distinct stretches of each group of packs and their number in its training texts (column train)."""

    def emit(gid, table, counts):
        words = list(table)
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            columns = [pa.array(np.full(len(part), gid)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(counts[i : i + len(part)])]
            yield pa.RecordBatch.from_arrays(columns, ["gid", "stretch", "n"])

    def work(batches):
        now, table, counts = None, WordTable(), np.zeros(1 << 12, np.int64)
        for batch in batches:
            for gid, pack in zip(batch.column("gid").to_pylist(), batch.column("pack")):
                if gid != now:
                    yield from emit(now, table, counts)
                    now, table, counts = gid, WordTable(), np.zeros(1 << 12, np.int64)
                rows = unpacked(pack.as_py())
                texts = [pieces_of(t) for t in rows["text"].cast(pa.binary()).to_pylist()]
                for train, words in zip(rows["train"].to_pylist(), texts):
                    at = table.rows(words)
                    table.fresh.clear()
                    if len(table) > len(counts):
                        counts = np.concatenate([counts, np.zeros(len(table), np.int64)])
                    if train:
                        np.add.at(counts, at, 1)
        yield from emit(now, table, counts)

    return packs.mapInArrow(work, "gid long, stretch string, n long")


def words_of(stretch):
    """Lower-case (A-Z) words of a column of stretches."""
    low = F.translate(stretch, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def joined(batches, rows: int = 40_000):
    """Tables of about so many rows from small batches: the recursion works on many stretches at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def expected_counts(table: DataFrame, sent: Sent, size: int) -> np.ndarray:
    """Expected counts of the pieces over a table (stretch, n)."""

    def work(batches):
        sums = np.zeros(size)
        for batch in joined(batches):
            texts = batch.column("stretch").cast(pa.binary()).to_pylist()
            sums += lattice(sent).run(texts, batch.column("n").to_numpy().astype(np.float64))[1]
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["piece", "share"])

    got = table.mapInArrow(work, "piece long, share double").groupBy("piece").agg(F.sum("share").alias("share")).toPandas()  # a row per piece
    out = np.zeros(size)
    out[got["piece"].to_numpy(np.int64)] = got["share"]
    return out


def maximise(expected: np.ndarray, first: np.ndarray, texts: int) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of a text's end, from expected counts, first log weights and the number of training texts."""
    mass = PSEUDO * len(first)
    total = math.log(expected.sum() + mass + texts + 1)
    return np.log(expected + mass * np.exp(first)) - total, math.log(texts + 1) - total


def scored(table: DataFrame, sent: Sent) -> DataFrame:
    """(stretch, log10p) of a table (stretch)."""

    def work(batches):
        for batch in joined(batches):
            texts = batch.column("stretch").cast(pa.binary()).to_pylist()
            yield from batch.append_column("log10p", pa.array(lattice(sent).run(texts)[0] / math.log(10))).to_batches()

    return table.mapInArrow(work, "stretch string, log10p double")


def score_texts(docs: DataFrame, held_out, model_file: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; held_out: a column of docs' rows that aren't learnt from."""
    import public_tokenizers

    spark = docs.sparkSession
    small_batches(spark)
    pieces, first = vocabulary(model_file or public_tokenizers.path(VOCABULARY))
    held_out = F.coalesce(held_out, F.lit(False))
    rows = docs.select("doc_id", text_of().alias("text"), (~held_out).alias("train"))
    packs = packed(rows, "packs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = bucketed(stretches(packs), "stretch", parts)
    table = written(seen.groupBy("stretch").agg(F.sum("n").alias("n")), "table")
    learnt = table.where("n > 0")

    words = written(learnt.select(F.explode(words_of("stretch")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("c")), "words")
    total = words.agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).first()
    texts = rows.where("train").count()
    tokens, kinds = (total["tokens"] or 0) + texts, total["words"] + (texts > 0)

    logs, end = maximise(np.zeros(len(first)), first, texts)
    for _ in range(rounds):
        logs, end = maximise(expected_counts(learnt, Sent(spark, pieces, logs), len(first)), first, texts)
    known = (
        table.select("stretch", F.explode(words_of("stretch")).alias("word"))
        .join(words, "word", "left")
        .groupBy("stretch")
        .agg(F.count("*").alias("n_words"), F.count("c").alias("n_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("base"))
    )
    facts = scored(table.select("stretch"), Sent(spark, pieces, logs)).join(known, "stretch", "left")
    facts = seen.select("gid", "stretch").join(facts, "stretch").na.fill(0)

    ending = np.array([1, int(texts > 0), math.log10(texts + SMOOTH), end / math.log(10)])
    each = math.log10(tokens + SMOOTH * (kinds + 1))
    names = ["n_words", "n_known", "base", "log10p"]

    def work(batches):
        now = None
        for gid, facts, packs in by_group(batches, ["stretch", *names]):
            if gid != now:
                table = values = None  # one group's at a time
                table = dict(zip(facts["stretch"].cast(pa.binary()).to_pylist(), range(len(facts)))) if facts is not None else {}
                values = np.stack([facts[c].to_numpy() for c in names], 1).astype(np.float64) if facts is not None else np.zeros((0, 4))
                now = gid
            for pack in packs:
                rows = unpacked(pack)
                sums = np.zeros((len(rows), 4))
                for i, raw in enumerate(rows["text"].cast(pa.binary()).to_pylist()):
                    at = np.fromiter(map(table.__getitem__, pieces_of(raw)), np.int64)
                    sums[i] = values[at].sum(0) + ending
                out = pd.DataFrame(sums, columns=names)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["doc_id"].combine_chunks().cast(pa.int64()),
                        pa.compute.invert(rows["train"].combine_chunks()),
                        pa.array(out["n_words"].astype(np.int64)),
                        pa.array(out["n_known"].astype(np.int64)),
                        pa.array(np.full(len(rows), tokens, np.int64)),
                        pa.array(out["base"] - each * out["n_words"]),
                        pa.array(out["log10p"]),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return beside_facts(packs, facts).mapInArrow(work, schema)
