"""Quality rules by tokeniser fertility.

Two public vocabularies split every word of a text: a SentencePiece one with byte fallback, and a byte-level one for many languages. Measures over all words: characters per token
under each vocabulary, the share of byte-fallback tokens, and the entropy of the tokens (bits, relative to the log of the token count, of SPREAD at most). Each has
a rejection band for each language (for each script where the language is null), fixed by the
distribution over all documents that pass the base rules: the median and WIDTHS spreads below and above, a spread being
the distance from the median to the 10 % or the 90 % quantile, at least a floor. A short
text scatters more: the band widens with SHORT / tokens.

Null text counts as empty: no words, fails the base rules. Repeated rows are judged alike, null doc_ids like others. Empty
tables give no rows. lang is used for the bands alone; other columns are ignored.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import small_batches, text_of, written
from semloom.llm.token_cache import Ragged, WordTable

VOCABULARY = "piece_bpe_32k.model"
SECOND = "byte_bpe_multi_50k.tiktoken"
SHORT = 60.0
SPREAD = 1024  # tokens from which a text's entropy hardly grows with its length
#: Spreads below and above the median that each measure's band reaches. Symbols, capitals, codes and split words lower the
#: characters per token; few things raise them.
WIDTHS = {"chars_per_token": (2.6, 8.0), "chars_per_token_2": (1.7, 8.0), "byte_share": (8.0, 4.0), "entropy": (3.0, 3.0)}
#: Least spread of each measure.
FLOORS = {"chars_per_token": 0.08, "chars_per_token_2": 0.08, "byte_share": 0.01, "entropy": 0.02}
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: First code point, last code point and name of the scripts told apart where the language is null.
SCRIPTS = ((0x0400, 0x052F, "cyrillic"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"), (0x0900, 0x097F, "devanagari"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"))

SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, chars_per_token_2 double, byte_share double, entropy double"


def script(text: str) -> str:
    """Most frequent script among the letters beyond Latin, else latin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = {name: int(((points >= lo) & (points <= hi)).sum()) for lo, hi, name in SCRIPTS}
    best = max(counts, key=counts.get)
    return best if counts[best] * 4 > len(points) else "latin"


def repeat_words(rows: np.ndarray, n: int = 5) -> int:
    """Words inside n-word windows that occur twice or more; rows: an integer for each word. Windows are told apart by 64-bit hashes."""
    if len(rows) <= n:
        return 0
    x = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = x[: len(x) - n + 1].copy()
    for j in range(1, n):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + x[j : len(x) - n + 1 + j]
    h ^= h >> np.uint64(31)
    sorted_ = np.sort(h)
    twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
    if not len(twice):
        return 0
    again = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(rows) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


class Meter:
    """Tokens of words, cached; one for each Python worker and pair of vocabularies."""

    def __init__(self, vocabulary: str, second: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        with open(second, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.second = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.reset()

    def reset(self):
        self.words, self.ids = WordTable(), Ragged()
        self.counts, self.n = np.zeros((3, 1 << 14), np.int32), 0  # of each word: tokens, byte tokens, tokens of the second vocabulary

    def learn(self, fresh: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in fresh]
        made = self.model.encode(texts, num_threads=1)
        size = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(chain.from_iterable(made), np.int32, int(size.sum()))
        self.ids.put(np.arange(self.ids.grow(len(made)), self.ids.n), flat, size)
        while self.n + len(fresh) > self.counts.shape[1]:
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)], 1)
        bytes_before = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        ends = np.cumsum(size)
        self.counts[:, self.n : self.n + len(fresh)] = size, bytes_before[ends] - bytes_before[ends - size], self.second_sizes(texts)
        self.n += len(fresh)

    def second_sizes(self, texts: list[str]) -> list[int]:
        return [len(self.second(" " + x)) for x in texts]

    def measure(self, text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        chars = np.frombuffer(raw, np.uint8)
        words = raw.split()
        symbols = int(SYMBOLS[chars].sum())
        word_chars = int(((chars & 0xC0) != 0x80).sum() - SPACES[chars].sum())
        if not words:
            return 0, word_chars, symbols, 0, 0, 0, 0.0, 0.0, 0.0, 0.0
        if self.words.full():
            self.reset()
        rows = self.words.rows(words)
        if self.words.fresh:
            self.learn(self.words.fresh)
            self.words.fresh = []
        n, n_byte, n_second = (int(x) for x in np.take(self.counts, rows, axis=1).sum(1, dtype=np.int64))
        ids = self.ids.gather(rows)
        ids.sort()
        at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
        p = np.diff(at) / max(n, 1)
        entropy = float(-(p * np.log2(p)).sum() / np.log2(min(n, SPREAD))) if n > 1 else 0.0
        return len(words), word_chars, symbols, dup_lines(text), repeat_words(rows), n, word_chars / max(n, 1), word_chars / max(n_second, 1), n_byte / max(n, 1), entropy


_METERS: dict[tuple[str, str], Meter] = {}


def measures(docs: DataFrame, vocabulary: str, second: str) -> DataFrame:
    """SCHEMA's row for each document (doc_id, text, lang)."""
    small_batches(docs.sparkSession)

    def work(batches):
        if (vocabulary, second) not in _METERS:
            _METERS[vocabulary, second] = Meter(vocabulary, second)
        meter = _METERS[vocabulary, second]
        names = [x.split()[0] for x in SCHEMA.split(", ")][2:]
        for pdf in batches:
            out = pd.DataFrame([meter.measure(t) for t in pdf["text"]], columns=names)
            lang = [x if x else script(t) for x, t in zip(pdf["lang"], pdf["text"])]
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.Series(lang, name="lang", dtype=object), out], axis=1)

    return docs.select("doc_id", text_of().alias("text"), "lang").mapInPandas(work, SCHEMA)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality(docs: DataFrame, vocabulary: str | None = None, second: str | None = None) -> DataFrame:
    """Measures, base_failed, kept and the reasons of the bands, for every row of docs."""
    import public_tokenizers

    rows = written(measures(docs, vocabulary or public_tokenizers.path(VOCABULARY), second or public_tokenizers.path(SECOND)), "fertility")
    names = list(FLOORS)
    mid = rows.where(~base_failed() & (F.col("n_tokens") > 0)).groupBy("lang").agg(
        *[F.percentile_approx(c, [0.1, 0.5, 0.9], 2000).alias(f"q_{c}") for c in names]
    )
    joined = rows.join(F.broadcast(mid), "lang", "left")  # a row for each language or script
    wide = F.sqrt(1 + SHORT / F.greatest(F.col("n_tokens"), F.lit(1)))

    def outside(c):
        q = F.col(f"q_{c}")
        low = F.greatest(q[1] - q[0], F.lit(FLOORS[c])) * WIDTHS[c][0] * wide
        high = F.greatest(q[2] - q[1], F.lit(FLOORS[c])) * WIDTHS[c][1] * wide
        return F.coalesce((F.col(c) < q[1] - low) | (F.col(c) > q[1] + high), F.lit(False))

    why = F.array_compact(F.array(*[F.when(outside(c), F.lit(c)) for c in names]))
    out = joined.withColumn("reasons", F.array_join(why, ",")).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("reasons") == "")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", *names, "reasons",
    )
