"""Links between the tokens of two vocabularies, each different text aligned once.

Documents are grouped by their full text, so a text is tokenised and aligned once however often it stands in the corpus. Vocabulary A (byte-level)
and B (pieces with byte fallback) cut the same bytes; places where tokens of both end part them into groups, and in a group every A token is linked with
every B token. An id pair's count is the number of documents that hold it, copies counted: pairs of the distinct texts are
summed with the texts' multiplicity. Counts come back once a group of packs (see packs.py), and the measures go to all doc_ids of a text by its
SHA-256. Measures of texts that hold a 1 / HOT part of all rows or more, fewer than HOT by counting, are broadcast, so that no copies meet in one task.

Tokens don't run over the places packs.py cuts at, so pieces of text are encoded once and kept by each worker, KEPT or KEPT_PLAIN at most, then anew.

Null and empty texts, and texts whose tokens don't give space + text again (as with U+2581 in them), have no tokens: zeros and an empty string. Rows
of null or equal doc_id keep a row each. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import small_batches, text_of, written
from semloom.llm.packs import ODD_END, beside_facts, by_group, packed, pieces_of, unpacked
from semloom.llm.token_cache import Ragged, WordTable

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
KEPT = 300_000
KEPT_PLAIN = 450_000  # where the groups aren't written out
HOT = 10_000
SHIFT = 20  # a pair is its A id in the upper bits and its B id in the lower ones
LEAD = b" x"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


#: Fixed value: how byte-level vocabularies part a text before they merge.
PARTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves and the others, in order, as letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabularies:
    """Both vocabularies' encoders and the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_of_letter()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for word, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(letters[c] for c in word)
        self.quick = self.by_ranks(byte_level)
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.get_piece_size())
        ]
        def ended(n, mark):
            return np.array([b"%d%s" % (i, mark) for i in range(n)], object)

        a, b = len(self.a_bytes), len(self.b_bytes)
        self.a_shown, self.a_last, self.b_shown, self.b_last = ended(a, b","), ended(a, b"|"), ended(b, b","), ended(b, b";")
        self.a_width, self.b_width = (np.array([len(x) for x in v], np.int64) for v in (self.a_shown, self.b_shown))
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))

    def by_ranks(self, byte_level: str):
        """A cheaper encoder of the same vocabulary for ASCII texts, where its ids are in the order of its merges, as its merging by ranks asks for; else None."""
        import tiktoken

        with open(byte_level) as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x}
        return tiktoken.Encoding("ranks", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        if self.quick and text.isascii():
            return self.quick.encode_ordinary(text)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_b(self, text: str) -> list[int]:
        """Ids of a text that begins with a space; the model adds it."""
        return self.b.encode(text[1:])


def split_ids(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """Number of ids in each part of the bytes that ends at ends; None if a token runs over an end."""
    at = np.cumsum(sizes[ids])
    cut = np.searchsorted(at, ends, side="right")
    return np.diff(cut, prepend=0) if len(at) and (at[cut - 1] == ends).all() else None


def align(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, ends of the groups), groups numbered from 0; both end at the same byte."""
    ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends), ends


class Aligner:
    """Per piece of text: its links, the number of its tokens, groups and links, and its groups written out."""

    def __init__(self, byte_level: str, pieces: str, shown: bool = True):
        self.vocabularies, self.show = Vocabularies(byte_level, pieces), shown
        self.reset()

    def reset(self):
        self.table, self.links, self.shown = WordTable(), Ragged(np.int64), Ragged(np.uint8)
        self.sums, self.fits = np.zeros((1 << 14, 4), np.int64), np.ones(1 << 14, bool)

    def rows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Rows of each text's pieces."""
        if self.table.full(KEPT if self.show else KEPT_PLAIN):
            self.reset()
        out = [self.table.rows(t) for t in texts]
        if fresh := self.table.fresh:
            self.learn(fresh)
            self.table.fresh = []
        return out

    def learn(self, fresh: list[bytes]) -> None:
        first = self.links.grow(len(fresh))
        while first + len(fresh) > len(self.sums):
            self.sums, self.fits = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.fits, np.ones_like(self.fits)])
        self.shown.grow(len(fresh))
        plain = [i for i, p in enumerate(fresh) if p[0] in b" \n\t" and (32 < p[-1] < 127 or p[-1] > 127 and not ODD_END.search(p))]
        for same in ([i for i in plain if fresh[i].isascii()], [i for i in plain if not fresh[i].isascii()]):
            for i in range(0, len(same), 2000):
                self.take(first, fresh, same[i : i + 2000])
        for i in sorted(set(range(len(fresh))) - set(plain)):
            self.take(first, fresh, [i])

    def take(self, first: int, fresh: list[bytes], part: list[int]) -> None:
        """Encode these pieces as one text, behind LEAD, which makes it begin with a space."""
        v = self.vocabularies
        raw = LEAD + b"".join([fresh[i] for i in part])
        text, ends = raw.decode(), np.cumsum([len(LEAD), *(len(fresh[i]) for i in part)])
        a, b = np.array(v.encode_a(text), np.int64), np.array(v.encode_b(text), np.int64)
        same = b"".join([v.b_bytes[i] for i in b]) == raw and b"".join([v.a_bytes[i] for i in a]) == raw
        sizes = [split_ids(x, s, ends) for x, s in ((a, v.a_sizes), (b, v.b_sizes))] if same else [None]
        if any(s is None for s in sizes):
            if len(part) > 1:
                for i in part:
                    self.take(first, fresh, [i])
            else:
                self.fits[first + part[0]] = False
            return
        a, b, ends = a[sizes[0][0] :], b[sizes[1][0] :], ends[1:] - len(LEAD)
        sizes = [s[1:] for s in sizes]
        rows = first + np.array(part)
        ga, gb, closes = align(a, b, np.cumsum(v.a_sizes[a]), np.cumsum(v.b_sizes[b]))
        na, nb = np.bincount(ga, minlength=len(closes)), np.bincount(gb, minlength=len(closes))
        each = na * nb
        # links: the A tokens of a group, each beside all its B tokens
        times = nb[ga]
        begin = np.cumsum(nb) - nb
        within = np.arange(each.sum()) - np.repeat(np.cumsum(times) - times, times)
        links = (np.repeat(a, times) << SHIFT) | b[np.repeat(begin[ga], times) + within]
        of = np.searchsorted(ends, closes)  # the piece of each group
        n_links = np.bincount(of, weights=each, minlength=len(part)).astype(np.int64)
        self.links.put(rows, links, n_links)
        self.sums[rows] = np.stack([sizes[0], sizes[1], np.bincount(of, minlength=len(part)), n_links], 1)
        if self.show:
            self.write(rows, a, b, ga, gb, na, nb, of)

    def write(self, rows, a, b, ga, gb, na, nb, of):
        """The groups of each piece as text: A's ids, a bar, B's ids, and a semicolon behind each group."""
        v, flat = self.vocabularies, np.empty(len(a) + len(b), object)
        last_a, last_b = np.diff(ga, append=-1) != 0, np.diff(gb, append=-1) != 0
        flat[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = np.where(last_a, v.a_last[a], v.a_shown[a])
        flat[np.arange(len(b)) + np.cumsum(na)[gb]] = np.where(last_b, v.b_last[b], v.b_shown[b])
        sizes = np.bincount(of[ga], weights=v.a_width[a], minlength=len(rows)) + np.bincount(of[gb], weights=v.b_width[b], minlength=len(rows))
        self.shown.put(rows, np.frombuffer(b"".join(flat.tolist()), np.uint8), sizes.astype(np.int64))


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(paths: tuple[str, str], shown: bool = True) -> Aligner:
    """This worker's aligner; only the last one is kept."""
    if (paths, shown) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[paths, shown] = Aligner(*paths, shown)
    return _ALIGNERS[paths, shown]


def spaced(raw: bytes) -> list[bytes]:
    """The pieces of space + text; none of an empty text."""
    return pieces_of(b" " + raw) if raw else []


def pair_sums(packs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(gid, pair, n): the id pairs of each group of packs, and the number of documents that hold them."""

    def emit(gid, pairs, sums):
        for i in range(0, len(pairs), 100_000):
            part = slice(i, i + 100_000)
            n = len(pairs[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gid)), pa.array(pairs[part]), pa.array(sums[part])], ["gid", "pair", "n"])

    def merge(held):
        pairs, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for p, _ in held)]), return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, at, np.concatenate([np.zeros(0, np.int64), *(s for _, s in held)]))
        return pairs, sums

    def work(batches):
        made, now, held = aligner(paths, shown=False), None, []
        for batch in batches:
            for gid, pack in zip(batch.column("gid").to_pylist(), batch.column("pack")):
                if gid != now:
                    yield from emit(now, *merge(held))
                    now, held = gid, []
                rows = unpacked(pack.as_py())
                at = made.rows([spaced(t) for t in rows["text"].cast(pa.binary()).to_pylist()])
                at = [x if made.fits[x].all() else x[:0] for x in at]
                once = [np.unique(x) for x in at]
                flat = np.concatenate([np.zeros(0, np.int64), *once])
                sizes = made.links.sizes[flat].astype(np.int64)
                text = np.repeat(np.repeat(np.arange(len(at)), [len(x) for x in once]), sizes)
                links = made.links.gather(flat)
                links, text = np.divmod(np.sort(links * len(at) + text), max(len(at), 1))
                new = np.diff(links, prepend=-1) != 0
                first = new | (np.diff(text, prepend=-1) != 0)
                times = rows["times"].to_numpy()[text] * first
                starts = np.flatnonzero(new)
                held.append((links[starts], np.add.reduceat(times, starts) if len(starts) else times))
                if len(held) == 32:
                    held = [merge(held)]
        yield from emit(now, *merge(held))

    return packs.mapInArrow(work, "gid long, pair long, n long")


def measures(packs: DataFrame, counted: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(key, COUNTS, n_best, count_sum, groups_sha256) of each packed text; counted (gid, pair, n, best): the counts of each group's pairs and whether they
    are the highest of their A id."""
    names = ["key", *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def work(batches):
        made, now = aligner(paths), None
        for gid, facts, packs in by_group(batches, ["pair", "n", "best"]):
            if gid != now:
                pairs, n, best = (facts[c].to_numpy().astype(np.int64) if facts is not None else np.zeros(0, np.int64) for c in ("pair", "n", "best"))
                order = np.argsort(pairs)
                pairs, n, best, now = pairs[order], n[order], best[order], gid
            for pack in packs:
                rows = unpacked(pack)
                at = made.rows([spaced(t) for t in rows["text"].cast(pa.binary()).to_pylist()])
                at = [x if made.fits[x].all() else x[:0] for x in at]
                # the counts of each different piece of the pack, then sums over the texts' pieces
                once, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *at]), return_inverse=True)
                found = np.searchsorted(pairs, made.links.gather(once))
                bounds = np.concatenate([[0], np.cumsum(made.links.sizes[once])])
                both = np.zeros((len(found) + 1, 2), np.int64)
                both[1:] = np.cumsum(np.stack([best[found], n[found]], 1), 0)
                each = np.concatenate([made.sums[once], both[bounds[1:]] - both[bounds[:-1]]], 1)
                sums = np.zeros((len(inverse) + 1, 6), np.int64)
                np.cumsum(each[inverse], 0, out=sums[1:])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in at])])
                sums = sums[ends[1:]] - sums[ends[:-1]]
                shown = [sha256(made.shown.gather(x)[:-1]).hexdigest() if len(x) else "" for x in at]
                columns = [rows["key"].combine_chunks(), *(pa.array(c) for c in sums.T), pa.array(shown, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "key binary, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string"
    return beside_facts(packs, counted).mapInArrow(work, schema)


def links(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, COUNTS, n_best, count_sum, groups_sha256) for every row of docs."""
    import public_tokenizers

    paths = paths or (public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))
    small_batches(docs.sparkSession)
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")
    texts = docs.select(text_of().alias("text")).groupBy("text").agg(F.count("*").alias("times"))
    packs = packed(texts.select("text", "times", key), "texts")
    seen = written(pair_sums(packs, paths), "pairs")
    counts = seen.groupBy("pair").agg(F.sum("n").alias("n"))
    upper = F.shiftright("pair", SHIFT)
    top = counts.groupBy(upper.alias("a")).agg(F.max("n").alias("top"))
    counts = counts.withColumn("a", upper).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))
    counted = seen.select("gid", "pair").join(written(counts, "counts"), "pair")
    found = written(measures(packs, counted, paths), "measures")

    keyed = written(docs.select("doc_id", F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("key")), "keys")
    return to_copies(keyed, found)


def to_copies(keyed: DataFrame, found: DataFrame, hot: int = HOT) -> DataFrame:
    """keyed (doc_id, key) with found's columns for the key. Keys of a 1 / hot part of the rows or more are at most hot in number; they are joined by broadcast."""
    least = max(2, keyed.count() // hot)
    often = keyed.groupBy("key").count().where(F.col("count") > least).select("key", F.lit(True).alias("often"))
    often = F.broadcast(written(often, "often"))
    marked, measured = keyed.join(often, "key", "left"), found.join(often, "key", "left")
    common = marked.where("often").drop("often").join(F.broadcast(measured.where("often").drop("often")), "key")
    rare = marked.where("often is null").drop("often").join(measured.where("often is null").drop("often"), "key")
    return common.union(rare).drop("key")
