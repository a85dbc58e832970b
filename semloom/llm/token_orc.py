"""Token ids in ORC files: stripes, integer run-length encoding, row indexes, Bloom filters on document ids.

Texts are dealt to ranges of doc_id and sorted, tokenised in Arrow batches and written as ORC; a row
holds a document's ids and its place in its range. ORC encodes the integers in runs, indexes every
ROWS rows of a stripe, and carries a Bloom filter of doc_id, so readers split by stripe and skip
stripes and row groups by statistics. Global starts follow from one number per range.

Null text counts as empty: the end id alone. Null doc_ids come first. Rows with equal doc_id follow each other, ordered by a hash
of the text and then by their place in the table, so a doc_id that holds a third of all rows is dealt to many ranges.
An empty table gives an empty folder and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import new_path, small_batches, text_of
from semloom.llm.token_cache import Ragged, WordTable

VOCABULARY = "word_bpe_49k.json"
END = 2
TAIL = ".,!?;:%$&*#|"
#: Kinds of bytes.
SPACES, MARKS, PLAIN, LATIN = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\r\x0b\x0c", TAIL.encode(), b"0123456789abcdefghijklmnopqrstuvwxyz", {*range(0x80, 0xC0)} - {0x97, 0xB7}))
JOINED = 256  # letter pieces in a call
HELD = 192 << 20  # bytes in a worker's cache before it starts anew: what pieces take, with OBJECT bytes for each
OBJECT = 150
RUN = 4 << 20  # bytes of text whose pieces are looked up at once
STRIPE = 16 << 20
ROWS = 1000
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece encoded once and cached.

    The vocabulary lower-cases, and its pre-tokeniser never joins what ASCII white space parts, nor letters or digits with marks behind
    them. So texts are cut to pieces: words, and the TAIL marks behind them. New pieces of letters or TAIL
    marks are encoded many to a call: each is one pre-token, and its last id is of a word's end.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        ends = {i for w, i in self.model.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")}
        self.is_end = np.zeros(self.model.get_vocab_size() + 1, bool)
        self.is_end[list(ends)] = True
        self.reset()

    def reset(self):
        self.pieces, self.ids, self.held = WordTable(), Ragged(), 0

    def letters(self, text: str) -> bool:
        """Letters alone, also once the vocabulary has normalised them (lower-casing may give combining marks)."""
        return text.isalpha() and (text.isascii() or self.model.normalizer is None or self.model.normalizer.normalize_str(text).isalpha())

    def all_letters(self, texts: list[str]) -> list[bool]:
        """letters() of each text, the normaliser called once for all; one by one where its spaces don't stay those between the texts."""
        out = [t.isalpha() for t in texts]
        odd = [i for i, t in enumerate(texts) if out[i] and not t.isascii()]
        if odd and self.model.normalizer is not None:
            made = self.model.normalizer.normalize_str(" ".join([texts[i] for i in odd])).split(" ")
            for i, x in zip(odd, (m.isalpha() for m in made) if len(made) == len(odd) else (self.letters(texts[i]) for i in odd)):
                out[i] = x
        return out

    def parts(self, text: str) -> list[str]:
        """The piece, or its letters and the TAIL marks behind them."""
        body = text.rstrip(TAIL)
        return [body, text[len(body) :]] if len(body) < len(text) and self.letters(body) else [text]

    def learn(self, raw: list[bytes]) -> None:
        fresh = [r.decode("utf-8", "replace") for r in raw]
        first = self.ids.grow(len(fresh))
        plain = np.array([x or not p.strip(TAIL) for p, x in zip(fresh, self.all_letters(fresh))])
        odd = np.flatnonzero(~plain)
        plain = np.flatnonzero(plain)
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        made = self.model.encode_batch_fast([" ".join([fresh[i] for i in g]) for g in groups], add_special_tokens=False)
        for g, x in zip(groups, made):
            ids = np.array(x.ids, np.int32)
            ends = np.flatnonzero(self.is_end[ids])
            if len(ends) == len(g) and ends[-1] == len(ids) - 1:
                self.ids.put(first + g, ids, np.diff(ends, prepend=-1))
            else:
                odd = np.concatenate([odd, g])
        cut = [self.parts(fresh[i]) for i in odd]
        made = iter(self.model.encode_batch_fast(list(chain.from_iterable(cut)), add_special_tokens=False))
        for i, c in zip(odd, cut):
            ids = np.array(list(chain.from_iterable(next(made).ids for _ in c)), np.int32)
            self.ids.put(np.array([first + i]), ids, np.array([len(ids)]))
        self.held += sum(map(len, raw)) * 2 + OBJECT * len(raw)

    def encode(self, raws: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each closed by end; their sizes)."""
        if self.held > HELD:
            self.reset()
        pieces, counts = cut(raws)
        pieces = pieces.dictionary_encode()  # each distinct piece of the run is looked up once
        rows = self.pieces.rows(bytes_of(pieces.dictionary))[pieces.indices.to_numpy()]
        if self.pieces.fresh:
            self.learn(self.pieces.fresh)
            self.pieces.fresh = []
        ends = np.concatenate([[0], np.cumsum(self.ids.sizes[rows], dtype=np.int64)])[np.cumsum(counts)]
        ids = np.insert(self.ids.gather(rows), ends, end)
        return ids, np.diff(ends, prepend=0) + 1


def cut(raws: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts in lower case, one after the other; how many each text has).

    Words are cut at ASCII white space, and before TAIL marks at their end that stand behind an ASCII letter or digit or a Latin-1 letter (two bytes of UTF-8)."""
    joined = np.frombuffer(b"\n" + b"\n".join(raws).lower() + b"\n", np.uint8)
    space = SPACES[joined]
    inside = ~space
    starts, ends = (np.flatnonzero(x[:-1] & y[1:]) + 1 for x, y in ((space, inside), (inside, space)))
    body = ends.copy()  # where the marks at a word's end begin
    marked = np.flatnonzero(MARKS[joined[ends - 1]])
    other = np.flatnonzero(~MARKS[joined])  # white space before each word included
    body[marked] = other[np.searchsorted(other, ends[marked]) - 1] + 1
    last = joined[body - 1]
    apart = (body < ends) & (PLAIN[last] | ((joined[body - 2] == 0xC3) & LATIN[last]))
    is_piece = np.stack([np.ones_like(apart), apart], 1).ravel()
    sizes = np.stack([np.where(apart, body, ends) - starts, ends - body], 1).ravel()[is_piece]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    firsts = np.cumsum([1, *(len(r) + 1 for r in raws)])  # where texts begin
    before = np.concatenate([[0], np.cumsum(1 + apart)])[np.searchsorted(starts, firsts)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])]), np.diff(before)


def bytes_of(column: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls; to_pylist() takes ten times as long."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def by_bytes(raws: list[bytes], most: int = 1 << 20):
    """Runs of texts of about `most` bytes, so that a batch of long ones isn't split into words at once."""
    run, size = [], 0
    for r in raws:
        run.append(r)
        size += len(r)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


_ENCODERS: dict[str, Encoder] = {}


def write_ids(docs: DataFrame, path: str, vocabulary: str, end: int = END) -> None:
    """Write ORC files of SCHEMA in ascending doc_id order, each document closed by `end`."""
    small_batches(docs.sparkSession)

    def work(batches):
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(vocabulary)
        encoder, part, start = _ENCODERS[vocabulary], TaskContext.get().partitionId(), 0
        for batch in batches:
            made = [encoder.encode(run, end) for run in by_bytes(batch.column("text").cast(pa.binary()).to_pylist(), RUN)]
            sizes = np.concatenate([np.zeros(0, np.int64), *(x for _, x in made)])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x, _ in made)]))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + ends[:-1]), pa.array(sizes), lists],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    rows = docs.select("doc_id", text_of().alias("text"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    made = ranged.select("doc_id", "text").mapInArrow(work, SCHEMA)
    made.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option(
        "orc.stripe.size", str(STRIPE)
    ).option("orc.row.index.stride", str(ROWS)).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); a filter on doc_id reaches the stripes' statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row per range
    before = [0, *accumulate(n for _, n in sums)]
    table = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, before)] or [(0, 0)], "part int, before long")
    return rows.join(F.broadcast(table), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs' ids, read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    import public_tokenizers

    spark = docs.sparkSession
    path = new_path(spark, "ids")
    write_ids(docs, path, vocabulary or public_tokenizers.path(VOCABULARY))
    return read_ids(spark, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
