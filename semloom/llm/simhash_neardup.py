"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints (64 bits, over repeated 4-word shingles) are made in Arrow batches; equal ones
fold to one row. Distinct fingerprints are dealt to upper nodes (masked bit patterns, see
hamming.py). In a node they are sorted by Gray rank and grouped; each group keeps the bits that
its members share, groups of groups the bits those share; pairs of groups are dropped once the
differences accumulated on shared bits exceed the limit. What is left is compared bit by bit.
A node emits links to one member of each local component, never all pairs.

Null text counts as empty: fingerprint 0. Rows with equal doc_id each keep their row. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import connected_components, small_batches, text_of, written
from semloom.llm.hamming import gray_rank, node_rows

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
GROUP = 32  # members of a leaf, leaves of an upper group
SMALL = 32  # nodes up to this size are compared at once, lag by lag
#: Shared fingerprints up to which they are broadcast (16 bytes each); beyond, Spark shuffles, and AQE splits a hot one.
BROADCAST_ROWS = 1_000_000
HOT = 20_000  # values of a node before it is split over its free bits


def fingerprint(text: str, n: int = 4) -> int:
    """Bit i is 1 if set in over half the XXH64 of the text's n-word shingles; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < n:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row."""
    small_batches(docs.sparkSession)

    def work(batches):
        for pdf in batches:
            yield pdf[["doc_id"]].assign(fp=np.array([fingerprint(t) for t in pdf["text"]], np.int64))

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(work, "doc_id long, fp long")


def _shared(lo, hi):
    """Bits on which all members agree, and their value, from the and and the or of the members."""
    same = ~(lo ^ hi)
    return same, lo & same


def node_links(f: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) positions that link f's values (uint64, in Gray order) into their components under distance <= k."""
    n = len(f)
    pad = -n % (GROUP * GROUP)
    full = np.concatenate([f, np.repeat(f[-1:], pad)])
    leaf = full.reshape(-1, GROUP)
    lo, hi = np.bitwise_and.reduce(leaf, 1), np.bitwise_or.reduce(leaf, 1)
    leaf_mask, leaf_bits = _shared(lo, hi)
    up_mask, up_bits = _shared(
        np.bitwise_and.reduce(lo.reshape(-1, GROUP), 1), np.bitwise_or.reduce(hi.reshape(-1, GROUP), 1)
    )
    label = np.arange(len(full))
    label[n:] = n - 1
    for u in range(len(up_mask)):
        both = up_mask[u] & up_mask[u:]
        near = np.flatnonzero(np.bitwise_count((up_bits[u] ^ up_bits[u:]) & both) <= k) + u
        for v in near:
            shared = up_mask[u] & up_mask[v]
            begun = int(np.bitwise_count((up_bits[u] ^ up_bits[v]) & shared))
            a, b = slice(u * GROUP, (u + 1) * GROUP), slice(v * GROUP, (v + 1) * GROUP)
            pair = leaf_mask[a][:, None] & leaf_mask[b][None, :]
            gone = begun + np.bitwise_count((leaf_bits[a][:, None] ^ leaf_bits[b][None, :]) & pair & ~shared)
            for i, j in zip(*np.nonzero(gone <= k)):
                p, q = u * GROUP + i, v * GROUP + j
                if p > q or p * GROUP >= n or q * GROUP >= n:
                    continue
                li, lj = label[p * GROUP : (p + 1) * GROUP], label[q * GROUP : (q + 1) * GROUP]
                if li.min() == li.max() == lj.min() == lj.max():
                    continue
                rest = ~pair[i, j]
                d = gone[i, j] + np.bitwise_count((leaf[p][:, None] ^ leaf[q][None, :]) & rest)
                x, y = np.nonzero(d <= k)
                for s, t in {*zip(li[x].tolist(), lj[y].tolist())}:
                    s, t = int(label[s]), int(label[t])
                    while label[s] != s:
                        s = int(label[s])
                    while label[t] != t:
                        t = int(label[t])
                    if s != t:
                        label[max(s, t)] = min(s, t)
                for block in (p, q):  # flatten what this pair of leaves has joined
                    part = label[block * GROUP : (block + 1) * GROUP]
                    while (part != label[part]).any():
                        part = label[part]
                    label[block * GROUP : (block + 1) * GROUP] = part
    while (label != label[label]).any():
        label = label[label]
    member = np.flatnonzero(label[:n] != np.arange(n))
    return member, label[member]


def _links(k: int):
    def work(batches):
        import pyarrow as pa

        def close(mask, part, fp):
            """Links of whole nodes, sorted by (mask, part, Gray rank)."""
            start = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])])
            size = np.diff(np.r_[start, len(fp)])
            node = np.repeat(np.arange(len(start)), size)
            few = np.repeat(size <= SMALL, size)
            a, b = [], []
            small, of = fp[few], node[few]
            for lag in range(1, int(size[size <= SMALL].max(initial=1))):
                ok = (of[lag:] == of[:-lag]) & (np.bitwise_count(small[lag:] ^ small[:-lag]) <= k)
                a.append(small[:-lag][ok])
                b.append(small[lag:][ok])
            for s, z in zip(start[size > SMALL], size[size > SMALL]):
                x, y = node_links(fp[s : s + z], k)
                a.append(fp[s : s + z][x])
                b.append(fp[s : s + z][y])
            a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple] = []  # parts of the last node, which the next batch may continue
        for batch in batches:
            mask, part, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "part", "fp"))
            if not len(fp):
                continue
            fp = fp.view(np.uint64)
            last = (mask != mask[-1]) | (part != part[-1])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if held and (cut or (held[-1][0][-1], held[-1][1][-1]) != (mask[-1], part[-1])):
                whole = [np.concatenate([*(h[i] for h in held), x[:cut]]) for i, x in enumerate((mask, part, fp))]
                held = []
                yield close(*whole)
            elif cut:
                yield close(mask[:cut], part[:cut], fp[:cut])
            held.append((mask[cut:], part[cut:], fp[cut:]))
        if held:
            yield close(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    return work


def links(values: DataFrame, k: int = 4, blocks: int = 6, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct values of `fp` that join all that lie within k differing bits."""
    rows = node_rows(values.select("fp"), blocks, k, hot)
    rows = rows.repartition("mask", "part").select("mask", "part", "fp", gray_rank(F.col("fp")).alias("rank"))
    rows = rows.sortWithinPartitions("mask", "part", "rank").drop("rank")
    return rows.mapInArrow(_links(k), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    fps = written(fingerprints(docs), "fps")
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first")
    found = written(connected_components(links(first, k)), "found")
    least = (
        found.join(first, found.node == first.fp).groupBy("root").agg(F.min("first").alias("component_id"))
    )
    joined = found.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    shared = first.join(joined, "fp", "left").where("n > 1 or component_id is not null")  # fingerprints that aren't alone
    shared = written(shared.select("fp", F.coalesce("component_id", "first").alias("component_id")), "shared")
    few = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    return fps.join(few, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
