"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns VNODES points of a 32-bit ring. A key hashes to a position and belongs to the
first point clockwise; keys arrive in the order of a second hash (of the key and the text's checksum, so the rows of a hot key are dealt to all
slices), slice by slice and within a slice arc by arc, and a key whose shard is
full goes on clockwise to the next shard with room. Which keys overflow depends on counts alone, so the
plan is made from a histogram of bounded size (ring arcs x arrival slices, whatever the number
of rows), and a slice that overflows is cut at an exact rank: loads hold to the row.

With bound=None the capacities are exact: row counts of any two shards differ by at most one.
With bound=0.05 no shard holds over 1.05 times the mean, and fewer keys leave home.

Null doc_id is a key like any other. Null text has size 8 and the checksum of ''. Repeated rows
are dealt one by one (ties by checksum; equal rows are interchangeable). Columns named shard, slot or home are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semloom.llm.common import text_of

VNODES = 32
SLICES = 64
RING = 1 << 32


def ring(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """Positions of all virtual nodes in ring order, and the shard of each. A shard's points don't depend on the number of shards."""
    points = sorted((xxhash.xxh32_intdigest(f"{s}/{v}"), s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in points], [s for _, s in points]


def capacities(total: int, shards: int, bound: float | None) -> list[int]:
    if bound is None:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [math.ceil(total / shards * (1 + bound))] * shards


def plan(counts: dict[tuple[int, int], int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, slice, first rank, shard, first slot) for each piece, filling shards in arrival order.

    counts: rows by (slice, arc). Each piece of a slice goes to the first shard clockwise with room.
    """
    room, used, out = list(room), [0] * len(room), []
    for (part, arc), n in sorted(counts.items()):
        rank, at = 0, arc
        while n > 0:
            s = owners[at % len(owners)]
            if took := min(n, room[s]):
                out.append((arc, part, rank, s, used[s]))
                used[s] += took
                room[s] -= took
                rank += took
                n -= took
            at += 1
    return out


def shard_rows(docs: DataFrame, shards: int = 24, bound: float | None = None, vnodes: int = VNODES) -> DataFrame:
    """docs with columns shard (int), slot (long, gapless from 0 in each shard) and home (int: the shard without bounds)."""
    spark = docs.sparkSession
    at, owners = ring(shards, vnodes)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    where = F.pmod(F.xxhash64(key, F.lit("place")), F.lit(RING))
    arc = _search(at, F.col("_at"))
    keyed = docs.withColumn("_at", where).withColumn("_come", F.xxhash64(key, *[F.col(c) for c in ("text_crc32",) if c in docs.columns], F.lit("arrival")))
    keyed = keyed.withColumn("_arc", arc).withColumn("_slice", F.pmod(F.col("_come"), F.lit(SLICES)).cast("int"))
    seen = keyed.groupBy("_slice", "_arc").count().collect()  # at most SLICES x shards x vnodes rows
    counts = {(r["_slice"], r["_arc"]): r["count"] for r in seen}
    pieces = plan(counts, owners, capacities(sum(counts.values()), shards, bound))
    table = spark.createDataFrame(
        pieces or [(0, 0, 0, 0, 0)], "_arc int, _slice int, _rank long, shard int, _slot long"
    )
    table = table.groupBy("_arc", "_slice").agg(F.array_sort(F.collect_list(F.struct("_rank", "shard", "_slot"))).alias("_to"))
    order = Window.partitionBy("_arc", "_slice").orderBy("_come", "doc_id", *[c for c in ("text_crc32",) if c in docs.columns])
    ranked = keyed.withColumn("_n", F.row_number().over(order).cast("long") - 1)
    dealt = ranked.join(F.broadcast(table), ["_arc", "_slice"])  # bounded like the histogram
    to = F.element_at(F.filter("_to", lambda x: x["_rank"] <= F.col("_n")), -1)
    home = F.get(_numbers(owners, "int"), F.col("_arc"))
    return dealt.withColumn("_to", to).select(
        *[c for c in docs.columns if c not in ("shard", "slot", "home")],
        F.col("_to.shard").alias("shard"),
        (F.col("_to._slot") + F.col("_n") - F.col("_to._rank")).alias("slot"),
        home.cast("int").alias("home"),
    )


def _numbers(values: list[int], kind: str):
    """An array column of these numbers. Spark folds it to one literal; an expression for each number makes plans of tens of thousands of characters and a large heap on the driver."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _search(at: list[int], col):
    """The index of the first of the sorted points that is >= col, found by halving; past the last one it wraps to the first."""
    points = _numbers(at, "bigint")
    strides = _numbers([1 << k for k in reversed(range(len(at).bit_length()))], "int")
    below = F.aggregate(strides, F.lit(0), lambda n, s: F.when(F.get(points, n + s - 1) < col, n + s).otherwise(n))  # no point: null, which isn't below
    return F.pmod(below, F.lit(len(at)))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32): what sharding needs of a row, so that texts aren't shuffled."""
    return docs.select(
        "doc_id",
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )


def op1(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Law `rows`: counts of two shards differ by at most one."""
    return shard_rows(sizes(docs), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home"
    )
