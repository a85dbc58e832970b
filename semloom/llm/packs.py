"""Texts packed into groups of bounded size, so that what a corpus knows of their words comes back once a group, not once a word.

A table of texts is written as packs: rows of (group, pack), a pack being some texts as a compressed Arrow batch. A group is a run of packs of one task and of
GROUP bytes of text at most (or one longer text). Operators note the distinct words of each group, look them up in the whole corpus by
a join, and meet them again with the group's packs in one sorted stream.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import new_path, small_batches

PACK = 1 << 18
GROUP = 1 << 25
#: Between a visible character (Unicode's white space set apart) and a space, line end or tab: a place no token of the vocabularies spans.
CUT = re.compile(
    rb"(?=[ \n\t])(?<=[^\x00-\x20\x7f])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)"
)

ODD = bytes([*range(10), *range(11, 32), 127])  # tabs and controls
ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

ODD_END = re.compile(rb"(?:" + ODD_SPACE.pattern + rb")\Z")


def pieces_of(raw: bytes) -> list[bytes]:
    """The text cut where no token of the vocabularies runs on: words with the white space before them; nothing for an empty text."""
    if not raw:
        return []
    if b"  " in raw or b"\n\n" in raw or b" \n" in raw or b"\n " in raw or len(raw.translate(None, ODD)) < len(raw) or (not raw.isascii() and ODD_SPACE.search(raw)):
        return CUT.split(raw)
    out = raw.replace(b" ", b"\0 ").replace(b"\n", b"\0\n").split(b"\0")  # one space or line end behind each word: the same cuts
    return out if out[0] else out[1:]


def packed(rows: DataFrame, name: str) -> DataFrame:
    """rows (with a column text) as a written table (gid, pack)."""
    small_batches(rows.sparkSession)

    def work(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        group, used = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("text").cast(pa.binary())).to_pylist()
            start = size = 0
            made = []
            for i, n in enumerate([*sizes, None]):
                if i > start and (n is None or size + n > PACK):
                    if used and used + size > GROUP:
                        group, used = group + 1, 0
                    used += size
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                        out.write_batch(batch.slice(start, i - start))
                    made.append((group, sink.getvalue().to_pybytes()))
                    start, size = i, 0
                size += n or 0
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in made], pa.int64()), pa.array([p for _, p in made], pa.binary())], ["gid", "pack"])

    path = new_path(rows.sparkSession, name)
    rows.mapInArrow(work, "gid long, pack binary").write.option("compression", "uncompressed").parquet(path)
    return rows.sparkSession.read.schema("gid long, pack binary").parquet(path)


def bucketed(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """rows, written in so many buckets of a key: one shuffle, after which groups and joins on the key need none on this side."""
    spark, name = rows.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    to = rows.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", new_path(spark, name))
    to.saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved, so that the catalog's entry can go; the files stay
    spark.sql(f"drop table {name}")
    return out


def unpacked(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all()


def beside_facts(packs: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts (gid, ...) of each group and then its packs, group by group in each partition; pack is null in facts."""
    names = [c for c in facts.columns if c != "gid"]
    both = facts.withColumn("pack", F.lit(None).cast("binary")).unionByName(packs, allowMissingColumns=True)
    both = both.select("gid", F.col("pack").isNotNull().alias("last"), *names, "pack")
    return both.repartition("gid").sortWithinPartitions("gid", "last")


def by_group(batches, facts: list[str]):
    """(gid, facts as Arrow arrays, packs as bytes) from a stream of beside_facts; packs come in runs, the facts with each run."""
    gid, held, arrays, packs = None, [], None, []

    def known():
        nonlocal arrays
        if arrays is None:
            arrays = pa.Table.from_batches(held).combine_chunks() if held else None
        return arrays

    for batch in batches:
        ids = batch.column("gid").to_numpy()
        last = batch.column("last").to_numpy(zero_copy_only=False)
        at = 0
        while at < len(ids):
            to = at
            same = (ids[at:] == ids[at]) & (last[at:] == last[at])
            to = at + (len(same) if same.all() else int(same.argmin()))
            if ids[at] != gid:
                if packs:
                    yield gid, known(), packs
                gid, held, arrays, packs = ids[at], [], None, []
            part = batch.slice(at, to - at)
            if last[at]:
                packs += part.column("pack").to_pylist()
            else:
                held.append(part.select(facts))
            at = to
        if packs:  # don't hold more than a batch of packs
            yield gid, known(), packs
            packs = []
