"""Communities of most modularity on several levels: local moves in passes over the graph's edges, then contraction of the graph, repeated.

The edges stay in a table dealt by node. What a pass needs of each node (its label, the weight of each community) is sent to the tasks, which send back the nodes that
move; so the driver holds some 50 bytes a node, and a round is one job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.operators.staging import kept

#: A level's rounds at most; rounds without a gain after which a level ends; gain of modularity that counts.
ROUNDS = 40
PATIENCE = 3
GAIN = 1e-7


class _Nodes:
    """A level's nodes in order of their ids: ids, k (sums of weights), bits (bit t: whether the node may move in turns 2t and 2t + 1)."""

    def __init__(self, both: DataFrame):
        half = lambda t: F.when(F.pmod(F.xxhash64("id", F.lit(t)), F.lit(2)) == 0, F.lit(1 << t)).otherwise(F.lit(0))
        bits = sum((half(t) for t in range(ROUNDS // 2)), F.lit(0)).cast("long")
        got = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")).select("id", "k", bits.alias("bits")).toArrow()  # a row a node
        order = np.argsort(got["id"].to_numpy(), kind="stable")
        self.ids, self.k, self.bits = (got[c].to_numpy()[order] for c in ("id", "k", "bits"))


def _packed(both: DataFrame, ids: np.ndarray) -> DataFrame:
    """(src, dst, w): edges but loops, a row for each task with all edges of its nodes in order of src, as the bytes of places in ids and weights."""
    sent = both.sparkSession.sparkContext.broadcast(ids)

    def work(batches):
        got = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "weight")] for b in batches]
        if got:
            src, dst, w = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((dst, src))
            src, dst = (np.searchsorted(sent.value, x[order]) for x in (src, dst))
            yield pa.RecordBatch.from_pydict({"src": [src.tobytes()], "dst": [dst.tobytes()], "w": [w[order].tobytes()]})

    return kept(both.where("src <> dst").repartition("src").mapInArrow(work, "src binary, dst binary, w binary"))


def _pass(packs: DataFrame, label: np.ndarray, nodes: _Nodes, two_m: float, turn: int) -> tuple[float, np.ndarray]:
    """(weight of the edges but loops inside the communities of label, label after the moves of the turn).

    A half of the nodes, by a hash of id and turn, go to the neighbouring community of most gain, ties to the least label, if it gains. Two nodes that swap places leave
    each other's community in no half at once: a node moves only to a smaller label than its own in even turns, to a larger one in odd ones.
    """
    total = np.bincount(label, nodes.k, len(label))
    may = (nodes.bits >> (turn // 2)) & 1 == 1
    sent = packs.sparkSession.sparkContext.broadcast((label, total, nodes.k, may))

    def work(batches):
        label, total, k, may = sent.value
        inside, moved = 0.0, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("src", "dst", "w"))):
                src, dst, w = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int64, np.int64, np.float64)))
                inside += w[label[src] == label[dst]].sum()
                use = may[src]
                src, to, w = src[use], label[dst[use]], w[use]
                if not len(src):
                    continue
                order = np.lexsort((to, src))
                src, to, w = src[order], to[order], w[order]
                first = np.flatnonzero(np.r_[True, (np.diff(src) != 0) | (np.diff(to) != 0)])
                w, src, to = np.add.reduceat(w, first), src[first], to[first]
                own = label[src]
                gain = w - k[src] * (total[to] - np.where(to == own, k[src], 0.0)) / two_m
                at = np.flatnonzero(np.r_[True, np.diff(src) != 0])
                node = src[at]
                now = np.maximum.reduceat(np.where(to == own, gain, -np.inf), at)
                now = np.where(np.isinf(now), -k[node] * (total[label[node]] - k[node]) / two_m, now)
                side = to < own if turn % 2 == 0 else to > own
                gain = np.where(side, gain, -np.inf)
                best = np.lexsort((to, -gain, src))[at]
                better = gain[best] > now + GAIN
                moved.append((node[better], to[best][better]))
        of = [np.concatenate([m[i] for m in moved]) if moved else np.zeros(0, np.int64) for i in (0, 1)]
        yield pa.RecordBatch.from_pydict({"inside": [float(inside)], "node": [of[0].tobytes()], "to": [of[1].tobytes()]})

    new, inside = label.copy(), 0.0
    for r in packs.mapInArrow(work, "inside double, node binary, to binary").collect():  # the nodes that move
        inside += r["inside"]
        new[np.frombuffer(r["node"], np.int64)] = np.frombuffer(r["to"], np.int64)
    sent.unpersist()
    return inside, new


def _level(both: DataFrame, nodes: _Nodes, two_m: float) -> tuple[np.ndarray, float, float]:
    """(labels, places of nodes; their modularity, that of each node alone) after rounds of moves; a round that loses is not kept."""
    packs = _packed(both, nodes.ids)
    loops = both.where("src = dst").agg(F.sum("weight").alias("w")).first()["w"] or 0.0
    value = lambda label, inside: (inside + loops) / two_m - (np.bincount(label, nodes.k) ** 2).sum() / two_m**2
    best = label = np.arange(len(nodes.ids))
    inside, new = _pass(packs, label, nodes, two_m, 0)
    start = most = value(label, inside)
    idle = 0
    for turn in range(ROUNDS):
        if (new == best).all():
            idle += 1
            if idle >= 2 * PATIENCE or turn + 1 == ROUNDS:
                break
            _, new = _pass(packs, best, nodes, two_m, turn + 1)
            continue
        label = new
        inside, new = _pass(packs, label, nodes, two_m, min(turn + 1, ROUNDS - 1))
        now = value(label, inside)
        if now > most + GAIN:
            best, most, idle = label, now, 0
        else:
            idle += 1
            if idle >= 2 * PATIENCE or turn + 1 == ROUNDS:
                break
            _, new = _pass(packs, best, nodes, two_m, turn + 1)
    return best, float(most), float(start)


def _named(rows: DataFrame, columns: list[str], ids: np.ndarray, names: np.ndarray, schema: str) -> DataFrame:
    """rows with names in place of the ids in these columns."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, names))

    def work(batches):
        ids, names = sent.value
        for batch in batches:
            held = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict(held | {c: pa.array(names[np.searchsorted(ids, held[c].to_numpy(zero_copy_only=False))]) for c in columns})

    return rows.mapInArrow(work, schema)


def louvain(edges: DataFrame, levels: int = 20) -> tuple[DataFrame, list[float]]:
    """(communities (id, cluster), modularity after each level) of undirected edges (src, dst, weight > 0); ids by size, then by the least member.

    Every level's modularity is larger than the last one's; levels end when moves gain no more. Repeated edges add up, loops count. The nodes of a level's graph
    are the last level's communities. No edges give no rows.
    """
    one = kept(edges.groupBy(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).agg(F.sum("weight").cast("double").alias("weight")))  # read three times
    loops = one.where("src = dst").withColumn("weight", 2 * F.col("weight"))
    apart = one.where("src <> dst")
    both = kept(apart.union(apart.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).union(loops))
    two_m = both.agg(F.sum("weight").alias("w")).first()["w"]
    if not two_m:
        return edges.select(F.col("src").alias("id"), F.lit(0).cast("long").alias("cluster")).limit(0), []
    every, found, risen = both.select(F.col("src").alias("id")).distinct(), None, []
    for _ in range(levels):
        nodes = _Nodes(both)
        label, most, start = _level(both, nodes, two_m)
        label = nodes.ids[label]
        if found is None:
            ids, found, risen = nodes.ids, label, [most]
        elif most > start + GAIN:
            found = label[np.searchsorted(nodes.ids, found)]
            risen.append(most)
        else:
            break
        named = _named(both, ["src", "dst"], nodes.ids, label, "src long, dst long, weight double")
        both = kept(named.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    _, first, of, n = np.unique(found, return_index=True, return_inverse=True, return_counts=True)  # first: ids are in order
    place = np.empty(len(n), np.int64)
    place[np.lexsort((first, -n))] = np.arange(len(n))
    return _named(every.withColumn("cluster", F.col("id")), ["cluster"], ids, place[of], "id long, cluster long"), risen
