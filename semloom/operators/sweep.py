"""Many k-means models in one pass over the rows, their metrics, and the number of clusters to take."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.functions.vectors import doubles, unit
from semloom.operators.staging import kept

STILL = 1e-7
#: Rounds without a lower cost after which a model that still moves is an error; rows of a pack; tasks of a pass, at least, to which larger tables are cut.
STUCK, PACK, TASKS = 100, 2048, 64
#: Fixed values of the notes and the score.
BROAD_SIZE, BROAD_LARGEST, FRAGMENTED, WEAK, FINE, IDEAL, LARGEST, TINY = 25, 60, 0.2, 0.4, 8, 14, 40, 5


def parse_ks(ks: Iterable[int] | str) -> list[int]:
    """Numbers of clusters, each once and in order; all must be 2 or more."""
    out = sorted({int(k) for k in (ks.split(",") if isinstance(ks, str) else ks) if str(k).strip()})
    if not out or out[0] < 2:
        raise ValueError("give at least one number of clusters, each 2 or more")
    return out


class Sweep:
    """centers: {k: matrix}; rounds: {k: passes until its centers stood still}; members: kept rows (id, u); clusters: (k, cluster, n, coherence), larger clusters first."""

    def __init__(self, members: DataFrame, centers: dict[int, np.ndarray], rounds: dict[int, int], clusters: DataFrame, ids: dict[int, np.ndarray]):
        self.members, self.centers, self.rounds, self.clusters, self.ids = members, centers, rounds, clusters, ids

    def assignments(self) -> DataFrame:
        """(k, id, cluster): a row for each row and model."""
        sent = self.members.sparkSession.sparkContext.broadcast((self.centers, self.ids))

        def work(batches):
            centers, ids = sent.value
            for pdf in batches:
                x = _matrix(pdf["u"])
                for k, c in centers.items():
                    yield pd.DataFrame({"k": k, "id": pdf["id"].to_numpy(), "cluster": ids[k][_nearest(x, c)[0]]})

        return self.members.mapInPandas(work, "k int, id long, cluster long")


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, c: np.ndarray, square: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    d = ((x**2).sum(1) if square is None else square)[:, None] - 2 * x @ c.T + (c**2).sum(1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def _packed(members: DataFrame) -> DataFrame:
    """(ids, u): members in packs of up to PACK rows, as the bytes of their numbers, which a pass reads without making rows of them."""

    def work(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            x = batch.column("u").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            at = range(0, len(ids), PACK)
            yield pa.RecordBatch.from_pydict({"ids": [ids[i : i + PACK].tobytes() for i in at], "u": [x[i : i + PACK].tobytes() for i in at]})

    packs = kept(members.mapInArrow(work, "ids binary, u binary"))
    return packs.coalesce(max(TASKS, packs.sparkSession.sparkContext.defaultParallelism))


def _partial(packs: DataFrame, centers: dict[int, np.ndarray], of, add) -> dict[int, dict]:
    """{k: {name: value}}: of(x, ids, at, d, k) of each pack and model, added up by add(a, b) in each task and then here; a task sends the numbers of the models' centers at most."""
    sent = packs.sparkSession.sparkContext.broadcast(centers)

    def work(batches):
        held: dict[int, dict] = {}
        for batch in batches:
            for ids, u in zip(batch.column("ids"), batch.column("u")):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                x = np.frombuffer(u.as_buffer(), np.float64).reshape(len(ids), -1)
                square = (x**2).sum(1)
                for k, c in sent.value.items():
                    got = of(x, ids, *_nearest(x, c, square), len(c))
                    held[k] = add(held[k], got) if k in held else got
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(held), pa.int32()), "held": [pickle.dumps(v) for v in held.values()]})

    out: dict[int, dict] = {}
    for r in packs.mapInArrow(work, "k int, held binary").collect():  # a row for each task and model
        got = pickle.loads(r["held"])
        out[r["k"]] = add(out[r["k"]], got) if r["k"] in out else got
    sent.unpersist()
    return out


def _sums(x, ids, at, d, k) -> dict:
    """n and the sum of each cluster's rows, and the cost of all."""
    own = np.zeros((k, len(x)))
    own[at, np.arange(len(x))] = 1
    return {"n": np.bincount(at, minlength=k), "s": own @ x, "cost": np.maximum(d, 0).sum()}


def _last(x, ids, at, d, k) -> dict:
    """_sums, and the squares of each cluster's rows and its least id."""
    first = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(first, at, ids)
    return _sums(x, ids, at, d, k) | {"q": np.bincount(at, (x**2).sum(1), k), "first": first}


def _far(x, ids, at, d, k) -> dict:
    """Each cluster's row farthest from its center, ties to the least id: {cluster: (-distance, id, row)}."""
    order = np.lexsort((ids, -d, at))
    one = order[np.r_[True, np.diff(at[order]) > 0]]
    return {int(at[i]): (-d[i], ids[i], x[i].copy()) for i in one}


def _added(a: dict, b: dict) -> dict:
    return {c: np.minimum(a[c], b[c]) if c == "first" else a[c] + b[c] for c in a}


def _farther(a: dict, b: dict) -> dict:
    return a | {c: v for c, v in b.items() if c not in a or v[:2] < a[c][:2]}


def fit(vectors: DataFrame, ks: Iterable[int] | str, seed: int = 42, rounds: int | None = None) -> Sweep:
    """k-means of vectors (id, embedding) on the unit sphere for all ks at once.

    Starts are the different vectors of least hash, the same for all ks, so a model is the same whichever others are fitted beside it. A round is one pass
    over the rows for all models that still move; it lowers a model's cost, so that all come to rest, in more rounds the more rows there are. A cluster that loses its rows
    begins anew at the row farthest from its center. Models still moving after `rounds` passes (where given), or whose cost has not fallen in STUCK passes, are an error.
    ks beyond the different vectors are cut to their number; null vectors are left out; no rows give no clusters.
    """
    ks = parse_ks(ks)
    members = kept(vectors.where("embedding is not null").select("id", unit(doubles("embedding")).alias("u")))
    starts = members.groupBy("u").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(ks)).select("u").collect()  # max(ks) rows
    first = np.array([r["u"] for r in starts], np.float64)
    spark = members.sparkSession
    if not len(first):
        return Sweep(members, {}, {}, spark.createDataFrame([], "k int, cluster long, n long, coherence double"), {})
    packs = _packed(members)
    centers = {k: first[:k].copy() for k in ks}
    moving, took, least = list(ks), {}, {k: (np.inf, 0) for k in ks}
    turn = 0
    while moving:
        turn += 1
        stuck = [k for k in moving if turn - least[k][1] > STUCK]
        if stuck or rounds is not None and turn > rounds + 1:
            raise RuntimeError(f"the models of {stuck or moving} still move after {turn - 1} rounds")
        got = _partial(packs, {k: centers[k] for k in moving}, _sums, _added)
        bare = [k for k in moving if not got[k]["n"].all()]
        far = _partial(packs, {k: centers[k] for k in bare}, _far, _farther) if bare else {}
        for k in list(moving):
            n, s = got[k]["n"], got[k]["s"]
            if got[k]["cost"] < least[k][0]:
                least[k] = got[k]["cost"], turn
            new = np.divide(s, n[:, None], out=np.full_like(s, np.nan), where=n[:, None] > 0)
            farthest = sorted(far.get(k, {}).items(), key=lambda r: (r[1][0], r[0]))
            for c, (_, (_, _, row)) in zip(np.flatnonzero(n == 0), farthest):
                new[c] = row
            if np.abs(new - centers[k]).max() < STILL:
                moving.remove(k)
                took[k] = turn
            else:
                centers[k] = new
    last = _partial(packs, centers, _last, _added)
    rows, ids = [], {}
    for k in ks:
        n, s, q, least_id = (last[k][c] for c in ("n", "s", "q", "first"))
        ids[k] = np.full(len(centers[k]), -1, np.int64)
        for place, c in enumerate(sorted(np.flatnonzero(n), key=lambda c: (-n[c], least_id[c]))):
            ids[k][c] = place
            pairs = int(n[c]) * (int(n[c]) - 1)
            rows.append((k, place, int(n[c]), float((s[c] @ s[c] - q[c]) / pairs) if pairs else None))
    return Sweep(members, centers, took, spark.createDataFrame(rows, "k int, cluster long, n long, coherence double"), ids)


def metrics(clusters: DataFrame) -> DataFrame:
    """A row for each k of (k, cluster, n, coherence): clusters, entities, sizes, coherence, tiny clusters, a note, the score, and whether it is the one to take (the largest score, then k)."""
    m = clusters.groupBy("k").agg(
        F.count("*").alias("clusters"), F.sum("n").alias("entities"), F.avg("n").alias("average_size"), F.max("n").alias("largest"), F.min("n").alias("smallest"),
        F.avg("coherence").alias("coherence"), F.min("coherence").alias("coherence_min"), F.max("coherence").alias("coherence_max"), F.count_if(F.col("n") < TINY).alias("tiny"),
    )
    share = F.col("tiny") / F.col("clusters")
    note = (
        F.when((F.col("average_size") > BROAD_SIZE) | (F.col("largest") > BROAD_LARGEST), "too broad")
        .when(share > FRAGMENTED, "too fragmented")
        .when(F.col("coherence") < WEAK, "weak coherence")
        .when(F.col("average_size") < FINE, "fine-grained")
        .otherwise("promising")
    )
    score = F.coalesce("coherence", F.lit(0.0)) - F.abs(F.col("average_size") - IDEAL) / IDEAL - F.greatest(F.lit(0), F.col("largest") - LARGEST) / LARGEST - share * 2
    m = m.withColumn("note", note).withColumn("score", score)
    best = m.agg(F.max(F.struct("score", "k"))["k"].alias("best"))
    return m.crossJoin(F.broadcast(best)).withColumn("recommended", F.col("k") == F.col("best")).drop("best")  # one row


def samples(clusters: DataFrame, assignments: DataFrame, vectors: DataFrame, show: int = 6, each: int = 6) -> DataFrame:
    """(k, cluster, n, coherence, ids): of each k the `show` largest clusters with the members nearest to their mean, nearest first."""
    from semloom.operators.clusters import representatives

    shown = clusters.where(F.col("cluster") < show)
    key = F.struct("k", "cluster")
    rows = assignments.join(shown.select("k", "cluster"), ["k", "cluster"]).join(vectors.select("id", "embedding"), "id").select("id", key.alias("cluster"), "embedding")
    ids = representatives(rows, each).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("m"))
    ids = ids.select("cluster.k", "cluster.cluster", F.transform("m", lambda s: s["id"]).alias("ids"))
    return shown.join(ids, ["k", "cluster"], "left")
