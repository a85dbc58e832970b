"""Inverted-file index for cosine neighbours: cells of k-means, a few cells probed for each query, candidates ranked exactly.

Vectors are dealt to the cells of their nearest centers. A query looks into the cells whose centers are nearest; their members, in packs of bounded
size, meet the cell's queries as matrix products. With about sqrt(n) cells the pairs grow as n^1.5 times the probes, not as n^2.

The exact form then looks into all further cells that could still hold a better neighbour: by the triangle inequality of angles, a member of a cell
is no nearer to the query than the center's angle less the cell's radius. Its rows are those of the exact all-pairs operator.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semloom.functions.vectors import doubles, unit
from semloom.operators.staging import kept, kept_in_batches

#: Rows that the centers are fitted on, at most: the first by a hash of the id. All rows are indexed.
FIT = 200_000
#: Centers at most, so that they can be broadcast.
CELLS = 16_384
PACK = 1024
#: Rows of a query and a cell that Python yields at a time; pairs of packs that it gets at a time.
ASKED, PAIRS = 20_000, 8
EDGE = 1e-9


class Index:
    """centers (a matrix), members (id, cell, embedding as unit vectors), radius of each cell (largest angle of a member to its center)."""

    def __init__(self, centers: np.ndarray, members: DataFrame, radius: np.ndarray):
        self.centers, self.members, self.radius = centers, members, radius


def build(vectors: DataFrame, cells: int | None = None, seed: int = 42, rounds: int = 20) -> Index:
    """Index of vectors (id, embedding). Null vectors are left out; a zero vector has similarity 0 to all and lies in some cell. cells: sqrt(n) if not given."""
    rows = kept(vectors.where("embedding is not null").select("id", unit(doubles("embedding")).alias("embedding")))
    n = rows.count()
    cells = max(1, min(cells or round(math.sqrt(n)), CELLS, n))
    if n == 0:
        return Index(np.zeros((0, 0)), rows.withColumn("cell", F.lit(0)), np.zeros(0))
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT) if n > FIT else rows
    model = KMeans(k=cells, seed=seed, maxIter=rounds, initSteps=1).fit(sample.select(array_to_vector("embedding").alias("features")))
    centers = np.array(model.clusterCenters())
    length = np.linalg.norm(centers, axis=1, keepdims=True)
    centers = np.divide(centers, length, out=np.zeros_like(centers), where=length > 0)
    sent = rows.sparkSession.sparkContext.broadcast(centers)

    def work(batches):
        for pdf in batches:
            m = np.array(pdf["embedding"].tolist(), np.float64)
            sims = m @ sent.value.T
            cell = sims.argmax(1)
            yield pdf.assign(cell=cell.astype(np.int32), angle=np.arccos(np.clip(sims[np.arange(len(m)), cell], -1, 1)))

    placed = kept(rows.mapInPandas(work, "id long, embedding array<double>, cell int, angle double"))
    radius = np.zeros(len(centers))
    for r in placed.groupBy("cell").agg(F.max("angle").alias("angle")).collect():  # a row per cell
        radius[r["cell"]] = r["angle"]
    return Index(centers, placed.select("id", "cell", "embedding"), radius)


def _parts(batches, cells: int):
    """The rows of batches, so few at a time that each times its cells is ASKED at most."""
    step = max(1, ASKED // cells)
    for pdf in batches:
        for at in range(0, len(pdf), step):
            yield pdf.iloc[at : at + step]


def _packs(rows: DataFrame, names: list[str]) -> DataFrame:
    """(cell, rows): rows of a cell in packs of about PACK, dealt by a hash of the id, so a cell of any size is many packs."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    dealt = rows.join(sizes, "cell").withColumn("pack", F.pmod(F.xxhash64("id", F.lit("pack")), F.col("packs")))
    return dealt.groupBy("cell", "pack").agg(F.collect_list(F.struct(*names)).alias("rows")).drop("pack")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(src, nbr, sim): the k best of each query in each pair of packs (q, b)."""

    def work(batches):
        for pdf in batches:
            for q, b in zip(pdf["q"], pdf["b"]):
                src, ids = (np.array([r["id"] for r in rows], np.int64) for rows in (q, b))
                x, y = (np.array([r["embedding"] for r in rows], np.float64) for rows in (q, b))
                for at in range(0, len(src), 256):
                    part = src[at : at + 256]
                    sim = x[at : at + 256] @ y.T
                    sim[part[:, None] == ids] = -np.inf
                    keep = min(k, len(ids))
                    edge = -np.partition(-sim, keep - 1, axis=1)[:, keep - 1]
                    i, j = np.nonzero((sim >= edge[:, None]) & np.isfinite(sim))
                    order = np.lexsort((ids[j], -sim[i, j], i))
                    i, j = i[order], j[order]
                    first = np.searchsorted(i, np.arange(len(part)))
                    top = np.arange(len(i)) - first[i] < keep
                    yield pd.DataFrame({"src": part[i[top]], "nbr": ids[j[top]], "sim": sim[i[top], j[top]]})

    return pairs.select("q", "b").mapInPandas(work, "src long, nbr long, sim double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "nbr")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _probe(index: Index, queries: DataFrame, k: int, packs: DataFrame) -> DataFrame:
    """The k best of queries (id, cell, embedding) among the members of their cells."""
    asked = _packs(queries, ["id", "embedding"]).withColumnRenamed("rows", "q")
    found = _best(asked.join(packs.withColumnRenamed("rows", "b"), "cell"), k)
    return kept_in_batches(_ranked(found, k).drop("rank"), PAIRS)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """(src, nbr, sim, rank): the k most similar members of each query (id, embedding), itself aside, ties by id.

    Among the members of the `probes` cells nearest to the query; with exact, among all: in a second step those cells are probed that may
    hold a neighbour not worse than the k-th found. Ids of queries are taken to be unique; null vectors have no neighbours.
    """
    rows = queries.where("embedding is not null").select("id", unit(doubles("embedding")).alias("embedding"))
    if not len(index.centers):
        return rows.select(F.col("id").alias("src"), F.col("id").alias("nbr"), F.lit(0.0).alias("sim"), F.lit(1).alias("rank")).limit(0)
    sent = rows.sparkSession.sparkContext.broadcast((index.centers, index.radius))
    probes = min(probes, len(index.centers))

    def near(batches):
        for pdf in _parts(batches, probes):
            sims = np.array(pdf["embedding"].tolist(), np.float64) @ sent.value[0].T
            cells = np.argpartition(-sims, probes - 1, axis=1)[:, :probes]
            at = np.repeat(np.arange(len(pdf)), probes)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "embedding": pdf["embedding"].to_numpy()[at], "cell": cells.ravel().astype(np.int32)})

    asked = kept(rows.mapInPandas(near, "id long, embedding array<double>, cell int"))
    packs = kept(_packs(index.members, ["id", "embedding"]))
    found = _probe(index, asked, k, packs)
    if not exact:
        return _ranked(found, k)
    first = kept(_ranked(found, k))
    worst = first.groupBy("src").agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    seen = asked.groupBy("id").agg(F.collect_list("cell").alias("seen"))  # `probes` cells
    more = rows.join(seen, "id").join(worst, rows.id == worst.src, "left").select("id", "embedding", "seen", F.when(F.col("n") == k, F.col("least")).alias("least"))

    def further(batches):
        for pdf in _parts(batches, len(sent.value[0])):
            centers, radius = sent.value
            x = np.array(pdf["embedding"].tolist(), np.float64)
            angle = np.arccos(np.clip(x @ centers.T, -1, 1))
            bound = np.cos(np.maximum(0, angle - radius))  # no member of the cell is more similar
            bound[np.linalg.norm(x, axis=1) == 0] = 1
            least = pdf["least"].fillna(-2).to_numpy(np.float64)
            open_ = bound >= least[:, None] - EDGE
            open_[np.repeat(np.arange(len(pdf)), [len(s) for s in pdf["seen"]]), np.concatenate(pdf["seen"].to_list())] = False
            i, cell = np.nonzero(open_)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "embedding": pdf["embedding"].to_numpy()[i], "cell": cell.astype(np.int32)})

    rest = kept(more.mapInPandas(further, "id long, embedding array<double>, cell int"))
    return _ranked(first.select("src", "nbr", "sim").union(_probe(index, rest, k, packs)), k)


def tuned_probes(index: Index, k: int, target: float = 0.97, sample: int = 256, seed: int = 7) -> int:
    """Cells to probe for this recall: for `sample` members (the first by a hash), their exact neighbours are found among all members, and the cells
    of these ranked by nearness of their centers. Neighbours spread alike in all directions need most cells; grouped ones few."""
    some = kept(index.members.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("id", "embedding"))
    cells = index.members.select("cell").distinct()
    asked = some.crossJoin(F.broadcast(cells))  # `sample` rows, each for all of at most CELLS cells
    found = _ranked(_probe(index, asked, k, _packs(index.members, ["id", "embedding"])), k)
    where = found.join(index.members.select(F.col("id").alias("nbr"), "cell"), "nbr").select("src", "cell").collect()  # k rows for each of the sample
    place = {r["id"]: np.argsort(np.argsort(-(index.centers @ np.array(r["embedding"])), kind="stable")) for r in some.collect()}
    ranks = np.sort([place[r["src"]][r["cell"]] for r in where])
    return int(ranks[min(math.ceil(target * len(ranks)), len(ranks)) - 1]) + 1 if len(ranks) else 1


def pairs_compared(index: Index, probes: int = 8) -> int:
    """Pairs that a search of all members compares: each member against the members of `probes` cells, by the cells' sizes (all cells of a query are taken to be as probable as their members)."""
    sizes = np.array([r["count"] for r in index.members.groupBy("cell").count().collect()], np.float64)  # a row per cell
    return int((sizes * sizes).sum() * min(probes, len(index.centers)))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall, pairs): share of the exact neighbours that were found."""
    hit = exact.select("src", "nbr").join(found.select("src", "nbr", F.lit(True).alias("hit")), ["src", "nbr"], "left")
    return hit.agg((F.count_if("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"), F.count("*").alias("pairs"))
