"""KMeans over rows packed as plain numbers, for several numbers of clusters in the same passes, with their silhouettes.

The steps are those of Spark's KMeans (k-means|| with two rounds, k-means++ among the candidates, Lloyd's steps until no centre
moves by more than 1e-4 or there were 20) and the model is Spark's. Spark decodes a vector object a row for every pass of the
start and every k; here a pass reads blocks of numbers as they lie and a task sends a few sums. Sums are added in the order of the parts, and random
numbers depend on part, k and seed only, so a fit over the same blocks gives the same centres.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import _py2java
from pyspark.mllib.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.silhouette import sum_of_scores
from millrace.session import spread_parts, staged

BLOCK_NUMBERS = 1 << 16  # of a block; with 1 << 13 a pass was slower
READ_BLOCKS = 16  # handed to Python at a time
CHUNK = 1 << 13  # rows worked on at a time
START_ROUNDS, LOCAL_ROUNDS, ROUNDS, MOVED = 2, 30, 20, 1e-4  # Spark's own

Rows = Iterator[np.ndarray]


def packed(df: DataFrame, features: str = "features") -> DataFrame:
    """Vectors as a written table of blocks (n rows, their numbers), read in bounded parts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                step = max(1, BLOCK_NUMBERS // max(1, x.shape[1]))
                blocks = [x[at : at + step] for at in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array([len(b) for b in blocks], pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["n", "x"])

    blocks = df.select(vector_to_array(features).alias("x")).mapInArrow(pack, "n int, x binary")
    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(READ_BLOCKS), "spark.sql.parquet.columnarReaderBatchSize": str(READ_BLOCKS)}
    return staged(blocks, "blocks", spread_parts(df), few)


def _pass(blocks: DataFrame, work: Callable[[int, Rows], np.ndarray]) -> list[np.ndarray]:
    """What ``work`` makes of the rows of each part, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Rows:
            for batch in batches:
                n, lengths = batch.column("n").to_numpy(), np.frombuffer(batch.column("x").buffers()[1], np.int32)[batch.column("x").offset :][: batch.num_rows + 1]
                whole = np.frombuffer(batch.column("x").buffers()[2], np.uint8)[lengths[0] : lengths[-1]].view(float).reshape(n.sum(), -1)  # blocks lie one after the other
                for at in range(0, len(whole), CHUNK):
                    yield whole[at : at + CHUNK]

        part = TaskContext.get().partitionId()
        found = np.asarray(work(part, rows()), float)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["part", "found"])

    parts = blocks.mapInArrow(run, "part int, found binary").collect()
    return [np.frombuffer(r["found"]) for r in sorted(parts, key=lambda r: r["part"])]


def _closeness(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(centres, rows): half the squared length of a row less half its squared distance."""
    g = centres @ x.T
    g -= ((centres * centres).sum(axis=1) / 2)[:, None]
    return g


def _costs(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(np.einsum("ij,ij->i", x, x) - 2 * _closeness(x, centres).max(axis=0), 0.0)


def _members(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(centres, rows): 1 at the closest centre, the first of equally close ones."""
    g = _closeness(x, centres)
    member = g == g.max(axis=0)
    if np.count_nonzero(member) != len(x):
        member = g.argmax(axis=0) == np.arange(len(centres))[:, None]
    return member.astype(float)


def _start(blocks: DataFrame, ks: Sequence[int], seed: int) -> dict[int, np.ndarray]:
    """k-means||: candidates drawn by their squared distance from those so far, weighted by the rows nearest to them."""

    def drawn(part: int, rows: Rows) -> np.ndarray:
        rng, best = np.random.default_rng([seed, part]), np.empty(0)
        for x in rows:
            keys = rng.random(len(x))
            i = int(np.argmax(keys))
            if not len(best) or keys[i] > best[0]:
                best = np.concatenate([[keys[i]], x[i]])
        return best

    first = max((f for f in _pass(blocks, drawn) if len(f)), key=lambda f: f[0])[1:]
    candidates = {k: first[None, :] for k in ks}
    for step in range(START_ROUNDS):

        def choose(part: int, rows: Rows) -> np.ndarray:
            """A row is drawn if a random number is below 2 k times its share of all costs. These are known at the end, and to be no less
            than those of the part: only rows that would be drawn in the part alone are kept, and parts send them with their sum."""
            rngs, total, kept = {k: np.random.default_rng([seed, part, step, k]) for k in ks}, dict.fromkeys(ks, 0.0), {k: [] for k in ks}
            for x in rows:
                for k in ks:
                    costs = _costs(x, candidates[k])
                    total[k] += costs.sum()
                    drawn = rngs[k].random(len(x))
                    taken = np.flatnonzero(drawn * total[k] < 2.0 * k * costs)
                    kept[k].append(np.column_stack([np.full(len(taken), k), drawn[taken], costs[taken], x[taken]]))
            sums = np.zeros((len(ks), 3 + len(first)))
            sums[:, 0], sums[:, 1], sums[:, 2] = ks, -1.0, list(total.values())
            return np.concatenate([sums, *[_drawn(np.concatenate(kept[k]), total[k]) for k in ks if kept[k]]]).ravel()

        found = np.concatenate(_pass(blocks, choose)).reshape(-1, 3 + len(first))
        for k in ks:
            mine = found[found[:, 0] == k]
            sums = mine[:, 1] < 0
            new = _drawn(mine[~sums], mine[sums, 2].sum())
            candidates[k] = np.concatenate([candidates[k], new[:, 3:]])
    candidates = {k: np.unique(c, axis=0) for k, c in candidates.items()}

    def weigh(part: int, rows: Rows) -> np.ndarray:
        total = [np.zeros(len(candidates[k])) for k in ks]
        for x in rows:
            for found, k in zip(total, ks):
                found += _members(x, candidates[k]).sum(axis=1)
        return np.concatenate(total)

    weights = np.split(sum(_pass(blocks, weigh)), np.cumsum([len(candidates[k]) for k in ks])[:-1])
    return {k: _among(candidates[k], w, k, seed) for k, w in zip(ks, weights)}


def _drawn(rows: np.ndarray, total: float) -> np.ndarray:
    """Of rows (k, random number, cost, ...), those that costs of ``total`` draw."""
    return rows[rows[:, 1] * total < 2.0 * rows[:, 0] * rows[:, 2]]


def _among(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ and Lloyd's steps over a few weighted points; all of them if they are no more than k."""
    if len(points) <= k:
        return points
    rng = np.random.default_rng([seed, k])

    def draw(chance: np.ndarray) -> np.ndarray:
        upto = np.cumsum(chance)
        return points[min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(points) - 1)]

    def squares(centres: np.ndarray) -> np.ndarray:
        return ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)

    centres = draw(weights)[None, :]
    while len(centres) < k:
        chance = weights * squares(centres).min(axis=1)
        centres = np.concatenate([centres, (draw(chance) if chance.sum() > 0 else points[rng.integers(len(points))])[None, :]])
    label = None
    for _ in range(LOCAL_ROUNDS):
        now = squares(centres).argmin(axis=1)
        if label is not None and (now == label).all():
            break
        label = now
        for j in range(k):
            mine = weights * (label == j)
            centres[j] = (mine[:, None] * points).sum(axis=0) / mine.sum() if mine.sum() > 0 else points[rng.integers(len(points))]
    return centres


def fit(blocks: DataFrame, ks: Sequence[int], seed: int) -> dict[int, np.ndarray]:
    """Centres for each k."""
    centres = _start(blocks, ks, seed)
    moving = list(ks)
    for _ in range(ROUNDS):
        if not moving:
            break

        def step(part: int, rows: Rows) -> np.ndarray:
            found = [np.zeros((len(centres[k]), centres[k].shape[1] + 1)) for k in moving]
            for x in rows:
                for total, k in zip(found, moving):
                    member = _members(x, centres[k])
                    total[:, 0] += member.sum(axis=1)
                    total[:, 1:] += member @ x
            return np.concatenate([f.ravel() for f in found])

        sums = np.split(sum(_pass(blocks, step)), np.cumsum([centres[k].size + len(centres[k]) for k in moving])[:-1])
        still = []
        for k, found in zip(moving, sums):
            old, total = centres[k], found.reshape(len(centres[k]), -1)
            some = total[:, :1] > 0  # a cluster without rows keeps its centre
            centres[k] = np.where(some, total[:, 1:] / np.where(some, total[:, :1], 1.0), old)
            if (((centres[k] - old) ** 2).sum(axis=1) > MOVED * MOVED).any():
                still.append(k)
        moving = still
    return centres


def silhouettes(blocks: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float | None]:
    """By squared distance, of the rows at their nearest centres, two passes for all. None where only one centre has rows."""

    def measure(part: int, rows: Rows) -> np.ndarray:
        found = [np.zeros((len(c), c.shape[1] + 2)) for c in centres.values()]
        for x in rows:
            both = np.column_stack([np.ones(len(x)), np.einsum("ij,ij->i", x, x), x])
            for total, c in zip(found, centres.values()):
                total += _members(x, c) @ both
        return np.concatenate([f.ravel() for f in found])

    sums = np.split(sum(_pass(blocks, measure)), np.cumsum([c.size + 2 * len(c) for c in centres.values()])[:-1])
    facts, place = {}, {}
    for (k, c), found in zip(centres.items(), sums):
        total = found.reshape(len(c), -1)
        some = total[:, 0] > 0
        if some.sum() > 1:
            place[k] = np.cumsum(some) - 1
            facts[k] = total[some, 0], total[some, 1], total[some, 2:]
    n = float(sums[0].reshape(len(next(iter(centres.values()))), -1)[:, 0].sum())

    def score(part: int, rows: Rows) -> np.ndarray:
        found: dict[int, list[float]] = {k: [] for k in facts}
        for x in rows:
            for k, fact in facts.items():
                found[k].append(sum_of_scores(x, place[k][_closeness(x, centres[k]).argmax(axis=0)], *fact))
        return np.array([math.fsum(v) for v in found.values()])

    parts = _pass(blocks, score) if facts else []
    scores = {k: math.fsum(p[i] for p in parts) / n for i, k in enumerate(facts)}
    return {k: scores.get(k) for k in centres}


def model(spark: SparkSession, centres: np.ndarray, k: int, seed: int, features: str = "features") -> KMeansModel:
    """Spark's model with these centres."""
    java, estimator = spark._jvm.org.apache.spark, KMeans(featuresCol=features, k=k, seed=seed, solver="block")
    parent = java.mllib.clustering.KMeansModel(_py2java(spark.sparkContext, [DenseVector(c) for c in centres]))
    return estimator._copyValues(KMeansModel(java.ml.clustering.KMeansModel(estimator.uid, parent)))
