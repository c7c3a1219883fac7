"""Silhouettes of clusters: by squared distances from sums, and by plain distances of blocks and boxes of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.distances import APART, Box, Cuts, Rows, cut, far_sums, gaps, meet
from millrace.session import staged

BLOCK = 16384  # rows of a block at most; a task compares two blocks at a time
LEAST_BLOCK = 1024  # rows below which blocks are not made smaller to keep more tasks busy
LEAST_BLOCKS = 16
MOST_CELLS = 512  # their nodes go to every task; cells of more rows are dealt into several blocks
MOST_PARTS = 4096
CUT_NUMBERS = 1 << 18  # that the driver looks at to see where cells are cut
DEALT = 1 << 16  # rows of a batch that is dealt to pairs of blocks


def _score(own: Column, other: Column, size: Column) -> Column:
    """Of one row, from its mean distance to its own cluster and to the nearest other one."""
    return F.when(size <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(other - own, F.greatest(own, other)), F.lit(0.0)))


def sum_of_scores(x: np.ndarray, mine: np.ndarray, n: np.ndarray, norms: np.ndarray, total: np.ndarray) -> float:
    """Of rows in the clusters ``mine``, by squared distance: from the sizes of the clusters, their sums of squared lengths and of vectors."""
    lengths, every = (x * x).sum(axis=1), np.arange(len(x))
    far = np.maximum(n * lengths[:, None] + norms - 2 * (x @ total.T), 0.0)
    own = far[every, mine] / np.maximum(n[mine] - 1, 1)
    far /= n
    far[every, mine] = np.inf
    other = far.min(axis=1)
    most = np.maximum(own, other)
    known = (n[mine] > 1) & (most > 0)
    return float(np.where(known, (other - own) / np.where(known, most, 1.0), 0.0).sum())


def squared_silhouettes(df: DataFrame, predictions: Sequence[str], features: str = "features") -> dict[str, float | None]:
    """Silhouette by squared Euclidean distance for each of the prediction columns, two passes over ``df`` for all of them.

    The sum of squared distances to a cluster follows from its size, the sum of its vectors and the sum of their squared
    lengths, so one aggregate by (column, cluster) is all that rows need to know of one another. It is
    fetched (clusters times features numbers) and goes into the second pass, of which a sum for each task and column comes back.
    None for fewer than two clusters.
    """
    named = F.explode(F.array(*[F.struct(F.lit(p).alias("by"), F.col(p).cast("int").alias("cluster")) for p in predictions]))
    x = F.col(features)
    norm = F.aggregate(vector_to_array(x), F.lit(0.0), lambda total, v: total + v * v)
    long = df.select(x.alias("x"), norm.alias("norm"), named.alias("p")).select("x", "norm", "p.by", "p.cluster")
    sums = long.groupBy("by", "cluster").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("x"))).alias("sum"), F.sum("norm").alias("norms")
    ).collect()
    facts = {}
    for p in predictions:
        clusters = sorted((r for r in sums if r["by"] == p), key=lambda r: r["cluster"])
        if len(clusters) > 1:
            columns = ([r[c] for r in clusters] for c in ("cluster", "n", "norms", "sum"))
            facts[p] = [np.array(c, float) for c in columns]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row (by, score, n) of a task for each column: the sum of its rows' scores."""
        found, n_rows = {p: [] for p in facts}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n_rows += len(v)
            for p, (names, n, norms, total) in facts.items():
                mine = np.searchsorted(names, batch.column(p).to_numpy(zero_copy_only=False))
                found[p].append(sum_of_scores(v, mine, n, norms, total))
        scores = [math.fsum(v) for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(scores, pa.float64()), pa.array([n_rows] * len(found), pa.int64())], names=["by", "score", "n"])

    rows = df.select(*[F.col(p).cast("int").alias(p) for p in facts], vector_to_array(x).alias("x"))
    parts = rows.mapInArrow(scored, "by string, score double, n bigint").collect() if facts else []
    own = {p: [r for r in parts if r["by"] == p] for p in facts}
    return {p: math.fsum(r["score"] for r in own[p]) / sum(r["n"] for r in own[p]) if p in facts else None for p in predictions}


def euclidean_silhouette(df: DataFrame, cluster: str = "prediction", features: str = "features", block: int = BLOCK) -> DataFrame:
    """(n_rows, silhouette) by plain Euclidean distance, for which no sum stands: every row meets every other one.

    Meant for samples. Rows are dealt into cells by where they lie, and cells of more than ``block`` rows into blocks. A task compares one
    pair of blocks of near cells; distances to distant cells are read off their nodes (``operators/distances.py``), which every
    task knows. What leaves a task is one sum per row and cluster, so a row is shuffled once for each block near it. NULL for fewer than two clusters.
    Memory is bounded by two blocks and the nodes. Time grows a little faster than the rows where few features are wide; where
    many are, no cell is distant, every block meets every other one, and time is quadratic.
    """
    rows = df.select(F.col(cluster).cast("int").alias("cluster"), vector_to_array(features).alias("x"))
    rows = staged(rows.withColumn("id", F.monotonically_increasing_id()), "sample")  # written, so an id stays with its row
    sizes = {r["cluster"]: r["count"] for r in rows.groupBy("cluster").count().collect()}
    n, names = sum(sizes.values()), sorted(sizes)
    if len(sizes) < 2:
        return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("double").alias("silhouette"))
    width = len(rows.select("x").first()["x"])
    wanted = max(math.ceil(n / block), min(LEAST_BLOCKS, math.ceil(n / LEAST_BLOCK)))
    near_cut = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n * width // CUT_NUMBERS))) == 0).select("x").toArrow()
    cuts = cut(_matrix(near_cut.column("x").combine_chunks(), width), min(wanted, MOST_CELLS))
    boxes = _cell_boxes(rows, cuts, width)
    parts = [max(1, math.ceil(b.n / block)) if wanted > 1 else 1 for b in boxes]
    first = np.concatenate([[0], np.cumsum(parts)])

    lo, hi = np.array([b.lo for b in boxes]), np.array([b.hi for b in boxes])
    reach = np.array([b.reach for b in boxes])
    known = np.array([b.expansion is not None for b in boxes])
    apart = [known[c] & known & (gaps(lo[c], hi[c], lo, hi) >= APART * np.maximum(reach[c], reach)) for c in range(len(boxes))]
    weights = _cell_weights(rows, cuts, boxes, names, width) if any(a.any() for a in apart) else {}
    near = [np.concatenate([np.arange(first[d], first[d + 1]) for d in np.flatnonzero(~apart[c])]) for c in range(len(boxes))]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once for each block near its own, as a row of the pair."""
        for batch in batches:
            step = max(1, DEALT // max(len(blocks) for blocks in near))
            for piece in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                x, ids = _matrix(piece.column("x"), width), piece.column("id").to_numpy()
                cell = cuts.cells(x)
                part = (ids * 0x9E3779B1 >> 16) % np.array(parts)[cell]
                own = first[cell] + part
                times = np.array([len(near[c]) for c in cell])
                other, at = np.concatenate([near[c] for c in cell]), np.repeat(np.arange(len(cell)), times)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(x[at].ravel()))
                numbers = (np.minimum(own[at], other), np.maximum(own[at], other), own[at])
                columns = [piece.column(c).take(pa.array(at)) for c in ("id", "cluster")]
                yield pa.RecordBatch.from_arrays([*columns, lists, *[pa.array(v, pa.int32()) for v in numbers]], names=["id", "cluster", "x", "i", "j", "own"])

    def compare(tile: pa.Table) -> pa.Table:
        """Sums of distances from each row of a tile to the rows of each cluster in the other block, or in its own and in all distant cells."""
        x = _matrix(tile.column("x").combine_chunks(), width)
        member, side = _members(tile.column("cluster").to_numpy(), names), tile.column("own").to_numpy()
        i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        out = np.zeros(member.shape)
        if i == j:
            block_rows = Rows(x, member)
            meet(block_rows, block_rows)
            out += block_rows.sums()
            _add_distant(int(np.searchsorted(first, i, side="right")) - 1, boxes, apart, weights, x, out)
        elif (side == i).any() and (side == j).any():
            sides = [Rows(x[side == s], member[side == s]) for s in (i, j)]
            meet(*sides)
            for s, found in zip((i, j), sides):
                out[side == s] = found.sums()
        sums = {f"s{k}": out[:, k] for k in range(len(names))}
        return pa.table({"id": tile.column("id"), "cluster": tile.column("cluster")} | sums)

    schema = "id long, cluster int, " + ", ".join(f"s{k} double" for k in range(len(names)))
    tiles = sum(parts[c] * len(near[c]) + parts[c] for c in range(len(boxes))) // 2  # their work is not told by their bytes: a partition each, up to a bound
    pairs = rows.mapInArrow(dealt, "id long, cluster int, x array<double>, i int, j int, own int")
    sums = pairs.repartition(min(tiles, MOST_PARTS), "i", "j").groupBy("i", "j").applyInArrow(compare, schema)
    totals = sums.groupBy("id", "cluster").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(names))])
    size = F.lit(None).cast("long")
    own_sum, others = F.lit(None).cast("double"), []
    for k, name in enumerate(names):
        at_home = F.col("cluster") == name
        size, own_sum = F.when(at_home, F.lit(sizes[name])).otherwise(size), F.when(at_home, F.col(f"s{k}")).otherwise(own_sum)
        others.append(F.when(~at_home, F.col(f"s{k}") / sizes[name]))
    score = _score(F.try_divide(own_sum, size - 1), F.least(*others), size)
    return totals.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(score).alias("silhouette"))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _members(cluster: np.ndarray, names: Sequence[int]) -> np.ndarray:
    return (cluster[:, None] == np.array(names)[None, :]).astype(float)


def _cell_boxes(rows: DataFrame, cuts: Cuts, width: int) -> list[Box]:
    """The box around the rows of each cell, one pass."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            cell = cuts.cells(x)
            order = np.argsort(cell, kind="stable")
            found, starts, counts = np.unique(cell[order], return_index=True, return_counts=True)
            if len(found):
                edges = [way.reduceat(x[order], starts, axis=0) for way in (np.minimum, np.maximum)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(e.ravel())) for e in edges]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts, pa.int64()), *lists], names=["cell", "n", "lo", "hi"])

    edges = [way(F.get(side, F.lit(f))).alias(f"{side}{f}") for side, way in (("lo", F.min), ("hi", F.max)) for f in range(width)]
    found = rows.mapInArrow(bounds, "cell int, n long, lo array<double>, hi array<double>").groupBy("cell").agg(F.sum("n").alias("n"), *edges).collect()
    boxes = {r["cell"]: Box(np.array(r[2 : 2 + width], float), np.array(r[2 + width :], float), r["n"]) for r in found}
    empty = Box(np.full(width, np.nan), np.full(width, np.nan), 0)
    return [boxes.get(c, empty) for c in range(int(cuts.cell.max()) + 1)]


def _cell_weights(rows: DataFrame, cuts: Cuts, boxes: Sequence[Box], names: Sequence[int], width: int) -> dict[int, np.ndarray]:
    """What the nodes of each cell weigh in place of its rows, one pass; a task sends one sum a cell."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            cell, member = cuts.cells(x), _members(batch.column("cluster").to_numpy(), names)
            for c in np.unique(cell).tolist():
                if boxes[c].expansion is not None:
                    here = cell == c
                    found[c] = found.get(c, 0.0) + boxes[c].moments(x[here], member[here])
        for c, total in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["cell", "total"])

    def added(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(t.as_py()) for t in parts.column("total")).reshape(-1, len(names))
        found = boxes[parts.column("cell")[0].as_py()].weights(total)
        return pa.table({"cell": parts.column("cell")[:1], "total": pa.array([found.tobytes()], pa.binary())})

    sums = rows.mapInArrow(weighed, "cell int, total binary").groupBy("cell").applyInArrow(added, "cell int, total binary").collect()
    return {r["cell"]: np.frombuffer(r["total"]).reshape(-1, len(names)) for r in sums}


def _add_distant(cell: int, boxes: Sequence[Box], apart: Sequence[np.ndarray], weights: dict[int, np.ndarray], x: np.ndarray, out: np.ndarray) -> None:
    """Adds the sums of distances from rows of a cell to those of all distant cells."""
    others = np.flatnonzero(apart[cell])
    if len(others):
        here = boxes[cell].nodes()
        values = np.zeros((len(here), out.shape[1]))
        for c in others:
            far_sums(here, boxes[c].nodes(), None, weights[c], values, None, boxes[cell].centre)
        boxes[cell].spread(values, x, out)
