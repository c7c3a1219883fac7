"""Rows merged for boosted trees, and scores of the trees after each round, from one pass over the rows.

Trees see of a value only between which two thresholds it lies, so rows between the same ones are alike to them: one of them
stands for all, with their number as its weight. The ensemble after r rounds is the first r trees with their weights. A fitted
model is exported once as plain arrays of nodes (rounds times the nodes of a tree, whatever the data), tasks walk all trees for
merged rows, and rows of equal score are merged by round before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from millrace.operators.quantiles import rank_auc_by
from millrace.session import staged, work_dir

BATCH_CELLS = 1 << 22  # rows times rounds scored at a time
BINS = 32  # places in which a feature can be
MERGED = 1 << 18  # merged rows that a task holds at a time


class Tree(NamedTuple):
    """Nodes of a regression tree; a leaf's feature is -1 and its children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: float


def export_trees(model: GBTClassificationModel) -> list[Tree]:
    """Trees of a model over continuous features, in the order of their rounds, as the model's own files hold them."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = work_dir(spark, "trees")
    model.save(path)
    split = F.col("nodeData.split")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        split["featureIndex"].alias("feature"), split["numCategories"].alias("categories"), split["leftCategoriesOrThreshold"].alias("at"),
    )
    found: dict[int, list] = {i: [] for i in range(len(model.treeWeights))}
    for row in sorted(nodes.collect(), key=lambda r: (r["treeID"], r["id"])):
        if row["leftChild"] >= 0 and row["categories"] != -1:
            raise ValueError("trees that split by category are not exported")
        found[row["treeID"]].append(row)
    trees = []
    for number, rows in found.items():
        inner = [r["leftChild"] >= 0 for r in rows]
        trees.append(
            Tree(
                np.array([r["feature"] if i else -1 for r, i in zip(rows, inner, strict=True)]),
                np.array([r["at"][0] if i else 0.0 for r, i in zip(rows, inner, strict=True)]),
                np.array([r["leftChild"] if i else r["id"] for r, i in zip(rows, inner, strict=True)]),
                np.array([r["rightChild"] if i else r["id"] for r, i in zip(rows, inner, strict=True)]),
                np.array([r["prediction"] for r in rows]),
                model.treeWeights[number],
            )
        )
    return trees


def round_margins(x: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    """Weighted sum of the first 1, 2, ... trees for each row of ``x``, a column per round."""
    out = np.empty((len(x), len(trees)))
    total, every = np.zeros(len(x)), np.arange(len(x))
    for i, tree in enumerate(trees):
        node = np.zeros(len(x), np.int64)
        while (inner := tree.feature[node] >= 0).any():
            value = x[every, np.maximum(tree.feature[node], 0)]
            below = np.where(value <= tree.threshold[node], tree.left[node], tree.right[node])
            node = np.where(inner, below, node)
        total = total + tree.weight * tree.value[node]
        out[:, i] = total
    return out


def bin_values(rows: DataFrame) -> list[np.ndarray]:
    """For each feature up to ``BINS`` values, rising, that stand for all of it: its own where it has so few, else quantiles of all rows."""
    first = rows.select(vector_to_array("features").alias("x")).first()
    width = len(first["x"]) if first else 0
    if not width:
        return []
    x = rows.select(vector_to_array("features").alias("x")).select([F.col("x")[i].alias(f"x{i}") for i in range(width)])
    finite = [F.when(F.abs(f"x{i}") < float("inf"), F.col(f"x{i}")) for i in range(width)]  # NaN is above all numbers
    steps = [i / (BINS - 1) for i in range(BINS)]
    sizes = x.agg(*[F.approx_count_distinct(v) for v in finite], *[F.percentile_approx(v, steps, 1000) for v in finite]).first()
    few = [i for i in range(width) if sizes[i] <= 2 * BINS]
    own = x.agg(*[F.collect_set(finite[i]) for i in few]).first() if few else []
    found = [np.unique(np.array(sizes[width + i] or [0.0])) for i in range(width)]
    for i, values in zip(few, own, strict=True):
        if 0 < len(values) <= BINS:
            found[i] = np.unique(np.array(values))
    return found


def borders(values: np.ndarray) -> np.ndarray:
    """Halfway between values: where Spark puts the thresholds of a feature that has these values only."""
    return (values[:-1] + values[1:]) / 2.0


def _places(x: np.ndarray, limits: Sequence[np.ndarray]) -> np.ndarray:
    """How many of a feature's ``limits`` are below each value; NaN is above all."""
    return np.stack([np.searchsorted(b, x[:, i]) for i, b in enumerate(limits)], axis=1)


def _codes(places: np.ndarray, limits: Sequence[np.ndarray]) -> np.ndarray:
    """One sortable code for each combination of places."""
    sizes = [len(b) + 1 for b in limits]
    if math.prod(sizes) < 1 << 62:
        code = np.zeros(len(places), np.int64)
        for i, size in enumerate(sizes):
            code = code * size + places[:, i]
        return code
    narrow = np.ascontiguousarray(places.astype(np.uint32))
    return narrow.view(np.dtype((np.void, narrow.shape[1] * 4))).ravel()


def _alike(batches: Iterator[pa.RecordBatch], limits: Sequence[np.ndarray], groups: Sequence[str]) -> Iterator[dict[tuple, tuple[np.ndarray, np.ndarray]]]:
    """By values of the groups: one row of each combination of places in ``__x``, and how many rows have it."""
    kept: dict[tuple, list] = {}
    waiting = 0

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, first, where = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        n = np.bincount(where.ravel(), np.concatenate([p[2] for p in parts]), len(codes)).astype(np.int64)
        return codes, np.concatenate([p[1] for p in parts])[first], n

    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        codes = _codes(_places(x, limits), limits)
        for names, rows in _rows_by(batch, groups):
            own, first, n = np.unique(codes[rows], return_index=True, return_counts=True)
            kept.setdefault(tuple(names), []).append((own, x[rows[first]], n))
            waiting += len(own)
        if waiting > MERGED:
            kept = {names: [merged(parts)] for names, parts in kept.items()}
            waiting = sum(len(parts[0][0]) for parts in kept.values())
            if waiting > MERGED // 2:
                yield {names: parts[0][1:] for names, parts in kept.items()}
                kept, waiting = {}, 0
    if kept:
        yield {names: merged(parts)[1:] for names, parts in kept.items()}


def merged_rows(rows: DataFrame, groups: Sequence[str], weight: str) -> DataFrame:
    """``features`` at the values of their bins, ``groups`` and how many rows are so, as a written table.

    A threshold halfway between two of a feature's values parts the rows themselves as it parts these, so trees that are fitted here
    hold for the rows. With f features there are at most ``BINS`` to the power of f rows by groups, however many went in.
    As in Spark's own fits, a feature that is not a finite number ends the job.
    """
    values = bin_values(rows)
    limits = [borders(v) for v in values]
    narrow = rows.select(vector_to_array("features").alias("__x"), *groups)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not np.isfinite(batch.column("__x").flatten().to_numpy(zero_copy_only=False)).all():
                raise ValueError("a feature is NaN or infinite")
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _alike(checked(batches), limits, groups):
            for names, (x, n) in found.items():
                places = _places(x, limits)
                x = np.stack([v[places[:, i]] for i, v in enumerate(values)], axis=1)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(values), x.ravel())
                yield pa.RecordBatch.from_arrays([lists, *[pa.repeat(v, len(x)) for v in names], pa.array(n)], names=["__x", *groups, weight])

    kinds = "".join(f"`{g}` {narrow.schema[g].dataType.simpleString()}, " for g in groups)
    counts = narrow.mapInArrow(run, f"__x array<double>, {kinds}`{weight}` bigint")
    merged = counts.groupBy("__x", *groups).agg(F.sum(weight).cast("double").alias(weight))
    return staged(merged.select(array_to_vector("__x").alias("features"), *groups, weight), "merged")


def _rows_by(batch: pa.RecordBatch, groups: Sequence[str]) -> Iterator[tuple[list[pa.Scalar], np.ndarray]]:
    """Values of the groups in a batch, and the rows that have them."""
    place = pa.array(np.arange(batch.num_rows))
    if not groups:
        yield [], np.arange(batch.num_rows)
        return
    found = pa.table([*[batch.column(g) for g in groups], place], names=[*groups, "__i"]).group_by(list(groups)).aggregate([("__i", "list")])
    for k in range(found.num_rows):
        yield [found.column(g)[k] for g in groups], found.column("__i_list")[k].values.to_numpy()


def _merged(trees: Sequence[Tree], limits: Sequence[np.ndarray], at: Sequence[int], groups: Sequence[str]):
    """Rows (groups, round, margin, n_positive, n_negative) of a task; rows between the same thresholds are scored once."""
    step = max(1, BATCH_CELLS // len(trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _alike(batches, limits, [*groups, "__y"]):
            for (*names, y), (x, n) in found.items():
                for start in range(0, len(x), step):
                    margins = round_margins(x[start : start + step], trees)
                    for r in at:
                        values, places = np.unique(margins[:, r - 1], return_inverse=True)
                        total = np.bincount(places, n[start : start + step], len(values)).astype(np.int64)
                        positive = (total * y.as_py()).astype(np.int64)
                        own = [pa.repeat(v, len(values)) for v in [*names, pa.scalar(r, pa.int32())]]
                        arrays = [*own, pa.array(values), pa.array(positive), pa.array(total - positive)]
                        yield pa.RecordBatch.from_arrays(arrays, names=[*groups, "round", "margin", "n_positive", "n_negative"])

    return run


def auc_by_round(
    model: GBTClassificationModel, rows: DataFrame, label: str, groups: Sequence[str] = (), at: Sequence[int] | None = None
) -> DataFrame:
    """Exact area under ROC after each round (or those of ``at``), for each group of ``rows``, whose features are in ``features``.

    Columns: ``groups``, round, auc (NULL where a class is missing), n_positive, n_negative. The label is 0 or 1; rows without one are left out.
    """
    trees = export_trees(model)
    wanted = sorted(set(at)) if at is not None else list(range(1, len(trees) + 1))
    if not wanted or wanted[0] < 1 or wanted[-1] > len(trees):
        raise ValueError(f"rounds are from 1 to {len(trees)}")
    trees = trees[: wanted[-1]]
    narrow = rows.where(F.col(label).isNotNull()).select(*groups, vector_to_array("features").alias("__x"), F.col(label).cast("double").alias("__y"))
    kinds = ", ".join(f"`{g}` {narrow.schema[g].dataType.simpleString()}" for g in groups)
    schema = ", ".join(filter(None, [kinds, "round int, margin double, n_positive bigint, n_negative bigint"]))
    limits = [np.unique(np.concatenate([t.threshold[t.feature == f] for t in trees])) for f in range(model.numFeatures)]
    counts = narrow.mapInArrow(_merged(trees, limits, wanted, groups), schema)
    keys = [*groups, "round"]
    merged = counts.groupBy(*keys, "margin").agg(F.sum("n_positive").alias("n_positive"), F.sum("n_negative").alias("n_negative"))
    return rank_auc_by(staged(merged, "margins"), keys, "margin", "n_positive", "n_negative")
