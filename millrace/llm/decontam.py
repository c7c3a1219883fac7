"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by set size (powers of two). For a partition of items of up to ``u`` shingles,
documents are cut into blocks of ``u`` shingles, so that block and item are of like size however long the
document is, and both get a MinHash sketch of one hash: the smallest value in each of ``2 u`` bins. A block
and an item that agree in any bin are a candidate, and the share of the item's distinct shingles that
the whole document contains is then counted exactly. An item that lies across two blocks has half
its shingles in one of them, and each of those is the smallest in its bin more often than not. The smallest
items have blocks of one shingle, whose sketch is that shingle.

Items go to the tasks as one broadcast index for each group of at most ``ITEMS`` items and ``CHARACTERS``
characters; more items are more passes over the documents, not a larger index. Documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.words import SHINGLE, grams, hashes, rows_of, words

PERCENT = 80
ITEMS = 1 << 16
CHARACTERS = 1 << 26
TINY = 8  # items of so few shingles have blocks of one, and all their shingles are the sketch
_SLOTS = 22  # bits of the table that says which hashes may be in an index
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


class SizeClass(NamedTuple):
    """Sketch values of the items of one size partition."""

    size: int
    k: int
    values: np.ndarray  # sorted
    owners: np.ndarray  # item by value
    slots: np.ndarray


class Index(NamedTuple):
    ids: list[int | None]
    sets: list[np.ndarray]
    lengths: list[int]  # words of a shingle of the item
    classes: list[SizeClass]


def _bin_minima(tokens: np.ndarray, size: int) -> np.ndarray:
    """Whether each token is the smallest of its bin within its block of ``size`` tokens."""
    if size == 1:
        return np.ones(len(tokens), bool)
    bins = np.uint64(2 * size)
    key = (np.arange(len(tokens), dtype=np.uint64) // np.uint64(size)) * bins + (tokens & (bins - np.uint64(1)))
    least = np.full((len(tokens) // size + 1) * 2 * size, _MOST, np.uint64)
    np.minimum.at(least, key.astype(np.int64), tokens)
    return least[key.astype(np.int64)] == tokens


def build_index(items: list[tuple[int | None, str | None]], k: int = SHINGLE) -> Index:
    """Items without words are in no document and are left out."""
    ids, sets, lengths = [], [], []
    by_class: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = defaultdict(list)
    for item_id, text in items:
        own = hashes(words(text))
        if not len(own):
            continue
        length = min(k, len(own))
        tokens = np.unique(grams(own, length))
        size = 1 if len(tokens) <= TINY else 1 << (len(tokens) - 1).bit_length()
        by_class[size, length].append((tokens[_bin_minima(tokens, size)], len(ids)))
        ids.append(item_id)
        sets.append(tokens)
        lengths.append(length)
    classes = []
    for (size, length), parts in sorted(by_class.items()):
        values = np.concatenate([v for v, _ in parts])
        owners = np.concatenate([np.full(len(v), i) for v, i in parts])
        order = np.argsort(values, kind="stable")
        slots = np.zeros(1 << _SLOTS, bool)
        slots[values >> np.uint64(64 - _SLOTS)] = True
        classes.append(SizeClass(size, length, values[order], owners[order], slots))
    return Index(ids, sets, lengths, classes)


def found_items(text: str | None, index: Index, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Items (by place) that a document contains, and how many of their shingles."""
    own = hashes(words(text))
    runs: dict[int, np.ndarray] = {}
    candidates: set[int] = set()
    for c in index.classes:
        if c.k not in runs:
            runs[c.k] = grams(own, c.k)
        tokens = runs[c.k]
        maybe = c.slots[tokens >> np.uint64(64 - _SLOTS)]
        if not maybe.any():
            continue
        values = np.unique(tokens[maybe & _bin_minima(tokens, c.size)])
        low, high = np.searchsorted(c.values, values), np.searchsorted(c.values, values, "right")
        for a, b in zip(low.tolist(), high.tolist()):
            candidates.update(c.owners[a:b].tolist())
    if not candidates:
        return []
    whole = {k: np.unique(tokens) for k, tokens in runs.items()}
    out = []
    for i in sorted(candidates):
        shared = len(np.intersect1d(index.sets[i], whole[index.lengths[i]], assume_unique=True))
        if 100 * shared >= percent * len(index.sets[i]):
            out.append((i, shared))
    return out


def _indexes(items: DataFrame, k: int) -> Iterator[Index]:
    """One index for each group of items of bounded size."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    n, characters = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    groups = 1 + max(2 * n // ITEMS, 2 * (characters or 0) // CHARACTERS)
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    for i in range(groups):
        yield build_index([(r[0], r[1]) for r in rows.where(group == i).collect()], k)


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Rows (item_id, doc_id, n_item, n_shared, containment): items whose shingles a document holds to ``percent``.

    A shorter item is one shingle of all its words. NULL and empty texts contain nothing and are
    contained nowhere; rows without an id and repeated rows each count.
    """
    spark, parts = docs.sparkSession, []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in _indexes(items, k):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            at = shared.value
            for batch in batches:
                out = []
                for doc_id, text in rows_of(batch, "doc_id", "text"):
                    out += [(at.ids[i], doc_id, len(at.sets[i]), n) for i, n in found_items(text, at, percent)]
                columns = zip(*out) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64()) for c in columns], names=["item_id", "doc_id", "n_item", "n_shared"]
                )

        parts.append(docs.mapInArrow(run, "item_id long, doc_id long, n_item long, n_shared long"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """``docs`` without those that contain an item; all columns as they are."""
    schema = docs.schema
    for index in _indexes(items, k):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found_items(t, shared.value, percent) for (t,) in rows_of(batch, "text")], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
