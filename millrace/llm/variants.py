"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Two different words are near if their common prefix and common suffix together are at least as long as the longer one less
one. Words are compared densely, as matrices of code points padded at the end (prefixes) and at the front
(suffixes), but only within groups that such a pair must share:

1. For a pair whose longer word has M code points let a be (M - 1) // 3. The one edit leaves the first and last a code
   points alone, or all but the first a, or all but the last a. So a word joins three groups for M its own length and
   three for M one more; a pair meets in exactly one of them that counts it (``_KINDS``, in this order).
2. Groups are cut into blocks of ``block`` words (fewer for long words), and every two blocks of a group form a
   tile. A tile is bounded however many words share a beginning; a group of one word is dropped before.
3. A task takes tiles in order and compares a row with the one 1, 2, 3, ... rows further on in the same tile, all tiles at
   once. Only near pairs leave it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.storage import keyed, staged
from millrace.llm.words import rows_of

SHORTEST = 7
LEAST = 2
TIMES = 10  # how much more frequent than a word its form is
BLOCK = 512
CELLS = 1 << 20  # code points of a block, at most
TASK_WORDS = 1 << 18  # distinct words a task gathers before it hands them on
ROUNDS = 6  # doublings; a chain of forms has at most 19 links, as counts are below 2**63
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_KINDS = ("ends", "tail", "head")


def letter_runs(text: str | None) -> list[str]:
    """Maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), of which only A-Z are lower-cased."""
    return [w.lower() if w.isascii() else w.translate(_FOLD) for w in _RUNS.findall(text)] if text else []


def misspelt(run: str, doc_id: int | None) -> str:
    """A run in a document as the query's contract has it: one in 31 loses a code point. All stay without id."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, plant: bool = False, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """Words of at least ``shortest`` code points with at least ``least`` occurrences: ``word``, ``n``.

    Counts are of all texts; NULL has no words. Tasks count first, then one map-side-combined aggregation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            columns = [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                for word, n in Counter(w for w in letter_runs(text) if len(w) >= shortest).items():
                    if plant:
                        word = misspelt(word, doc_id)
                    if len(word) >= shortest:
                        counts[word] += n
                if len(counts) >= TASK_WORDS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    found = keyed(docs).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _grouped(words: DataFrame) -> DataFrame:
    """Rows (longer, kind, part, word, n): the six groups of each word. ``part`` is a hash; what it merges is still compared."""
    size = F.length("word")
    each = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer"))
    a = F.floor((F.col("longer") - 1) / 3).cast("int")
    rest = F.col("longer") - a
    word, one = F.col("word"), F.lit(1)
    head, tail = F.substring(word, one, a), F.substring(word, F.length(word) - a + 1, a)
    parts = {
        "ends": F.xxhash64(head, tail),
        "tail": F.xxhash64(F.substring(word, F.length(word) - rest + 1, rest)),
        "head": F.xxhash64(F.substring(word, one, rest)),
    }
    groups = F.array(*[F.struct(F.lit(i).cast("byte").alias("kind"), parts[k].alias("part")) for i, k in enumerate(_KINDS)])
    return each.select("word", "n", "longer", F.explode(groups).alias("g")).select("longer", "g.kind", "g.part", "word", "n")


def _tiled(groups: DataFrame, block: int) -> DataFrame:
    """Rows in tiles, with ``side`` the block a row belongs to; groups of one word are gone."""
    key = ["longer", "kind", "part"]
    sizes = groups.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1")
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(CELLS) / F.col("longer"))))
    blocks = F.ceil(F.col("size") / most).cast("int")
    dealt = groups.join(sizes, key).withColumn("blocks", blocks)
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("word", F.lit(13)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select(*key, "word", "n", "side", "blocks", other.alias("other"))
    i, j = F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")
    return dealt.select(*key, i, j, "side", "word", "n")


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded at the end, padded at the front, and lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max(initial=0))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    rows = np.repeat(np.arange(len(words)), sizes)
    places = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    left = np.zeros((len(words), width + 1), np.uint32)
    right = np.zeros((len(words), width + 1), np.uint32)
    left[rows, places] = codes
    right[rows, np.repeat(sizes, sizes) - 1 - places] = codes
    return left, right, sizes


def near_pairs(tiles: np.ndarray, rows: dict[str, np.ndarray], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of near words of the same tile, those that the tile's kind and length are to count.

    Rows of a tile stand together. In a tile of two blocks, words of the same block are left to another tile.
    """
    left, right, sizes = matrices(words)
    across = rows["i"] != rows["j"]
    found = [(np.empty(0, np.int64),) * 2]
    x, step = np.arange(len(words) - 1), 1
    while True:
        x = x[x + step < len(words)]
        x = x[tiles[x] == tiles[x + step]]
        if not len(x):
            break
        y = x + step
        longer = np.maximum(sizes[x], sizes[y])
        ok = (np.abs(sizes[x] - sizes[y]) <= 1) & (longer == rows["longer"][x])
        ok &= ~(across[x] & (rows["side"][x] == rows["side"][y]))
        u, v, longer = x[ok], y[ok], longer[ok]
        prefix = (left[u] != left[v]).argmax(axis=1)  # different words differ within the width or its padding
        suffix = (right[u] != right[v]).argmax(axis=1)
        a = (longer - 1) // 3
        kind = np.where(prefix < a, _KINDS.index("tail"), np.where(suffix < a, _KINDS.index("head"), _KINDS.index("ends")))
        near = (prefix + suffix >= longer - 1) & (kind == rows["kind"][u])
        found.append((u[near], v[near]))
        step += 1
    xs, ys = zip(*found, strict=True)
    return np.concatenate(xs), np.concatenate(ys)


def _compared() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (word, near, near_n), both ways, of tiles that come one after the other."""
    keys = ["longer", "kind", "part", "i", "j"]

    def slices(starts: np.ndarray, end: int, longer: np.ndarray) -> Iterator[tuple[int, int]]:
        """Whole tiles, so many at a time as their matrices may hold."""
        most = 4 * CELLS // int(longer[:end].max())
        while len(starts):
            k = max(1, int(np.searchsorted(starts, starts[0] + most)))
            stop = int(starts[k]) if k < len(starts) else end
            yield int(starts[0]), stop
            starts = starts[k:]

    def pairs(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        rows = {c: table[c].to_numpy() for c in [*keys, "side"]}
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in keys:
            new[1:] |= rows[c][1:] != rows[c][:-1]
        starts = np.flatnonzero(new)
        end = len(table) if last else int(starts[-1])
        if not last:
            starts = starts[:-1]
        tiles = np.cumsum(new)
        words = table["word"].combine_chunks()
        for a, b in slices(starts, end, rows["longer"]) if len(starts) else ():
            x, y = near_pairs(tiles[a:b], {c: v[a:b] for c, v in rows.items()}, words[a:b].to_pylist())
            if len(x):
                one, other = pa.array(np.concatenate([x, y]) + a), pa.array(np.concatenate([y, x]) + a)
                columns = [words.take(one), words.take(other), table["n"].combine_chunks().take(other)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])
        yield table.slice(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            *found, kept = pairs(table, last=False)
            yield from found
        if kept is not None:
            yield from list(pairs(kept, last=True))[:-1]

    return run


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (word, near, near_n) for every near pair of ``words`` (``word``, ``n``; distinct words), both ways."""
    tiles = _tiled(_grouped(words), block)
    key = ["longer", "kind", "part", "i", "j"]
    dealt = tiles.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_compared(), "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of the chain of ``form`` that starts at each word of ``links``.

    Chains are halved in every round; counts rise along a chain, so there are no cycles and few rounds.
    """
    at = staged(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved"))
        at = staged(moved, "roots")
        if at.where("moved").isEmpty():
            break
    return at.select("word", "root")


def spelling_variants(docs: DataFrame, plant: bool = False, shortest: int = SHORTEST, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of ``word_counts``.

    A word's form is the most frequent near word (of equal ones the first by code points), if it is at least ``TIMES`` as
    frequent as the word. An empty table, or one without such words, gives no rows.
    """
    words = staged(word_counts(docs, plant, shortest, least), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near"))).alias("best")
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best)
    taken = -F.col("best.rank") >= F.col("n") * TIMES
    joined = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"),
        F.when(taken, -F.col("best.rank")).alias("form_n"),
    )
    joined = staged(joined, "forms")
    ends = roots(joined.where("form is not null"))
    return joined.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
