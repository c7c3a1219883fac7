"""Substring dedup by collinear chaining of shared seeds.

1. Seeds are runs of ``K`` words that are the smallest hash among ``WINDOW`` neighbouring runs, so any run of
   ``K + WINDOW - 1`` words that two documents share holds a shared seed. A block of words that begins at each seed is a
   seed too, so long that any unedited passage of the least length holds a shared one.
2. All places of a seed are read in order of the documents. A document is matched with the smallest that has the seed and with the one
   before it that has it; every occurrence in another document is matched with the first one there, the second also with the second and
   so on. Occurrences that follow each other within a block are a text that repeats itself: they are matched in order, and from the first anew
   when the other document has no more.
3. Matches between two documents are merged where they touch, and chained in order of both, each gap costing by its length; a Fenwick
   tree over the positions in the first document gives the best predecessor.
4. Chains that follow each other are joined and aligned word by word between their matches and beyond their ends; the
   longest joined pieces that have ``LEAST_WORDS`` words of which ``PERCENT`` agree are passages.

Positions are words from 0 and ends are exclusive. The first document of a passage keeps it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.storage import keyed, staged
from millrace.llm.words import grams, hashes, mixed, rows_of, signed, slices, words

K = 6
WINDOW = 10
LEAST_WORDS = 50
PERCENT = 80
GAP_COST = 0.15  # of a word without match in either document
MARGIN = 32  # words that are aligned beyond a chain's ends
SPREAD = 1 << 18  # places that are matched at a time, of many seeds or of one
FREQUENT = 1 << 14  # a seed with more places is dealt over tasks
RANGES = 32  # of documents, for such a seed
NTH = 16  # place of a seed in a slice of documents that is counted
BRIDGE = 64  # words between chains that are aligned as one: pieces too short alone allow 25, and seeds lie inside them
CUT = 64  # windows of text begin and end at multiples of it
DROP = 8  # an alignment ends where its score falls so far below its best
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

PLACES = "seed long, doc long, at int, block int"
KNOWN = ["seed", "part", "doc", "at", "block", "known"]
MATCHES = "doc long, first long, at int, first_at int, kind int"
CHAINS = "doc long, first long, d0 int, d1 int, f0 int, f1 int, dp array<int>, fp array<int>, size array<int>"
SPANS = "doc_id long, start_word int, end_word int, first_doc_id long, first_start int, first_end int, n_match int"


def seed_places(word_hashes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a document's seeds; a text of fewer windows has the smallest of its runs."""
    runs = grams(word_hashes, k)
    n = len(runs)
    if not n:
        return runs, np.empty(0, np.int32)
    window = min(window, n)
    least = runs[: n - window + 1].copy()
    for i in range(1, window):
        np.minimum(least, runs[i : n - window + 1 + i], out=least)
    # a run is a seed if it is the least of any window that covers it
    reach = np.zeros(n, np.uint64)
    for i in range(window):
        np.maximum(reach[i : n - window + 1 + i], least, out=reach[i : n - window + 1 + i])
    at = np.flatnonzero(runs <= reach)
    return runs[at], at.astype(np.int32)


def _steps(least_words: int, k: int = K) -> list[int]:
    """Places of the runs that cover a block; a passage of ``least_words`` holds the block of its first seed."""
    last = max(0, least_words - WINDOW + 1 - k)
    return [*range(0, last, k), last]


def places_of(word_hashes: np.ndarray, sizes: np.ndarray, steps: list[int], k: int = K) -> tuple[np.ndarray, ...]:
    """Seeds, the number of their document, their places and the blocks that begin there (0: none), of documents one after the other."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    runs = grams(word_hashes, k)
    left = np.repeat(ends, sizes)[: len(runs)] - np.arange(len(runs)) - k  # runs that follow in the document; less than 0: it ends before
    count = len(runs) - WINDOW + 1
    reach = np.zeros(len(runs), np.uint64)
    if count > 0:
        least = runs[:count].copy()
        for i in range(1, WINDOW):
            np.minimum(least, runs[i : count + i], out=least)
        least[left[:count] < WINDOW - 1] = 0
        for i in range(WINDOW):
            np.maximum(reach[i : count + i], least, out=reach[i : count + i])
    for i in np.flatnonzero((sizes >= k) & (sizes - k + 1 < WINDOW)).tolist():  # a single window of all runs
        own = slice(begins[i], ends[i] - k + 1)
        reach[own] = runs[own].min()
    at = np.flatnonzero((runs <= reach) & (left >= 0))
    blocks = np.zeros(len(at), np.uint64)
    whole = left[at] >= steps[-1]
    hashed = np.zeros(int(whole.sum()), np.uint64)
    for step in steps:
        hashed = mixed(hashed + runs[at[whole] + step])
    blocks[whole] = np.maximum(hashed >> np.uint64(33), np.uint64(1))
    docs = np.repeat(np.arange(len(sizes)), sizes)[at]
    return runs[at], docs, (at - begins[docs]).astype(np.int32), blocks.astype(np.int32)


def _places(steps: list[int]):
    """Places of all seeds; every ``NTH`` place of a seed in a slice of documents comes a second time, as place -1, to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sizes, tokens = [], [], []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                own = words(text) if doc_id is not None else []
                if len(own) >= K:
                    ids.append(doc_id)
                    sizes.append(len(own))
                    tokens += own
            if ids:
                seeds, docs, at, blocks = places_of(hashes(tokens), np.array(sizes), steps)
                docs = np.array(ids, np.int64)[docs]
                order = np.lexsort((docs, seeds))
                begins = np.flatnonzero(np.append(True, seeds[order[1:]] != seeds[order[:-1]]))
                turn = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
                nth = order[turn % NTH == NTH - 1]
                columns = [np.append(c, c[nth]) for c in (signed(seeds), docs, at, blocks)]
                columns[2][len(at) :] = -1
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "doc", "at", "block"])

    return run


def _pairs(key: np.ndarray, doc: np.ndarray, at: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of key, document and place, and the rows that each is matched with (see the module's second step).

    What repeats itself and goes on beyond what the other document has is matched with it anew once a block at most, and its end with
    the end there.
    """
    n = len(key)
    new_key, new_doc = np.ones(n, bool), np.ones(n, bool)
    new_key[1:] = key[1:] != key[:-1]
    new_doc[1:] = new_key[1:] | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new_doc)
    counts = np.diff(np.append(starts, n))
    group = np.cumsum(new_doc) - 1
    turn = np.arange(n) - starts[group]
    first = np.maximum.accumulate(np.where(new_key[starts], np.arange(len(starts)), 0))
    step = np.zeros(n, np.int64)
    step[1:] = at[1:] - at[:-1]
    again = (turn > 0) & (step < block)
    begins = np.flatnonzero(~again)  # of what repeats itself
    length = np.diff(np.append(begins, n))
    since = np.arange(n) - np.repeat(begins, length)
    ends = np.append(~again[1:], True)
    lead = length[np.searchsorted(begins, starts)]  # how often it repeats itself where it is first in a document
    rows, others = [], []
    for with_first in (True, False):
        i = np.flatnonzero(group > first[group] + (not with_first))
        other = first[group[i]] if with_first else group[i] - 1
        begin, held, t, u = starts[other], lead[other], turn[i], since[i]
        every = -(-block // np.maximum(held * step[i], 1))  # of so many rounds one is matched
        for chosen, there in (
            (t < counts[other], t),
            ((t > 0) & (u == 0), 0 * t),
            ((t > u) & (u > 0) & (u < held) | (u >= held) & (u // held % np.maximum(every, 1) == 0), u % held),
            ((u >= held) & ends[i], held - 1),
        ):
            rows.append(i[chosen])
            others.append((begin + there)[chosen])
    return np.concatenate(rows), np.concatenate(others)


def _matches(steps: list[int], blocks: bool, spread: int):
    """Rows sorted by seed, part, document and place: matches of the seeds and of the blocks that begin there.

    Of a seed with more than ``spread`` places in a part they are read by and by, behind the places in the smallest document and in the
    one before. The blocks of such a seed, and of one that has several parts, are handed on (kind 2), to be put in order by themselves.
    """
    block = steps[-1] + K
    names = [x.split()[0] for x in MATCHES.split(", ")]
    types = [pa.int64()] * 2 + [pa.int32()] * 3

    def found(rows: np.ndarray, hand_on: bool = False) -> Iterator[pa.RecordBatch]:
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)  # of rows with one id, places may come twice
        seed, part, doc, at, tail, known = rows[:, new]
        key = seed * np.int64(RANGES + 2) + part
        apart = (part >= 0) | hand_on
        i, j = _pairs(key, doc, at, block)
        i, j = i[known[i] == 0], j[known[i] == 0]
        parts = []
        if blocks:
            own = np.flatnonzero(apart & (tail > 0) & (known == 0))
            hashed = mixed(seed[own].view(np.uint64) + tail[own].astype(np.uint64))
            parts.append((doc[own], signed(hashed), at[own], at[own], np.full(len(own), 2)))
        if blocks and len(i):
            same = key[1:] == key[:-1]
            begins = np.flatnonzero(np.append(True, ~same))
            several = np.logical_or.reduceat(np.append(False, same & (doc[1:] != doc[:-1])), begins)
            own = np.flatnonzero(np.repeat(several, np.diff(np.append(begins, len(key)))) & (tail > 0) & ~apart)
            own = own[np.lexsort((at[own], doc[own], tail[own], key[own]))]
            x, y = _pairs(key[own] * np.int64(0x9E3779B1) + tail[own], doc[own], at[own], block)
            x, y = own[x], own[y]
            parts.append((doc[x], doc[y], at[x], at[y], np.ones(len(x), np.int64)))
            n = len(key)
            alone = ~np.isin(i * n + j, x * n + y)  # others are the beginning of a block
            i, j = i[alone], j[alone]
        parts.append((doc[i], doc[j], at[i], at[j], np.full(len(i), 0 if blocks else 1)))
        columns = [np.concatenate(c) for c in zip(*parts)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, wanted = [], 0, spread
        open_ = None  # places of the seed that goes on, in its smallest document and in the last
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in KNOWN]))
            size += batch.num_rows
            if size < wanted:
                continue
            rows = np.concatenate(kept, axis=1)
            if open_ is not None:
                end = _end_of(rows, open_)
                over = end < rows.shape[1]
                cut = end if over else _last_change(rows[:3])
                head, rows = rows[:, :cut], rows[:, cut:]
                if cut:
                    yield from found(np.concatenate([open_, head], axis=1), True)
                    open_ = _ends(np.concatenate([open_, head], axis=1))
                if over:
                    open_ = None
            if open_ is None:
                if cut := _last_change(rows[:2]):
                    yield from found(rows[:, :cut])
                elif cut := _last_change(rows[:3]):
                    yield from found(rows[:, :cut], True)
                    open_ = _ends(rows[:, :cut])
                rows = rows[:, cut:]
            kept, size = [rows], rows.shape[1]
            wanted = max(spread, 2 * size)  # a single document is read as a whole
        rows = np.concatenate(kept, axis=1) if kept else np.empty((len(KNOWN), 0), np.int64)
        if open_ is not None:
            cut = _end_of(rows, open_)
            yield from found(np.concatenate([open_, rows[:, :cut]], axis=1), True)
            rows = rows[:, cut:]
        if rows.shape[1]:
            yield from found(rows)

    return run


def _end_of(rows: np.ndarray, open_: np.ndarray) -> int:
    """How many rows go on with the seed and part of others."""
    return int(np.searchsorted((rows[:2] != open_[:2, :1]).any(axis=0), True))


def _last_change(rows: np.ndarray) -> int:
    """The last column that differs from the one before; 0 if there is none."""
    at = np.flatnonzero((rows[:, 1:] != rows[:, :-1]).any(axis=0))
    return int(at[-1]) + 1 if len(at) else 0


def _ends(rows: np.ndarray) -> np.ndarray:
    """Of places of one seed those in its smallest document and in the last, which are known from then on."""
    out = rows[:, (rows[2] == rows[2, 0]) | (rows[2] == rows[2, -1])]
    out[KNOWN.index("known")] = 1
    return out


def _frequent(rows: DataFrame, weight: int) -> DataFrame:
    """Seeds with many places and the bounds of ranges of documents that have about as many each."""
    shares = [i / RANGES for i in range(1, RANGES)]
    found = rows.groupBy("seed").agg(F.count("*").alias("n"), F.percentile_approx("doc", shares, 1000).alias("bounds"))
    return staged(found.where(F.col("n") * weight > FREQUENT).select("seed", F.array_distinct("bounds").alias("bounds")), "frequent")


def _in_order(placed: DataFrame, frequent: DataFrame, parts: int) -> DataFrame:
    """Places by seed, document and place, of a frequent seed by ranges of documents (part; else -1).

    A range begins with the places (known) in the smallest document of all that have the seed and in the last of the range before.
    """
    part = F.size(F.filter("bounds", lambda b: b < F.col("doc")))
    rows = placed.join(frequent, "seed", "left").withColumn("part", F.when(F.col("bounds").isNull(), -1).otherwise(part))
    dealt = rows.where("part >= 0")
    ranges = staged(dealt.groupBy("seed", "part").agg(F.min("doc").alias("low"), F.max("doc").alias("top")), "ranges")
    order = Window.partitionBy("seed").orderBy("part")
    before = ranges.select("seed", "part", F.first("low").over(order).alias("first"), F.lag("top").over(order).alias("top"))
    ahead = before.where("top is not null").select("seed", "part", F.explode(F.array_distinct(F.array("first", "top"))).alias("doc"))
    known = dealt.drop("part", "bounds").join(staged(ahead, "ahead"), ["seed", "doc"]).withColumn("known", F.lit(1))
    every = rows.withColumn("known", F.lit(0)).select(*KNOWN).unionByName(known.select(*KNOWN))
    return every.repartition(parts, "seed", "part").sortWithinPartitions("seed", "part", "doc", "at")


def chains(dp: list[int], fp: list[int], k: int = K, gap: float = GAP_COST) -> list[tuple[list[int], list[int]]]:
    """Split matches, ordered by ``dp`` then ``fp``, into chains that rise in both, best first.

    A match adds the words it covers newly; a gap costs ``gap`` for each word skipped in either text. The
    tree holds, by place in the first text, the best of score plus skipped words so far.
    """
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(fp)))}
    size = len(ranks)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, before = [0.0] * len(dp), [-1] * len(dp)
    waiting: list[int] = []
    for i, (d, f) in enumerate(zip(dp, fp)):
        if waiting and dp[waiting[-1]] < d:  # matches at one place do not follow each other
            for j in waiting:
                entry, r = (score[j] + gap * (dp[j] + fp[j]), j), ranks[fp[j]]
                while r <= size:
                    if entry > tree[r]:
                        tree[r] = entry
                    r += r & -r
            waiting = []
        best, r = (-1e18, -1), ranks[f] - 1
        while r:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        score[i] = float(k)
        if best[1] >= 0:
            j = best[1]
            new = min(k, d - dp[j], f - fp[j])
            linked = best[0] - gap * (d + f) + gap * 2 * new + new
            if linked > k:
                score[i], before[i] = linked, j
        waiting.append(i)
    used, out = [False] * len(dp), []
    for i in sorted(range(len(dp)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            path.reverse()
            out.append(([dp[i] for i in path], [fp[i] for i in path]))
    return out


def bridged(found: list[tuple[list[int], list[int]]], k: int = K) -> list[tuple[list[int], list[int]]]:
    """Join chains that follow each other in both texts; whether what lies between may differ is seen by alignment.

    Of the chains that end near before one, that of the nearest diagonal is joined, then the nearest, then the first.
    """
    reach = BRIDGE + k
    out: list[tuple[list[int], list[int]]] = []
    live: list[int] = []
    last = np.empty((2, len(found)), np.int64)  # ends of the live chains
    looked = 0
    for d, f in sorted(found):
        if len(live) >= looked:  # those behind are near nothing that follows
            stays = np.flatnonzero(d[0] - last[0, : len(live)] <= reach)
            last[:, : len(stays)] = last[:, stays]
            live = [live[x] for x in stays.tolist()]
            looked = 2 * len(live) + 16
        ahead, beyond = np.array([[d[0]], [f[0]]]) - last[:, : len(live)]
        near = np.flatnonzero((ahead > 0) & (ahead <= reach) & (beyond > 0) & (beyond <= reach))
        if len(near):
            ahead, beyond = ahead[near], beyond[near]
            at = int(near[(abs(ahead - beyond) * (reach + 1) + ahead).argmin()])
            out[live[at]][0].extend(d)
            out[live[at]][1].extend(f)
        else:
            at = len(live)
            live.append(len(out))
            out.append((list(d), list(f)))
        last[:, at] = d[-1], f[-1]
    return out


def _segments(batch: pa.Table, block: int) -> tuple[np.ndarray, ...]:
    """Matches as (doc, first, place, place there, words), merged where they touch, in order of doc, first and diagonal."""
    doc, first, d, f, kind = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "first", "at", "first_at", "kind"))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])
    pair = np.cumsum(new)
    order = np.lexsort((d, f - d, pair))
    pair, d, f, end = pair[order], d[order], f[order], (d + np.where(kind > 0, block, K))[order]
    apart = np.ones(len(d), bool)
    apart[1:] = (pair[1:] != pair[:-1]) | (np.diff(f - d) != 0)
    line = np.cumsum(apart) << 32
    reach = np.maximum.accumulate(line + end) - line  # where the matches before on the diagonal end, and this one
    apart[1:] |= d[1:] > reach[:-1]
    starts = np.flatnonzero(apart)
    ends = reach[np.append(starts[1:], len(d)) - 1]
    return doc[order][starts], first[order][starts], d[starts], f[starts], ends - d[starts]


def _solid(dp: list[int], fp: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Matches of ``K`` words in order, merged where they touch on a diagonal."""
    d, f = np.array(dp), np.array(fp)
    apart = np.ones(len(d), bool)
    apart[1:] = (np.diff(f - d) != 0) | (np.diff(d) > K)
    starts = np.flatnonzero(apart)
    size = d[np.append(starts[1:], len(d)) - 1] + K - d[starts]
    return d[starts].tolist(), f[starts].tolist(), size.tolist()


def _spread(d: np.ndarray, f: np.ndarray, size: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of ``K`` words that cover merged matches, in order of both texts."""
    count = -(-size // K)
    n = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    shift = np.minimum(n * K, np.repeat(size - K, count))
    d, f = np.repeat(d, count) + shift, np.repeat(f, count) + shift
    order = np.lexsort((f, d))
    return d[order].tolist(), f[order].tolist()


def _chained(block: int):
    """Rows sorted by document and first document: chains of at least two matches. A block is a match for each of its runs.

    Matches on one diagonal, none so far from the one before that they would not be bridged, are one chain for sure.
    """
    names = [x.split()[0] for x in CHAINS.split(", ")]
    types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 3

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, first, d, f, size = _segments(table, block)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(doc))
        bad = np.zeros(len(d), bool)
        bad[1:] = (np.diff(f - d) != 0) | (d[1:] - (d + size)[:-1] > BRIDGE)
        simple = ~np.logical_or.reduceat(bad & ~new, starts)
        several = d[ends - 1] + size[ends - 1] - d[starts] > K
        a, b = starts[simple & several], ends[simple & several]
        if len(a):
            rows = np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a) + np.arange((b - a).sum())
            offsets = pa.array(np.append(0, np.cumsum(b - a)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c[rows], pa.int32())) for c in (d, f, size)]
            flat = [doc[a], first[a], d[a], (d + size)[b - 1], f[a], (f + size)[b - 1]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(flat, types)], *lists], names=names)
        out = []
        for low, high in zip(starts[~simple].tolist(), ends[~simple].tolist()):
            for dp, fp in bridged(chains(*_spread(d[low:high], f[low:high], size[low:high]))):
                if len(dp) > 1:
                    out.append((int(doc[low]), int(first[low]), dp[0], dp[-1] + K, fp[0], fp[-1] + K, *_solid(dp, fp)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of the last group, which may go on
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, first = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc", "first"))
            if kept and (doc[0], first[0]) != key:
                yield from found(pa.Table.from_batches(kept))
                kept = []
            ends = np.flatnonzero((doc[1:] != doc[:-1]) | (first[1:] != first[:-1]))
            if len(ends):
                cut = int(ends[-1]) + 1
                yield from found(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept, batch = [], batch.slice(cut)
            kept.append(batch)
            key = doc[-1], first[-1]
        if kept:
            yield from found(pa.Table.from_batches(kept))

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of each wanted window of a document."""
    for batch in batches:
        ids, lows, highs, parts = [], [], [], []
        for doc_id, text, wanted in rows_of(batch, "doc_id", "text", "wanted"):
            own = signed(hashes(words(text))).astype(np.int32)
            for w in wanted:
                ids.append(doc_id)
                lows.append(w["low"])
                highs.append(w["high"])
                parts.append(own[w["low"] : w["high"]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32()), pa.array(parts, pa.list_(pa.int32()))],
            names=["id", "low", "high", "part"],
        )


def _gap(a: np.ndarray, b: np.ndarray) -> int:
    """Most words of ``a`` and ``b`` that agree in order."""
    if len(a) == len(b) and (same := int((a == b).sum())) * 2 >= len(a):
        return same
    row = [0] * (len(b) + 1)
    bs = b.tolist()
    for x in a.tolist():
        corner = 0
        for j, y in enumerate(bs):
            up = row[j + 1]
            row[j + 1] = corner + 1 if x == y else (up if up > row[j] else row[j])
            corner = up
    return row[-1]


def _reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two texts go on alike, and how many words agree."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    if not n:
        return 0, 0
    low = np.flatnonzero(np.maximum(np.maximum.accumulate(score), 0) - score > DROP)
    end = int(low[0]) if len(low) else n
    if not end or (best := int(score[:end].argmax())) < 0 or score[best] <= 0:
        return 0, 0
    return best + 1, int(same[: best + 1].sum())


def _whole(runs: list[list[int]], left: tuple[int, int], right: tuple[int, int], least: int, percent: int):
    """The longest passage of all runs, with what their ends reach or without; None if there is none."""
    d0, f0, d1, f1 = runs[0][0], runs[0][2], runs[-1][1], runs[-1][3]
    total = sum(r[4] + r[5] for r in runs) - runs[0][5] - runs[0][6]
    found = None
    for x, y in ((1, 1), (1, 0), (0, 1), (0, 0)):
        ends = d0 - x * left[0], d1 + y * right[0], f0 - x * left[0], f1 + y * right[0]
        agree, size = total + x * left[1] + y * right[1], ends[1] - ends[0]
        if size >= least and 100 * agree >= percent * max(size, ends[3] - ends[2]) and (not found or size > found[1] - found[0]):
            found = (*ends, agree)
    return found


def align(
    dw: np.ndarray, fw: np.ndarray, dp: list[int], fp: list[int], sizes: list[int] | None = None, least: int = LEAST_WORDS, percent: int = PERCENT
) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, start in first, end there, words that agree) around the matches of a chain, of ``K`` or the given words.

    The chain is cut at every gap with a word that differs. Of all joined pieces, the longest with ``least`` words of which
    ``percent`` agree is a passage, and so on to both sides of it.
    """
    sizes = sizes or [K] * len(dp)
    k = sizes[0]
    runs = [[dp[0], dp[0] + k, fp[0], fp[0] + k, k, 0, 0]]  # ends, words that agree, of the gap before, covered by the run before
    for d, f, k in zip(dp[1:], fp[1:], sizes[1:]):
        run = runs[-1]
        skip = max(0, run[1] - d, run[3] - f)  # words of the match that the run covers
        if skip >= k:
            continue
        a, b = dw[run[1] : d + skip], fw[run[3] : f + skip]
        agree, most = _gap(a, b) if len(a) and len(b) else 0, max(len(a), len(b))
        if most > agree:
            runs.append([d, d + k, f, f + k, k - skip, agree, skip])
        else:
            run[4] += agree + k - skip
            run[1], run[3] = d + k, f + k
    ends = [_reach(dw[: dp[0]][::-1], fw[: fp[0]][::-1]), _reach(dw[runs[-1][1] :], fw[runs[-1][3] :])]
    if found := _whole(runs, *ends, least, percent):
        return [found]
    if len(runs) == 1:
        return []
    room, none = MARGIN + CUT, (0, 0)
    lows, highs = [none, *[(r[1], r[3]) for r in runs]], [*[(r[0], r[2]) for r in runs[1:]], (len(dw), len(fw))]
    left = np.array([_reach(dw[x:d0][::-1], fw[y:f0][::-1]) for (x, y), (d0, _, f0, *_) in zip(lows, runs)])
    right = np.array([_reach(dw[d1:x], fw[f1:y]) for (x, y), (_, d1, _, f1, *_) in zip(highs, runs)])
    d0, d1, f0, f1, n, before, skip = np.array(runs).T
    total = np.cumsum(n + before)
    inner = total - n - skip  # what the pieces before add to the total of those that start here
    out, todo = [], [(0, len(runs))]
    while todo:
        low, high = todo.pop()
        found = None
        for m in range(high - low, 0, -1):
            i = np.arange(low, high - m + 1)
            j = i + m - 1
            most, core = total[j] - inner[i] + left[i, 1] + right[j, 1], np.maximum(d1[j] - d0[i], f1[j] - f0[i])
            i = i[(100 * most >= percent * core) & (d1[j] - d0[i] + left[i, 0] + right[j, 0] >= least)]  # others fail with any ends
            if not len(i):
                continue
            j = i + m - 1
            for x, y in ((1, 1), (1, 0), (0, 1), (0, 0)):
                ends = d0[i] - x * left[i, 0], d1[j] + y * right[j, 0], f0[i] - x * left[i, 0], f1[j] + y * right[j, 0]
                agree = total[j] - inner[i] + x * left[i, 1] + y * right[j, 1]
                size = ends[1] - ends[0]
                fits = np.flatnonzero((size >= least) & (100 * agree >= percent * np.maximum(size, ends[3] - ends[2])))
                if len(fits):
                    best = fits[size[fits].argmax()]
                    if not found or size[best] > found[1] - found[0]:
                        found, at = (*[int(e[best]) for e in ends], int(agree[best])), int(i[best])
            if found:
                out.append(found)
                todo += [(low, at), (at + m, high)]
                break
    for a, b, x, y, n, _, skip in runs:  # those in none of them may reach into what the chain has beside them
        if not any(start <= a and b <= end for start, end, *_ in out):
            ends = _reach(dw[max(0, a - room) : a][::-1], fw[max(0, x - room) : x][::-1]), _reach(dw[b : b + room], fw[y : y + room])
            if found := _whole([[a, b, x, y, n + skip, 0, 0]], *ends, least, percent):
                out.append(found)
    return sorted(out)


def _end_reach(d: np.ndarray, f: np.ndarray, d_at: np.ndarray, f_at: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """``_reach`` from a place of each chain in steps of 1 or -1, up to ``room`` words, for all chains at once."""
    width = int(room.max(initial=0))
    if not width:
        return np.zeros(len(room), np.int64)
    j = np.arange(width)
    inside = j < room[:, None]
    i = np.where(inside, d_at[:, None] + step * j, 0)
    k = np.where(inside, f_at[:, None] + step * j, 0)
    score = np.where(inside, np.where(d[i] == f[k], 1, -2), -width * 4).cumsum(axis=1)
    low = np.maximum(np.maximum.accumulate(score, axis=1), 0) - score > DROP
    score[np.maximum.accumulate(low, axis=1)] = -1
    best = score.argmax(axis=1)
    return np.where(score[np.arange(len(room)), best] > 0, best + 1, 0)


def _hopeful(batch: pa.RecordBatch, least: int) -> np.ndarray:
    """Chains that could be passages: with all that their ends reach they have ``least`` words. No piece of a chain reaches further."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    number = lambda c: column(c).to_numpy().astype(np.int64)
    parts, bounds = {}, {}
    for side in "df":
        words_of = column(f"{side}_part")
        parts[side], offsets = words_of.values.to_numpy(), words_of.offsets.to_numpy().astype(np.int64)
        bounds[side] = offsets[:-1], offsets[1:]
    at = {c: bounds[c[0]][0] + number(c) - number(f"{c[0]}_low") for c in ("d0", "d1", "f0", "f1")}
    before = np.minimum(at["d0"] - bounds["d"][0], at["f0"] - bounds["f"][0])
    after = np.minimum(bounds["d"][1] - at["d1"], bounds["f"][1] - at["f1"])
    left = _end_reach(parts["d"], parts["f"], at["d0"] - 1, at["f0"] - 1, before, -1)
    right = _end_reach(parts["d"], parts["f"], at["d1"], at["f1"], after, 1)
    return number("d1") - number("d0") + left + right >= least


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The lists of a column, without a Python value for each element."""
    column = batch.column(batch.schema.get_field_index(name))
    offsets = column.offsets.to_pylist()
    values = column.values.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def _aligned(least_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            batch = batch.filter(pa.array(_hopeful(batch, least_words)))
            rows = []
            flat = rows_of(batch, "doc", "first", "d_low", "f_low")
            for (doc, first, d_low, f_low), *lists in zip(flat, *[_lists(batch, c) for c in ("dp", "fp", "size", "d_part", "f_part")]):
                dp, fp, size, dw, fw = lists
                found = align(dw, fw, (dp - d_low).tolist(), (fp - f_low).tolist(), size.tolist(), least_words, percent)
                for d0, d1, f0, f1, n in found:
                    rows.append((doc, d0 + d_low, d1 + d_low, first, f0 + f_low, f1 + f_low, n))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SPANS.split(", ")]
            )

    return run


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and place in others: those not inside a passage reported before for the document."""
    at, starts, ends = None, [], []  # of passages of which none lies inside another
    for batch in batches:
        keep = []
        for doc_id, start, end in rows_of(batch, "doc_id", "start_word", "end_word"):
            if doc_id != at:
                at, starts, ends = doc_id, [], []
            i = bisect_right(starts, start)
            keep.append(not (i and ends[i - 1] >= end))
            if keep[-1]:
                low, high = bisect_left(starts, start), bisect_right(ends, end)
                starts[low : max(low, high)], ends[low : max(low, high)] = [start], [end]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _with_windows(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Add the words around a chain in both of its documents; texts are moved once for all windows wanted of them."""
    sides = {"d": "doc", "f": "first"}
    for side in sides:
        low = (F.greatest(F.lit(0), F.col(f"{side}0") - MARGIN) / CUT).cast("int") * CUT
        high = (F.ceil((F.col(f"{side}1") + MARGIN) / CUT) * CUT).cast("int")
        rows = rows.withColumn(f"{side}_low", low).withColumn(f"{side}_high", high)
    rows = staged(rows, "chains")
    window = {s: F.struct(F.col(f"{s}_low").alias("low"), F.col(f"{s}_high").alias("high")).alias("w") for s in sides}
    windows = [rows.select(F.col(doc).alias("doc_id"), window[s]) for s, doc in sides.items()]
    wanted = windows[0].unionByName(windows[1]).groupBy("doc_id").agg(F.collect_set("w").alias("wanted"))
    # neither side has a bound, so they are merged at every size
    texts = whole.join(staged(wanted, "wanted").hint("merge"), "doc_id")
    cut = staged(texts.mapInArrow(_windows, "id long, low int, high int, part array<int>"), "windows")
    for side, doc in sides.items():
        named = cut.select(
            F.col("id").alias(doc), F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high"), F.col("part").alias(f"{side}_part")
        )
        rows = staged(rows, "chains") if side == "f" else rows
        rows = rows.join(named.hint("merge"), [doc, f"{side}_low", f"{side}_high"])
    return rows


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Passages of ``docs`` that an earlier document (smaller ``doc_id``) has as well, give or take some words.

    Rows (doc_id, start_word, end_word, first_doc_id, first_start, first_end, n_match). Repeats within
    one document do not count. A passage inside one that a smaller document has is reported once. Texts that are NULL or shorter
    than a passage, and rows without id, have none; of rows with one id the passages of one are reported.
    """
    spark = docs.sparkSession
    whole, steps = keyed(docs), _steps(least_words)
    parts = max(8, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = staged(whole.mapInArrow(_places(steps), PLACES), "places")
    ordered = _in_order(placed.where("at >= 0"), _frequent(placed.where("at < 0"), NTH), parts)
    matched = staged(ordered.mapInArrow(_matches(steps, True, SPREAD), MATCHES), "matches")
    blocks = matched.where("kind = 2").select(F.col("first").alias("seed"), "doc", "at", F.lit(0).alias("block"))
    ordered = _in_order(blocks, _frequent(blocks, 1), parts)
    matched = matched.where("kind < 2").unionByName(ordered.mapInArrow(_matches(steps, False, SPREAD), MATCHES))
    linked = (
        matched.repartition(parts, "doc").sortWithinPartitions("doc", "first", "at", "first_at")
        .mapInArrow(_chained(steps[-1] + K), CHAINS)
    )
    spans = _with_windows(linked, whole).mapInArrow(_aligned(least_words, percent), SPANS)
    order = ["doc_id", "first_doc_id", "first_start", "start_word", "end_word", "first_end", "n_match"]
    return spans.repartition(parts, "doc_id").sortWithinPartitions(*order).mapInArrow(_uncovered, SPANS)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = starts[min(a, len(starts) - 1)], starts[min(b, len(starts) - 1)]
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join(out) + text[at:]


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the passages that an earlier document has; ``n_chars``, if there, is counted anew.

    A document of which nothing but white space is left goes; those without such passages stay as they are.
    """
    drop = "spans"
    while drop in docs.columns:
        drop += "_"
    found = repeated_passages(docs, **options).groupBy("doc_id").agg(
        F.collect_set(F.struct("start_word", "end_word")).alias(drop)
    )
    joined = docs.join(staged(found, "spans"), "doc_id", "left")
    schema = joined.drop(drop).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            spans, texts = columns.pop(drop).to_pylist(), columns["text"].to_pylist()
            sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
            keep = [True] * len(texts)
            for i, own in enumerate(spans):
                if own and texts[i]:
                    texts[i] = without_words(texts[i], [(s["start_word"], s["end_word"]) for s in own])
                    keep[i] = bool(_WORD.search(texts[i]))
                    if sizes:
                        sizes[i] = len(texts[i])
            columns["text"] = pa.array(texts, pa.string())
            if sizes:
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in docs.columns])
