"""Maximal periodic runs of words.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``max(LEAST, 2 * q)`` words
long, that no neighbouring word extends at that period. They are found text by text, in two steps:

1. Frequency splitting. A run holds each of its words at least twice, so a word that occurs once in the current segment
   lies in no run there and splits it. What is left between such words is judged anew by its own counts,
   until nothing changes; segments shorter than ``LEAST`` go. Most prose ends here.
2. Lag scan of the segments that survive. Lags are taken by powers of two. In a run of lag q, at least ``max(q, LEAST - q)``
   words in a row equal the word q later, so an aligned block of about half a lag equals the block q later. Blocks
   are compared by exact names (ranks of all stretches of a power of two of words, each made of two
   names of half that length), equal ones are extended to both sides by descending through the names, and
   stretches that are long enough are runs. That is O(n log n) names and candidates for n words of a segment, however
   repetitive they are.

Of the same stretch found at several lags the smallest is the period: a stretch of two periods has no other period
than multiples of the smallest one (Fine and Wilf), and then both stretches are the same.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from millrace.llm.storage import keyed
from millrace.llm.words import rows_of

LEAST = 12
OFTEN = 6  # periods of a run inside which multiples of its period are not scanned again
TWICE = 2  # occurrences that a run needs of each of its words


class Run(NamedTuple):
    start: int
    length: int
    period: int


def words(text: str | None) -> list[bytes]:
    """Words of a text as they stand; none for NULL."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbered(tokens: list[bytes]) -> np.ndarray:
    """The same small number for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, len(tokens))


def segments(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least ``least`` words in which every word occurs twice or more."""
    found, open_ = [], [(0, len(ids))]
    while open_:
        start, end = open_.pop()
        if end - start < least:
            continue
        _, places, counts = np.unique(ids[start:end], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[places] < TWICE)
        if not len(rare):
            found.append((start, end))
            continue
        edges = np.concatenate([[-1], rare, [end - start]])
        long = np.flatnonzero(np.diff(edges) > least)
        open_ += [(start + int(edges[i]) + 1, start + int(edges[i + 1])) for i in long]
    return sorted(found)


def _names(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to ``longest``, a number for every stretch of so many words; equal ones have the same."""
    names = [np.unique(ids, return_inverse=True)[1]]
    half = 1
    while 2 * half <= longest:
        last = names[-1]
        pairs = last[:-half] * np.int64(len(ids) + 1) + last[half:]
        names.append(np.unique(pairs, return_inverse=True)[1])
        half *= 2
    return names


def _after(names: list[np.ndarray], i: np.ndarray, lag: np.ndarray, n: int) -> np.ndarray:
    """Where equality with the word ``lag`` later ends, from each place of ``i`` on."""
    at = i.copy()
    for level in range(len(names) - 1, -1, -1):
        size, name = 1 << level, names[level]
        while True:  # the highest level may fit more than once
            fits = at + lag + size <= n
            go = np.flatnonzero(fits)
            go = go[name[at[go]] == name[at[go] + lag[go]]]
            at[go] += size
            if level < len(names) - 1 or not len(go):
                break
    return at


def _before(names: list[np.ndarray], i: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """The first place of the stretch before each of ``i`` that equals the words ``lag`` later."""
    at = i.copy()
    for level in range(len(names) - 1, -1, -1):
        size, name = 1 << level, names[level]
        while True:
            go = np.flatnonzero(at >= size)
            go = go[name[at[go] - size] == name[at[go] - size + lag[go]]]
            at[go] -= size
            if level < len(names) - 1 or not len(go):
                break
    return at


def scan(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """Runs of one segment, by lag."""
    n = len(ids)
    names = _names(ids, max(2, n // 2))
    found: list[np.ndarray] = []
    covered, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # end and period of a run around a place
    low = 1
    while 2 * low <= n:
        lags = np.arange(low, min(2 * low, n // 2 + 1))
        equal = max(low, (least + 1) // 2)  # words in a row that equal the one a lag later, at the least
        level = ((equal + 1) // 2).bit_length() - 1  # an aligned block of this power of two lies among them
        block = 1 << level
        starts = np.arange(0, n - block + 1, block)
        name = names[level]
        where, which = np.divmod(np.arange(len(starts) * len(lags)), len(lags))
        i, lag = starts[where], lags[which]
        fits = i + lag + block <= n
        i, lag = i[fits], lag[fits]
        new = (i + lag + block > covered[i]) | (lag % period[i] != 0)  # else the run known there, at a multiple of its period
        i, lag = i[new], lag[new]
        same = name[i] == name[i + lag]
        i, lag = i[same], lag[same]
        if len(i):
            start, end = _before(names, i, lag), _after(names, i + block, lag, n) + lag
            long = end - start >= np.maximum(least, 2 * lag)
            found.append(np.unique(np.stack([start[long], end[long] - start[long], lag[long]], axis=1), axis=0))
            for s, length, lag in found[-1].tolist():
                if length >= OFTEN * lag and (better := covered[s : s + length] < s + length).any():
                    covered[s : s + length][better] = s + length
                    period[s : s + length][better] = lag
        low *= 2
    runs: dict[tuple[int, int], int] = {}
    for start, length, lag in (row for level in found for row in level.tolist()):
        runs.setdefault((start, length), lag)  # in ascending order of lags
    return [Run(start, length, lag) for (start, length), lag in runs.items()]


def runs(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """All runs of a text's words, by start, then period."""
    found = [Run(start + r.start, r.length, r.period) for start, end in segments(ids, least) for r in scan(ids[start:end], least)]
    return sorted(found, key=lambda r: (r.start, r.period))


def collapsed(n: int, found: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period alone."""
    ends = np.zeros(n + 1, np.int64)
    for r in found:
        ends[r.start + r.period] += 1
        ends[r.start + r.length] -= 1
    return np.cumsum(ends[:n]) == 0


def planted(tokens: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one document in ten with a repeated ending, as the query's contract has it; none without id."""
    n = len(tokens)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return tokens
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return tokens[:a] + [tokens[a + (i - a) % p] for i in range(a, n)]


_LONGS = ("n_runs", "start", "length", "period", "exponent_milli")
SCHEMA = StructType()
for _name in ("doc_id", *_LONGS):
    SCHEMA.add(_name, LongType())
for _name in ("runs_sha256", "collapsed_sha256"):
    SCHEMA.add(_name, StringType())


def digest(tokens: list[bytes], least: int = LEAST) -> tuple:
    """Number of runs, the longest one, and hashes of all runs and of the words that stay."""
    found = runs(numbered(tokens), least) if len(tokens) >= least else []
    listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
    kept = tokens
    if found:
        kept = [tokens[i] for i in np.flatnonzero(collapsed(len(tokens), found)).tolist()]
    hashes = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()
    if not found:
        return 0, None, None, None, None, *hashes
    top = min(found, key=lambda r: (-r.length, r.start, r.period))
    return len(found), *top, 1000 * top.length // top.period, *hashes


def periodic_runs(docs: DataFrame, plant: bool = False, least: int = LEAST) -> DataFrame:
    """One row for each row of ``docs``: its runs in short, see ``digest``.

    NULL and empty texts have no runs. Texts need some 100 bytes of memory for each word of their longest surviving
    segment. With ``plant`` the words are first changed as ``planted`` says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                tokens = words(text)
                rows.append((doc_id, *digest(planted(tokens, doc_id) if plant else tokens, least)))
            columns = [pa.array(c, pa.string() if i > 5 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names=SCHEMA.names)

    return keyed(docs).mapInArrow(run, SCHEMA)


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with each run in ``text`` cut to its first period; words are then joined by one space.

    Texts without runs, and NULL ones, stay as they are; all other columns too.
    """
    schema = docs.schema

    def cut(text: str | None) -> str | None:
        tokens = words(text)
        found = runs(numbered(tokens), least) if len(tokens) >= least else []
        if not found:
            return text
        kept = np.flatnonzero(collapsed(len(tokens), found)).tolist()
        return b" ".join(tokens[i] for i in kept).decode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([cut(text) for (text,) in rows_of(batch, "text")], batch.schema.field(at).type)
            yield batch.set_column(at, "text", texts)

    return docs.mapInArrow(run, schema)
