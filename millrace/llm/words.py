"""Words, word hashes and word shingles of whole texts, as arrays inside tasks.

Words are runs of characters other than ASCII white space; A-Z are folded to a-z. All hashes are 64
bits wide and depend on the words alone, so every task and every run agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None) -> list[bytes]:
    """Folded words of a text; none for NULL. Bytes fold and split by ASCII rules only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX[0]
    values = values ^ (values >> np.uint64(27))
    values = values * _MIX[1]
    return values ^ (values >> np.uint64(31))


def grams(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, by the run's first word."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = word_hashes[:n].copy()
    for i in range(1, k):
        out *= _MULTIPLIER
        out += word_hashes[i : i + n]
    return mixed(out)


def shingles(word_hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Runs of ``k`` words in text order; a shorter text is one run of all its words."""
    return grams(word_hashes, min(k, len(word_hashes))) if len(word_hashes) else grams(word_hashes, k)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingles."""
    return np.unique(shingles(hashes(words(text)), k))


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark's BIGINT."""
    return values.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for work whose memory grows with the texts of a batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values."""
    return zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True)
