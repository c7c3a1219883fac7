"""Prefix signatures of sets for Jaccard joins, with token combinations for frequent tokens.

All sets order their tokens alike: rare ones first, then frequent ones, each by hash. Two sets that
reach the threshold share at least ``c`` tokens within prefixes of ``n - ceil(t * n) + c`` tokens.

* A prefix of rare tokens only is extended to ``c = 1 + n // 25`` and indexed token by token; two such sets
  must meet in ``min(c, c')`` signatures.
* Otherwise frequent tokens are dealt into ``g`` classes by hash and indexed as pairs within a class. With
  prefixes extended by ``g``, two sets that share no rare token there share ``g + 1`` frequent ones, so
  two of one class; they must meet in one signature. ``g`` follows the larger set's size by powers of
  two, so a set is indexed for its own size and for that of the largest set it could be similar to.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.words import mixed

_PAIR_SALT = np.uint64(0x9A1)


def _ceil(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def classes(n: int) -> int:
    """Number of frequent-token classes for sets of about ``n`` tokens."""
    return 1 << max(0, (n // 12).bit_length() - 1)


def _pairs(tokens: np.ndarray, g: int) -> np.ndarray:
    """Hashes of all token pairs of equal class."""
    cls = (tokens >> np.uint64(20)) & np.uint64(g - 1)
    order = np.lexsort((tokens, cls))
    tokens, cls = tokens[order], cls[order]
    found = []
    for gap in range(1, len(tokens)):
        same = cls[gap:] == cls[:-gap]
        if not same.any():
            break
        a, b = tokens[:-gap][same], tokens[gap:][same]
        found.append(mixed(a * np.uint64(3) + mixed(b + _PAIR_SALT + np.uint64(g))))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Signatures of a sorted token set and how many of them a similar set shares at least.

    ``frequent`` is the sorted list of frequent tokens; an empty set has no signature.
    """
    n = len(tokens)
    if n < 2:  # similar to equal sets only
        return tokens, 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        is_frequent = frequent[at] == tokens
    else:
        is_frequent = np.zeros(n, bool)
    rare, often = tokens[~is_frequent], tokens[is_frequent]
    base, c = n - _ceil(n, percent) + 1, 1 + n // 25
    if len(rare) >= base + c - 1:
        return rare[: base + c - 1], c
    largest = n * 100 // percent
    found = [rare[: base + classes(largest)]]
    for g in {classes(n), classes(largest)}:
        found.append(_pairs(often[: max(0, base + g - len(rare))], g))
    return np.concatenate(found), 1
