"""Token counts of whole texts, without encoding any of them.

A byte-level tokenizer cuts a text into pre-tokens and each pre-token into pieces on its own, so a text has as
many tokens as its pre-tokens have pieces.

1. Tasks count the pre-tokens of their documents; the distinct ones are gathered by a map-side-combined
   aggregation, and the tokenizer's model cuts each of them once (``piece_counts``).
2. A document's row is its pre-tokens with their frequencies. The most frequent pre-tokens are looked up in a broadcast
   list of at most ``COMMON_BYTES``, whatever the corpus holds; this also takes the hot keys out of the join.
   All others are joined by pre-token and summed by document.

Equal rows are summed once and returned as often as they came. NULL text counts as empty, and an
empty text has no tokens. NULL ids are ids like any other.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from millrace.llm.storage import keyed, staged
from millrace.llm.words import rows_of

LIMIT = 1024
COMMON_BYTES = 8 << 20  # bound of the broadcast list: UTF-8 bytes and 16 more for each pre-token
TASK_PIECES = 1 << 17  # distinct pre-tokens a task gathers before it hands them on
TASK_ROWS = 1 << 16  # rows of a batch handed to Spark


def default_path() -> str:
    """Byte-level BPE of some 50,000 pieces from the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _unsettled() -> re.Pattern:
    """Characters beyond the basic plane, and those that Unicode 3.2 did not have or classed otherwise; on all others
    libraries of any version agree."""
    old, runs = unicodedata.ucd_3_2_0, []

    def settled(c: int) -> bool:
        kind = old.category(chr(c))
        return kind != "Cn" and kind == unicodedata.category(chr(c))

    for ok, run in groupby(range(0x10000), settled):
        if not ok:
            codes = list(run)
            runs.append(f"\\u{codes[0]:04X}-\\u{codes[-1]:04X}")
    return re.compile(f"[{''.join(runs)}\\U00010000-\\U0010FFFF]")  # this library's sets are bitmaps


class PreTokens:
    """Pre-tokens of texts, and the number of pieces of a pre-token, by the library's own parts.

    The tokenizer must be a ``.json`` file with a byte-level pre-tokenizer, no normalizer, and added tokens that match
    as they stand; another one is refused, since its pre-tokens may depend on one another. An added token in a text
    is one token, as the library has it by default.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        added = list(tokenizer.get_added_tokens_decoder().values())
        plain = isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and tokenizer.pre_tokenizer.use_regex
        if not plain or tokenizer.pre_tokenizer.add_prefix_space or tokenizer.normalizer is not None:
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        if any(a.lstrip or a.rstrip or a.single_word for a in added):
            raise ValueError(f"added tokens that reach beyond their text: {path}")
        self._model = tokenizer.model
        self._library = tokenizer.pre_tokenizer
        self._bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.added = frozenset(a.content for a in added)
        longest_first = sorted(self.added, key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        self._unsettled = _unsettled()

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and self._unsettled.search(text):
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self._pattern.findall(text)

    def cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self._added or not self._added.search(text):
            return self._plain(text)
        found, at = [], 0
        for match in self._added.finditer(text):
            found += self._plain(text[at : match.start()])
            found.append(match.group())
            at = match.end()
        return found + self._plain(text[at:])

    def pieces(self, token: str) -> int:
        if token in self.added:
            return 1
        return sum(len(self._model.tokenize(mapped)) for mapped, _ in self._bytes.pre_tokenize_str(token))


@cache
def pre_tokens(path: str) -> PreTokens:
    """One tokenizer for each worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PreTokens(path)


def _gathered(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (token, n): counts of pre-tokens within a task, of equal texts together."""

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        tokens, numbers = list(counts), list(counts.values())
        for i in range(0, len(tokens), TASK_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[i : i + TASK_ROWS], pa.string()), pa.array(numbers[i : i + TASK_ROWS], pa.int64())], names=["token", "n"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = pre_tokens(path).cut, Counter()
        for batch in batches:
            for (text,) in rows_of(batch, "text"):
                counts.update(cut(text))
                if len(counts) >= TASK_PIECES:
                    yield from rows(counts)
                    counts = Counter()
        yield from rows(counts)

    return run


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """Every distinct pre-token once: ``token``, its occurrences ``n`` in all texts, and its ``pieces``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pre_tokens(path).pieces
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("token"))
            yield pa.RecordBatch.from_arrays(
                [column, batch.column(batch.schema.get_field_index("n")), pa.array(map(pieces, column.to_pylist()), pa.int64())],
                names=["token", "n", "pieces"],
            )

    found = docs.select("text").mapInArrow(_gathered(path), "token string, n long")
    distinct = found.groupBy("token").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(counted, "token string, n long, pieces long")


def common_tokens(counted: DataFrame, most_bytes: int = COMMON_BYTES) -> tuple[dict[str, int], int]:
    """Pieces of the most frequent pre-tokens, and the occurrences from which a pre-token is among them.

    A histogram of occurrences (a few hundred rows, by eighths of powers of two) gives the lowest bound whose
    pre-tokens fit in ``most_bytes``; only those reach the driver.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    weight = F.sum(F.octet_length("token") + 16).alias("bytes")
    rows = counted.groupBy(step.alias("step")).agg(weight, F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, used = None, 0
    for row in rows:
        used += row["bytes"]
        if used > most_bytes:
            break
        least = row["least"]
    if least is None:
        return {}, 1 << 62
    return {r[0]: r[1] for r in counted.where(F.col("n") >= least).select("token", "pieces").toLocalIterator()}, least


def _frequencies(path: str, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, h, n_bytes, token, n), h a hash of the text: one with ``n_bytes`` for each text, whose n is the pieces
    of its common pre-tokens, and one for each other distinct pre-token with its frequency."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, common = pre_tokens(path).cut, shared.value
        columns: list[list] = [[] for _ in kinds]

        def rows() -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "n_bytes", "token", "n"])

        for batch in batches:
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                own = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                known, rest, counts = 0, [], []
                for token, n in Counter(cut(text)).items():
                    pieces = common.get(token)
                    if pieces is None:
                        rest.append(token)
                        counts.append(n)
                    else:
                        known += pieces * n
                size = len(rest) + 1
                # the first row meets no partner; its key spreads it all the same
                parts = [doc_id] * size, [own] * size, [len(data)] + [None] * (size - 1), [str(own), *rest], [known, *counts]
                for column, part in zip(columns, parts, strict=True):
                    column += part
                if len(columns[0]) >= TASK_ROWS:
                    yield rows()
                    columns = [[] for _ in kinds]
        yield rows()

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, most_bytes: int = COMMON_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) for every row of ``docs``."""
    path = path or default_path()
    docs = keyed(docs)
    counted = staged(piece_counts(docs, path), "pieces")
    common, least = common_tokens(counted, most_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(common)
    found = docs.mapInArrow(_frequencies(path, shared), "doc_id long, h long, n_bytes long, token string, n long")
    rare = counted.where(F.col("n") < least).select("token", "pieces", F.lit(True).alias("rare"))
    joined = found.withColumn("rare", F.isnull("n_bytes")).join(rare, ["token", "rare"], "left")
    sums = joined.groupBy("doc_id", "h").agg(
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("total"),
        F.count("n_bytes").alias("copies"),
    )
    each = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    n_tokens = F.expr("total div copies").alias("n_tokens")
    return each.select("doc_id", "n_bytes", n_tokens).withColumn("over_limit", F.col("n_tokens") > limit)
