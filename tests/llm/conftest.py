from __future__ import annotations

import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
     StructField("source", StringType()), StructField("n_chars", LongType()), StructField("size", StringType())]
)


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("aeioubcdfgklmnprst") for _ in range(r.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang, source]) as a table of documents with one more column of a likely name."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """NULLs in every column, empty and blank texts, a repeated row, a very long text, one word."""
    long = " ".join(prose(1, 30_000))
    return make_docs([
        (1, None), (2, ""), (3, " \t\n"), (None, "one two three four five six"), (None, None, None, None), (4, "word", "en", "a"),
        (5, long, "en", "b"), (5, long, "en", "b"), (6, long, None, "b"), (7, "ß É 漢字   ９ the the the the", "de", None), (8, "...", "fr", "a"),
    ])
