"""The corpus pipeline: documents of a known language, one of each group of near copies, without repeated
passages and without benchmark items, mixed to target weights.

A stage takes the documents that its predecessor kept, as written and read again. All but the last
return the columns of documents; the last returns a row for each copy that the mix takes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, jaccard, langid, mixing, passages
from millrace.session import delete_path, drop_staged, staged_so_far, work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_made = [0, 0]  # marks around the tables that the latest stage has staged


def _tidy(stage: Stage) -> Stage:
    """Delete what the stage before has staged: its result has been written by now."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_staged(spark, *_made)
        start = staged_so_far()
        out = stage(spark, docs, sf_dir)
        _made[:] = start, staged_so_far()
        return out

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language cannot be told, go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    return jaccard.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the later ones."""
    return passages.drop_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each copy taken."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", _tidy(language)),
    ("n-gram Jaccard join", _tidy(near_duplicates)),
    ("substring dedup", _tidy(repeats)),
    ("benchmark decontamination", _tidy(contamination)),
    ("mixing sources to target weights", _tidy(mixture)),
]

ORACLE_SQL = None  # a fitted model and fuzzy searches: tests compare the stages with brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = work_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:  # its reader has ended
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
