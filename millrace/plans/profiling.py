"""Column profiles of table files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.combine import union_same
from millrace.operators.profile import column_profile
from millrace.sources.tables import write_parquet


def profile_tables(spark: SparkSession, paths: Sequence[str], approximate: bool = False) -> DataFrame:
    """The profile of each table with its path in ``source``."""
    return union_same(
        [column_profile(spark.read.parquet(p), approximate=approximate).withColumn("source", F.lit(p)) for p in paths]
    )


def profile_job(spark: SparkSession, paths: Sequence[str], target: str, approximate: bool = False) -> None:
    write_parquet(profile_tables(spark, paths, approximate), target)
