"""Read, filter, group, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace.sources.tables import write_parquet


def filter_group_count(df: DataFrame, condition: Column, key: str, count: str = "count") -> DataFrame:
    return df.where(condition).groupBy(key).agg(F.count(F.lit(1)).alias(count))


def filter_group_count_job(spark: SparkSession, source: str, target: str, condition: Column, key: str) -> dict:
    """One job: rows read, rows kept and groups written are observed while it runs, not recounted."""
    read, kept, groups = Observation("read"), Observation("kept"), Observation("groups")
    n = F.count(F.lit(1)).alias("n")
    df = spark.read.parquet(source).observe(read, n)
    filtered = df.where(condition).observe(kept, n)
    result = filtered.groupBy(key).agg(F.count(F.lit(1)).alias("count")).observe(groups, n)
    write_parquet(result, target)
    return {"rows_read": read.get["n"], "rows_kept": kept.get["n"], "groups": groups.get["n"]}
