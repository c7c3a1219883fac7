"""Finding files, what their paths say, and an inventory of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.text import in_gb, in_mb, path_facts
from millrace.sources.inventory import file_inventory


def read_found(spark: SparkSession, root: str, name_glob: str = "*.parquet") -> DataFrame:
    """Every matching Parquet file below ``root``, with its path in ``source_path``."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).parquet(root)
    return found.withColumn("source_path", F.col("_metadata.file_path"))


def with_path_facts(df: DataFrame, path: str = "source_path") -> DataFrame:
    return df.withColumns(path_facts(F.col(path)))


def file_sizes(spark: SparkSession, root: str, name_glob: str = "*") -> DataFrame:
    """(path, size_bytes, size_mb, size_gb, extension, directory); file contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).load(root)
    )
    size = F.col("length")
    return listed.select(
        "path",
        size.alias("size_bytes"),
        in_mb(size).alias("size_mb"),
        in_gb(size).alias("size_gb"),
        F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\.[^.]*)$", 1).alias("extension"),
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory"),
    )


def table_inventory(spark: SparkSession, paths: Sequence[str], base_name: bool = False) -> DataFrame:
    """Rows, columns and size per file of the given Parquet tables; with ``base_name`` summed under each table's folder name.

    Files without rows count 0. Files that cannot be read have no rows and no columns, and add none to their table.
    """
    files = file_inventory(spark, paths, ["parquet"])
    if not base_name:
        return files.select("path", "size_bytes", "n_rows", "n_columns", "file", "size_mb")
    return (
        files.withColumn("table", F.element_at(F.split("path", "/"), -2))
        .groupBy("table")
        .agg(
            F.max("n_columns").alias("n_columns"),
            F.sum("size_bytes").alias("size_bytes"),
            F.sum("n_rows").alias("n_rows"),
            F.count(F.lit(1)).alias("n_files"),
        )
        .withColumn("size_mb", in_mb(F.col("size_bytes")))
    )
