"""Report text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read_report_texts(spark: SparkSession, path: str, name_glob: str = "*.md") -> DataFrame:
    """(file, text), one row per file, for patterns that span lines."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name_glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_report_lines(spark: SparkSession, path: str, name_glob: str = "*.md") -> DataFrame:
    """(file, line_no, line) counting from 0, for files of any size.

    Files are read in splits. Lines are numbered inside each split, and a split starts at the number of
    lines in the splits before it, so no task ever holds a whole file. Windows line ends are accepted.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name_glob)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__id"),
        F.col("value").alias("line"),
    )
    earlier = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        raw.groupBy("file", "__split")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("file", "__split", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    )
    in_split = Window.partitionBy("file", "__split").orderBy("__id")
    return (
        raw.withColumn("__row", F.row_number().over(in_split))
        .join(starts, ["file", "__split"])
        .select("file", (F.col("__start") + F.col("__row") - 1).alias("line_no"), "line")
    )
