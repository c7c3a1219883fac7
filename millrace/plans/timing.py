"""Report lines to a timing summary per folder and dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import text as tx
from millrace.operators import reports
from millrace.operators.combine import union_same
from millrace.operators.projection import conform
from millrace.sources.tables import write_csv
from millrace.sources.text import read_report_lines

# Category by file name, first match wins.
CATEGORY_RULES = [("EDA", "EDA"), ("KMeans", "ML KMeans"), ("XGBoost", "ML XGBoost"), ("LightGBM", "ML LightGBM"),
                  ("Read_Filter", "ETL Read Filter"), ("_B_", "Reviews")]


def timing_rows(lines: DataFrame) -> DataFrame:
    """Timed lines of (folder, file, line_no, line) as rows of the common timing schema."""
    return categorised(reports.heading_times(lines, ["folder", "file"]))


def categorised(times: DataFrame) -> DataFrame:
    """Times of (folder, file) with the category that the file's name says, in the common timing schema."""
    named = times.withColumn("category", tx.classify(F.col("file"), CATEGORY_RULES, "Meta"))
    return conform(named, reports.TIMING_COLUMNS)


def timing_summary(sources: Sequence[DataFrame]) -> DataFrame:
    """Stack timing rows of any origin, drop unknown runs, tidy dataset names, summarise."""
    stacked = union_same([conform(s, reports.TIMING_COLUMNS) for s in sources])
    known = reports.drop_unknown_runs(stacked).withColumn("dataset", tx.clean_label(F.col("dataset")))
    return reports.timing_summary(known)


def report_folder_lines(spark: SparkSession, source: str) -> DataFrame:
    """Report files below a folder as (folder, file, line_no, line)."""
    lines = read_report_lines(spark, source)
    path = F.split("file", "/")
    return lines.withColumns({"folder": F.element_at(path, -2), "file": F.element_at(path, -1)})


def timing_job(spark: SparkSession, source: str, target: str) -> None:
    """Report files below a folder to a CSV table of times per folder and dataset."""
    write_csv(timing_summary([timing_rows(report_folder_lines(spark, source))]), target)
