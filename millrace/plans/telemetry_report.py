"""Telemetry rows to statistics per container in report order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import telemetry as tm
from millrace.operators.combine import reindex
from millrace.session import staged
from millrace.sources.tables import write_csv
from millrace.sources.telemetry import read_telemetry


def parsed_samples(raw: DataFrame) -> DataFrame:
    """All samples as numbers; the text is parsed once, and what later passes need is a written table."""
    missing = tm.missing_columns(raw, ("source", "name", "timestamp", "cpu_perc", "mem_usage"))
    if missing:
        raise ValueError(f"telemetry lacks {missing}")
    return staged(tm.parse_telemetry(raw).select("source", "timestamp", "name", *tm.METRICS), "samples")


def gated_samples(raw: DataFrame) -> DataFrame:
    """Parsed rows of the sources that pass the quality gate."""
    missing = tm.missing_columns(raw)
    if missing:
        raise ValueError(f"telemetry lacks {missing}")
    return tm.keep_good(tm.parse_telemetry(raw))


def good_samples(raw: DataFrame) -> DataFrame:
    """The same with minutes since the start of each source."""
    return tm.elapsed_minutes(gated_samples(raw))


def container_report(raw: DataFrame, order: Sequence[str] = tuple(tm.CONTAINER_ORDER)) -> DataFrame:
    """One row per listed container with all statistics; containers without samples have NULLs."""
    return report_of(parsed_samples(raw), order)


def report_of(samples: DataFrame, order: Sequence[str]) -> DataFrame:
    """The same from parsed samples, which the gate and each pass of the statistics read again."""
    numbers = tm.keep_good(samples).select("name", *tm.METRICS)
    return reindex(tm.wide_stats(tm.container_stats(numbers)), "name", order)


def run_comparison(raw: DataFrame, run: str, runs: Sequence, metric: str, order: Sequence[str] = tuple(tm.CONTAINER_ORDER)) -> DataFrame:
    """Mean of a metric, containers as rows and runs as columns."""
    return reindex(tm.pivot_runs(gated_samples(raw), "name", run, metric, runs), "name", order)


def telemetry_job(
    spark: SparkSession, source: str, target: str, order: Sequence[str] = tuple(tm.CONTAINER_ORDER), failures: str | None = None
) -> None:
    """Telemetry CSV files below a folder to one CSV table of statistics per container.

    Sources that fail the gate are skipped; ``failures`` is where their broken rules are written.
    """
    samples = parsed_samples(read_telemetry(spark, source))
    if failures:
        write_csv(tm.failed_rules(samples), failures)
    write_csv(report_of(samples, order), target)
