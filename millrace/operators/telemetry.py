"""Container telemetry: parsing, quality gate, statistics per container and across runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F, types as T

from millrace.functions import telemetry as tf
from millrace.functions.clean import to_micros
from millrace.operators.lookup import lookup_join
from millrace.operators.quantiles import spread_quantiles

# The telemetry columns and the report order of the containers.
TELEMETRY = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in (
            "timestamp",
            "container_id",
            "name",
            "cpu_perc",
            "mem_usage",
            "mem_perc",
            "net_io",
            "block_io",
            "pids",
        )
    ]
)
CONTAINER_ORDER = ["spark-master", "spark-worker-1", "spark-worker-2", "spark-worker-3", "spark-worker-4", "spark-worker-5"]
METRICS = ["cpu_perc", "mem_used_GB"]
STATISTICS = ["mean", "std", "min", "max", "median", "q25", "q75"]


def parse_telemetry(df: DataFrame) -> DataFrame:
    """Text columns to a timestamp and numbers; ``name_clean`` added. ``mem_perc`` is parsed where it is there."""
    used, total = tf.memory_parts(F.col("mem_usage"))
    parsed = df.withColumns(
        {
            "timestamp": tf.compact_timestamp(F.col("timestamp")),
            "cpu_perc": tf.percent(F.col("cpu_perc")),
            "name_clean": tf.clean_name(F.col("name")),
            "__used": used,
            "__total": total,
        }
    )
    if "mem_perc" in df.columns:
        parsed = parsed.withColumn("mem_perc", tf.percent(F.col("mem_perc")))
    used, total = tf.both_or_neither(F.col("__used"), F.col("__total"))
    return parsed.withColumns({"mem_used_GB": used, "mem_total_GB": total}).drop("__used", "__total")


def _checks(df: DataFrame, source: str, min_rows: int) -> DataFrame:
    """One row per source, one boolean per rule."""
    infinite = F.lit(False)
    for metric in METRICS:
        infinite = infinite | F.coalesce(F.abs(F.col(metric)) == float("inf"), F.lit(False))
    return df.groupBy(source).agg(
        (F.count_if(F.col("timestamp").isNull()) == 0).alias("timestamp_present"),
        (F.count_if(F.col("cpu_perc").isNull()) == 0).alias("cpu_present"),
        (F.count_if(F.col("mem_used_GB").isNull()) == 0).alias("memory_present"),
        (F.count_if(infinite) == 0).alias("finite"),
        (F.count(F.lit(1)) >= min_rows).alias("enough_rows"),
    )


def _rules(checks: DataFrame, source: str) -> list[str]:
    return [c for c in checks.columns if c != source]


def quality_rules(df: DataFrame, source: str = "source", min_rows: int = 2) -> DataFrame:
    """(source, rule, passed) for every source, from one aggregate."""
    checks = _checks(df, source, min_rows)
    return checks.unpivot([source], _rules(checks, source), "rule", "passed")


def failed_rules(df: DataFrame, source: str = "source", min_rows: int = 2) -> DataFrame:
    """(source, rule) of every rule that a source breaks: what the gate leaves out, and why."""
    return quality_rules(df, source, min_rows).where("not passed").select(source, "rule")


def keep_good(df: DataFrame, source: str = "source", min_rows: int = 2) -> DataFrame:
    """Rows of the sources that pass every rule."""
    checks = _checks(df, source, min_rows)
    good = checks.where(reduce(and_, [F.col(r) for r in _rules(checks, source)])).select(source)
    return lookup_join(df, good, [source], "left_semi")


def missing_columns(df: DataFrame, required: Sequence[str] = ("name", "timestamp", "cpu_perc", "mem_usage")) -> list[str]:
    return [c for c in required if c not in df.columns]


def elapsed_minutes(df: DataFrame, source: str = "source") -> DataFrame:
    """Minutes since the first sample of the source."""
    start = df.groupBy(source).agg(F.min("timestamp").alias("__start"))
    passed = (to_micros("timestamp") - to_micros("__start")) / F.lit(60_000_000.0)
    return lookup_join(df, start, [source], "left").withColumn("elapsed_minutes", passed).drop("__start")


def metric_rows(df: DataFrame, groups: Sequence[str], metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """One row per sample and metric."""
    return df.unpivot(list(groups), list(metrics), "metric", "value")


def container_stats(df: DataFrame, groups: Sequence[str] = ("name",), metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Mean, sample deviation, min, max and exact quartiles per group and metric."""
    tall = metric_rows(df, groups, metrics)
    keys = [*groups, "metric"]
    moments = tall.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = spread_quantiles(tall, keys, "value", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return lookup_join(moments, quartiles, keys, "left", null_safe=True)


def wide_stats(stats: DataFrame, groups: Sequence[str] = ("name",), metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """One row per group with ``{metric}_{statistic}`` columns and the cleaned name."""
    wide = stats.groupBy(*groups).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in metrics for s in STATISTICS]
    )
    return wide.withColumn("name_clean", tf.clean_name(F.col("name"))) if "name" in groups else wide


def means_by(df: DataFrame, groups: Sequence[str], metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    return df.groupBy(*groups).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics])


def pivot_runs(df: DataFrame, row: str, run: str, value: str, runs: Sequence) -> DataFrame:
    """Mean of ``value`` per row key, one column per listed run."""
    return df.groupBy(row).pivot(run, list(runs)).agg(F.avg(value))


def cross_run_summary(stats: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of each statistic across runs."""
    measures = []
    for v in values:
        measures += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return stats.groupBy(*groups).agg(*measures)


def stat_by_run(
    stats: DataFrame, groups: Sequence[str], run: str, runs: Sequence, statistics: Sequence[str]
) -> DataFrame:
    """Statistics as rows, runs as columns ``run_{n}``, with mean and deviation over the runs only."""
    tall = stats.unpivot([*groups, run], list(statistics), "statistic", "value")
    columns = [F.max(F.when(F.col(run) == r, F.col("value"))).alias(f"run_{r}") for r in runs]
    return tall.where(F.col(run).isin(list(runs))).groupBy(*groups, "statistic").agg(
        *columns, F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )


