"""``python -m millrace <job> <source> <target>``, or the same through spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from millrace.plans import classify, clustering, counting, gold, profiling, silver, telemetry_report, timing
from millrace.session import drop_staged, session

JOBS = {
    "silver-meta": lambda spark, a: silver.silver_meta_job(spark, a.source, a.target),
    "silver-reviews": lambda spark, a: silver.silver_reviews_job(spark, a.source, a.target),
    "gold": lambda spark, a: gold.gold_job(spark, a.source, a.reviews, a.target, a.category or gold.CATEGORIES),
    "model-data": lambda spark, a: gold.model_data_job(spark, a.source, a.target),
    "profile": lambda spark, a: profiling.profile_job(spark, a.source.split(","), a.target),
    "kmeans": lambda spark, a: clustering.kmeans_job(spark, a.source, a.target, a.sample, on_missing=a.on_missing),
    "kmeans-head": lambda spark, a: clustering.head_job(spark, a.source, a.target),
    "gbt": lambda spark, a: classify.gbt_job(spark, a.source, a.target, a.label, a.csv_schema, a.rounds),
    "count": lambda spark, a: counting.filter_group_count_job(spark, a.source, a.target, F.expr(a.where), a.key),
    "telemetry": lambda spark, a: telemetry_report.telemetry_job(spark, a.source, a.target, a.order, a.failures),
    "timing": lambda spark, a: timing.timing_job(spark, a.source, a.target),
}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("source", help="input path; a template with {} for gold, a comma-separated list for profile")
    parser.add_argument("target")
    parser.add_argument("--reviews", help="gold: path template of the review tables")
    parser.add_argument("--category", action="append", help="gold: a category, repeatable")
    parser.add_argument("--sample", type=int, help="kmeans: cluster this many random rows")
    parser.add_argument("--on-missing", default="error", choices=["error", "skip", "keep"], help="kmeans: rows with a NULL feature")
    parser.add_argument("--order", type=lambda v: v.split(","), default=telemetry_report.tm.CONTAINER_ORDER, help="telemetry: containers, by comma")
    parser.add_argument("--failures", help="telemetry: where to write why sources were left out")
    parser.add_argument("--label", default=classify.LABEL)
    parser.add_argument("--rounds", type=int, default=1, help="gbt: boosting rounds")
    parser.add_argument("--csv-schema", help="gbt: read CSV of this schema")
    parser.add_argument("--where", default="price > 0", help="count: row filter")
    parser.add_argument("--key", default="main_category", help="count: grouping column")
    options = parser.parse_args(arguments)
    spark = session(f"millrace-{options.job}")
    try:
        result = JOBS[options.job](spark, options)
    finally:
        drop_staged(spark)
    if result is not None:
        print(result)


if __name__ == "__main__":
    main()
