"""Plans that would not survive large or skewed data must not appear."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as driver
from millrace.operators import ordered
from millrace.sources import tables
from millrace.testbed import fixtures as fx

QUERIES = driver.queries()
LAZY = [
    "filter_group_count", "silver_meta", "silver_reviews", "gold_join", "model_data", "column_profile", "describe_numeric",
    "quality_gate", "ts_gaps", "run_durations", "report_times", "execution_blocks", "run_numbering", "elapsed_minutes",
    "split_at_index", "stratified_split", "random_top_n", "zscore", "nearest_centroid", "timing_summary", "report_sections",
]


def plan(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins(spark, sf_dir, no_broadcast, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["ts_gaps", "run_durations", "report_times", "execution_blocks", "run_numbering", "split_at_index"])
def test_windows_over_rows_are_chunked(spark, name):
    """A window partitioned by the series alone may only see one row per chunk, below an aggregate."""
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.01"))
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", text):
        chunked = any(c in spec for c in ("__chunk", "__block", "__fine", "__slot"))
        assert chunked, spec


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(QUERIES["filter_group_count"](spark, sf_dir))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text
    assert "GreaterThan(l_extendedprice,0.0)" in text
    gold = plan(QUERIES["gold_join"](spark, sf_dir))
    assert "l_comment" not in gold and "l_tax" not in gold


def test_exact_splits_do_not_shuffle_rows(spark, sf_dir):
    """Rows are decided where they lie: the final plan is a map over the scan."""
    text = plan(QUERIES["stratified_split"](spark, sf_dir))
    main = text.split("===== Subqueries")[0]
    assert "Exchange hashpartitioning" not in main and "Window" not in main


def test_silver_is_map_only(spark, sf_dir):
    assert "Exchange" not in plan(QUERIES["silver_meta"](spark, sf_dir))


def test_hot_series_is_spread_over_chunks(spark, sf_dir):
    lines = fx.report_lines(spark, sf_dir)
    chunked = ordered.line_chunks(lines, "line_no", size=50)
    biggest = chunked.groupBy("file", "__chunk").count().agg({"count": "max"}).first()[0]
    assert biggest <= 50


def test_sized_write_gives_no_task_all_rows(spark, sf_dir, monkeypatch):
    """The size of the table is known from files written as the rows come."""
    asked, write = [], tables.write_parquet
    monkeypatch.setattr(tables, "write_parquet", lambda *a, **b: (asked.append(b.get("files")), write(*a, **b)))
    assert all(r.near_target for r in QUERIES["target_sized_write"](spark, sf_dir).collect())
    assert asked == [None] * 4
