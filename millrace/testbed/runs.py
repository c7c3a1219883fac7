"""Profiles, telemetry statistics, gaps and runs, report timing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import text as tx
from millrace.functions.clean import to_micros
from millrace.operators import ordered, reports, telemetry as tm
from millrace.operators.combine import reindex
from millrace.operators.profile import binary_columns, column_profile, describe_columns
from millrace.operators.quantiles import boxplot_numbers
from millrace.plans import telemetry_report, timing
from millrace.session import staged, work_dir
from millrace.sources import telemetry
from millrace.streaming import ingest, runs as stream
from millrace.testbed import fixtures as fx
from millrace.testbed.registry import query, table

_RUNS = [1, 2, 3, 4, 5]


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating results rounded, because the two engines add in different orders."""
    return df.select(
        *[F.round(f.name, places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields]
    )


def _profile_sql(relation: str, columns: dict[str, str]) -> str:
    nan = {"numeric": "isnan(CAST({c} AS DOUBLE))", "string": "{c} = 'NaN'", "boolean": "false"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS nulls, "
        f"count(*) FILTER ({nan[k].format(c=c)}) AS nans, count(DISTINCT {c}) AS uniques FROM ({relation})"
        for c, k in columns.items()
    )


_LINEITEM_KINDS = {
    c: "numeric" for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
} | {"l_returnflag": "string", "l_linestatus": "string"}


@query("column_profile", _profile_sql("SELECT * FROM lineitem", _LINEITEM_KINDS))
def column_profile_query(spark: SparkSession, d: str) -> DataFrame:
    return column_profile(table(spark, d, "lineitem"))


_HOLES = (
    "SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN event_type WHEN user_id % 2 = 0 THEN 'NaN' END AS kind, "
    "CASE WHEN event_type = 'view' THEN CAST('NaN' AS DOUBLE) WHEN event_type <> 'error' THEN value END AS value, "
    "CASE WHEN user_id % 5 <> 0 THEN value > 10 END AS big FROM events"
)


@query(
    "column_profile_holes",
    _profile_sql(_HOLES, {"event_id": "numeric", "kind": "string", "value": "numeric", "big": "boolean"}),
)
def column_profile_holes(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("millrace_events")
    df = spark.sql(_HOLES.replace("FROM events", "FROM millrace_events"))
    return column_profile(df, ["event_id", "kind", "value", "big"], columns_per_pass=3)


def _describe_sql(relation: str, columns: dict[str, str]) -> str:
    out = []
    for c, k in columns.items():
        number, text = (f"CAST({c} AS DOUBLE)", "NULL::VARCHAR") if k == "numeric" else ("NULL::DOUBLE", c)
        out.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS n_values, round(avg({number}), 6) AS mean, round(stddev_samp({number}), 6) AS stddev, "
            f"round(min({number}), 6) AS min_number, round(max({number}), 6) AS max_number, min({text}) AS min_text, max({text}) AS max_text FROM {relation}"
        )
    return " UNION ALL ".join(out)


@query("describe_numeric", _describe_sql("lineitem", _LINEITEM_KINDS))
def describe_numeric(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(describe_columns(table(spark, d, "lineitem")))


@query(
    "binary_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", bool_and(coalesce({c} IN (0, 1), false)) AS is_binary FROM labels"
        for c in ["doc_id", "quality", "toxic"]
    ),
)
def binary_columns_query(spark: SparkSession, d: str) -> DataFrame:
    return binary_columns(table(spark, d, "labels"))


@query(
    "telemetry_parse",
    'SELECT event_id, epoch_us(timestamp) AS micros, name, name_clean, source, cpu_perc, "mem_used_GB", "mem_total_GB" '
    f"FROM ({fx.DUCK_TELEMETRY})",
)
def telemetry_parse(spark: SparkSession, d: str) -> DataFrame:
    return tm.parse_telemetry(fx.telemetry(spark, d)).select(
        "event_id", to_micros("timestamp").alias("micros"), "name", "name_clean", "source", "cpu_perc", "mem_used_GB", "mem_total_GB"
    )


_RULES = {
    "timestamp_present": "count(*) FILTER (timestamp IS NULL) = 0",
    "cpu_present": "count(*) FILTER (cpu_perc IS NULL) = 0",
    "memory_present": 'count(*) FILTER ("mem_used_GB" IS NULL) = 0',
    "finite": 'count(*) FILTER (isinf(cpu_perc) OR isinf("mem_used_GB")) = 0',
    "enough_rows": "count(*) >= 2",
}
_DUCK_GOOD = (
    f"SELECT * FROM ({fx.DUCK_TELEMETRY}) WHERE source IN (SELECT source FROM ({fx.DUCK_TELEMETRY}) GROUP BY source HAVING "
    + " AND ".join(_RULES.values())
    + ")"
)


@query(
    "quality_gate",
    " UNION ALL ".join(
        f"SELECT source, '{n}' AS rule, {e} AS passed FROM ({fx.DUCK_TELEMETRY}) GROUP BY source" for n, e in _RULES.items()
    ),
)
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return tm.quality_rules(tm.parse_telemetry(fx.telemetry(spark, d)))


_STATS = {
    "mean": "avg({m})",
    "std": "stddev_samp({m})",
    "min": "min({m})",
    "max": "max({m})",
    "median": "median({m})",
    "q25": "quantile_cont({m}, 0.25)",
    "q75": "quantile_cont({m}, 0.75)",
}


def _wide_stats_sql(relation: str, group: str) -> str:
    columns = ", ".join(
        f'round({e.format(m=chr(34) + m + chr(34))}, 6) AS "{m}_{s}"' for m in tm.METRICS for s, e in _STATS.items()
    )
    return f"SELECT {group}, {columns} FROM ({relation}) GROUP BY {group}"


@query(
    "container_stats",
    f"SELECT *, replace(replace(name, '-', '_'), 'spark_', '') AS name_clean FROM ({_wide_stats_sql(fx.DUCK_TELEMETRY, 'name')})",
)
def container_stats(spark: SparkSession, d: str) -> DataFrame:
    parsed = tm.parse_telemetry(fx.telemetry(spark, d)).select("name", *tm.METRICS)
    return _rounded(tm.wide_stats(tm.container_stats(staged(parsed, "parsed"))))


_ORDER_VALUES = ", ".join(f"('{n}', {i})" for i, n in enumerate(tm.CONTAINER_ORDER))


@query(
    "telemetry_report",
    f"SELECT o.name, o.position, s.* EXCLUDE (name), replace(replace(s.name, '-', '_'), 'spark_', '') AS name_clean "
    f"FROM (VALUES {_ORDER_VALUES}) AS o(name, position) LEFT JOIN ({_wide_stats_sql(_DUCK_GOOD, 'name')}) AS s USING (name)",
)
def telemetry_report_query(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(telemetry_report.container_report(fx.telemetry(spark, d)))


@query(
    "reindex_order",
    f"SELECT o.name, o.position, round(s.m, 6) AS value_mean FROM (VALUES ('signup', 0), ('view', 1), ('nothing', 2), ('error', 3)) AS o(name, position) "
    "LEFT JOIN (SELECT event_type AS name, avg(value) AS m FROM events GROUP BY event_type) AS s USING (name)",
)
def reindex_order(spark: SparkSession, d: str) -> DataFrame:
    means = tm.means_by(table(spark, d, "events").withColumnRenamed("event_type", "name"), ["name"], ["value"])
    return _rounded(reindex(means, "name", ["signup", "view", "nothing", "error"]))


@query(
    "boxplot_numbers",
    """
    WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, median(value) AS median, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1),
    f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM q)
    SELECT event_type, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, round(avg(value), 6) AS mean,
      min(value) FILTER (value BETWEEN lo AND hi) AS whisker_low, max(value) FILTER (value BETWEEN lo AND hi) AS whisker_high,
      count(*) FILTER (value NOT BETWEEN lo AND hi) AS n_outliers
    FROM events JOIN f USING (event_type) GROUP BY event_type, q25, median, q75
    """,
)
def boxplot_query(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(boxplot_numbers(table(spark, d, "events"), ["event_type"], "value"))


@query(
    "pivot_runs",
    "SELECT event_type, "
    + ", ".join(f'round(avg(value) FILTER (user_id % 5 + 1 = {r}), 6) AS "{r}"' for r in _RUNS)
    + " FROM events GROUP BY event_type",
)
def pivot_runs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("run", F.col("user_id") % 5 + 1)
    return _rounded(tm.pivot_runs(events, "event_type", "run", "value", _RUNS))


_RUN_STATS = "SELECT event_type, user_id % 5 + 1 AS run, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2"


def _run_stats(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("run", F.col("user_id") % 5 + 1)
    v = F.col("value")
    return events.groupBy("event_type", "run").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )


@query(
    "cross_run_summary",
    "SELECT event_type, round(avg(mean), 6) AS mean_mean, round(stddev_samp(mean), 6) AS mean_std, round(avg(max), 6) AS max_mean, "
    f"round(stddev_samp(max), 6) AS max_std FROM ({_RUN_STATS}) GROUP BY event_type",
)
def cross_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tm.cross_run_summary(_run_stats(spark, d), ["event_type"], ["mean", "max"]))


@query(
    "stat_by_run_matrix",
    "SELECT event_type, statistic, "
    + ", ".join(f"round(max(value) FILTER (run = {r}), 6) AS run_{r}" for r in _RUNS)
    + ", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM ("
    + " UNION ALL ".join(f"SELECT event_type, run, '{s}' AS statistic, {s} AS value FROM ({_RUN_STATS})" for s in ["mean", "std", "min", "max"])
    + ") GROUP BY event_type, statistic",
)
def stat_by_run_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tm.stat_by_run(_run_stats(spark, d), ["event_type"], "run", _RUNS, ["mean", "std", "min", "max"]))


_RUN_MEANS = f'SELECT run, name, round(avg(cpu_perc), 6) AS cpu_perc_mean, round(avg("mem_used_GB"), 6) AS "mem_used_GB_mean" FROM ({fx.DUCK_TELEMETRY}) GROUP BY run, name'


@query("run_container_means", _RUN_MEANS)
def run_container_means(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tm.means_by(tm.parse_telemetry(fx.telemetry(spark, d)), ["run", "name"]))


@query("sorted_stats", _RUN_MEANS)
def sorted_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tm.means_by(tm.parse_telemetry(fx.telemetry(spark, d)), ["run", "name"])).orderBy("run", F.desc("cpu_perc_mean"))


@query(
    "elapsed_minutes",
    "SELECT event_id, source, round((epoch_us(timestamp) - min(epoch_us(timestamp)) OVER (PARTITION BY source)) / 60000000.0::DOUBLE, 6) AS elapsed_minutes "
    f"FROM ({fx.DUCK_TELEMETRY})",
)
def elapsed_minutes(spark: SparkSession, d: str) -> DataFrame:
    out = tm.elapsed_minutes(tm.parse_telemetry(fx.telemetry(spark, d)))
    return _rounded(out.select("event_id", "source", "elapsed_minutes"))


def _event_series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", to_micros("ts").alias("micros"))


@query(
    "ts_gaps",
    "SELECT user_id, event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0::DOUBLE, 6) AS gap_seconds FROM events",
)
def ts_gaps(spark: SparkSession, d: str) -> DataFrame:
    chunked = ordered.balanced_chunks(_event_series(spark, d), "micros", rows_per_chunk=1_000)
    gaps = ordered.with_previous(chunked, ["user_id"], "__chunk", ["micros", "event_id"], "micros", "previous")
    seconds = (F.col("micros") - F.col("previous")) / F.lit(1_000_000.0)
    return gaps.select("user_id", "event_id", F.round(seconds, 6).alias("gap_seconds"))


@query(
    "run_durations",
    """
    WITH g AS (SELECT user_id, event_id, epoch_us(ts) AS micros,
      epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    s AS (SELECT *, sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY micros, event_id
      ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g)
    SELECT user_id, segment, min(micros) AS start_micros, max(micros) AS end_micros,
      round((max(micros) - min(micros)) / 1000000.0::DOUBLE, 6) AS duration_seconds, count(*) AS n_rows FROM s GROUP BY user_id, segment
    """,
)
def run_durations(spark: SparkSession, d: str) -> DataFrame:
    cut = ordered.segments(_event_series(spark, d), ["user_id"], "micros", ["micros", "event_id"], 6 * 3600, rows_per_chunk=1_000)
    return _rounded(ordered.segment_durations(cut, ["user_id"], "micros"))


@query(
    "run_numbering",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run_no FROM orders",
)
def run_numbering(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return reports.number_runs(orders, ["o_custkey"], "o_orderkey", lines_per_chunk=1_000)


@query(
    "run_cap",
    "SELECT o_custkey, o_orderkey, CASE WHEN n > 5 THEN '[Run X]' ELSE '[Run ' || n || ']' END AS run FROM "
    "(SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)",
)
def run_cap(spark: SparkSession, d: str) -> DataFrame:
    return run_numbering(spark, d).select("o_custkey", "o_orderkey", tx.capped_run(F.col("run_no")).alias("run"))


_BY_FILE = "PARTITION BY folder, file ORDER BY line_no"
_HEAD = "nullif(trim(regexp_extract(line, '## (?:Normalize|EDA) (?:Dataset|Reviews Dataset) - (.+)', 1)), '')"
_IS_TOTAL = "contains(line, 'Tiempo total del script')"
_FILES = ["folder", "file"]
_SMALL_CHUNKS = 100


@query(
    "heading_lookback",
    f"SELECT folder, file, line_no, line, coalesce(last_value({_HEAD} IGNORE NULLS) OVER ({_BY_FILE} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS dataset FROM ({fx.DUCK_LINES})",
)
def heading_lookback(spark: SparkSession, d: str) -> DataFrame:
    return reports.nearest_heading(fx.report_lines(spark, d), _FILES, lines_per_chunk=_SMALL_CHUNKS)


@query(
    "skip_after_marker",
    f"SELECT folder, file, line_no, line FROM (SELECT *, coalesce(lag({_IS_TOTAL}) OVER ({_BY_FILE}), false) AS after_total FROM ({fx.DUCK_LINES})) "
    f"WHERE NOT after_total AND NOT {_IS_TOTAL}",
)
def skip_after_marker(spark: SparkSession, d: str) -> DataFrame:
    return reports.skip_after(fx.report_lines(spark, d), _FILES, reports.is_total(), _SMALL_CHUNKS)


@query(
    "execution_blocks",
    f"SELECT folder, file, line_no, line, 1 + coalesce(sum(CAST({_IS_TOTAL} AS INT)) OVER ({_BY_FILE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM ({fx.DUCK_LINES})",
)
def execution_blocks(spark: SparkSession, d: str) -> DataFrame:
    return reports.execution_blocks(fx.report_lines(spark, d), _FILES, reports.is_total(), lines_per_chunk=_SMALL_CHUNKS)


_DUCK_TIMED = f"""
SELECT folder, file, line_no, dataset, try_cast(nullif(regexp_extract(line, '(\\d+(?:\\.\\d+)?)\\s*(?:s|segundos)', 1), '') AS DOUBLE) AS time_seconds, block, closed
FROM (SELECT *, coalesce(last_value({_HEAD} IGNORE NULLS) OVER ({_BY_FILE} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS dataset,
    coalesce(lag({_IS_TOTAL}) OVER ({_BY_FILE}), false) AS after_total,
    1 + coalesce(sum(CAST({_IS_TOTAL} AS INT)) OVER ({_BY_FILE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block,
    count(*) FILTER ({_IS_TOTAL}) OVER (PARTITION BY folder, file) AS closed
  FROM ({fx.DUCK_LINES}))
WHERE NOT after_total AND NOT {_IS_TOTAL} AND regexp_matches(line, '\\d+(?:\\.\\d+)?\\s*(?:s|segundos)')
"""
_DUCK_TIMES = f"""
SELECT folder, file, line_no, dataset, run_no, CASE WHEN dataset = '' THEN '[Run X]' ELSE '[Run ' || run_no || ']' END AS run, time_seconds
FROM (SELECT *, row_number() OVER (PARTITION BY folder, file, dataset ORDER BY line_no) AS run_no FROM ({_DUCK_TIMED}))
"""


@query("report_times", _DUCK_TIMES)
def report_times(spark: SparkSession, d: str) -> DataFrame:
    return reports.report_times(fx.report_lines(spark, d), _FILES, _SMALL_CHUNKS)


@query(
    "block_times",
    f"SELECT folder, file, line_no, dataset, block, '[Run ' || block || ']' AS run, time_seconds FROM ({_DUCK_TIMED}) WHERE block <= closed",
)
def block_times(spark: SparkSession, d: str) -> DataFrame:
    return reports.block_times(fx.report_lines(spark, d), _FILES, _SMALL_CHUNKS)


@query(
    "timing_summary",
    f"""
    SELECT folder, replace(replace(dataset, '.parquet', ''), 'meta_', '') AS dataset, count(*) AS n_runs, round(avg(time_seconds), 2) AS mean,
      round(stddev_samp(time_seconds), 2) AS std, round(min(time_seconds), 2) AS min, round(max(time_seconds), 2) AS max
    FROM ({_DUCK_TIMES}) WHERE NOT contains(run, 'Run X') GROUP BY ALL
    """,
)
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Times of known datasets only: rows without one have an unknown run and go."""
    return timing.timing_summary([timing.categorised(reports.report_times(fx.report_lines(spark, d), _FILES))])


_DUCK_NAMED = "nullif(trim(regexp_extract(line, '## (?:Normalize|EDA) (?:Reviews |Meta )?Dataset - (.+)', 1)), '')"
_DUCK_TITLE = "nullif(trim(regexp_extract(line, '## (.+?)\\s*(?:-\\s*)?\\[Run (\\d+)\\]', 1)), '')"
_DUCK_NUMBER = "nullif(regexp_extract(line, '## (.+?)\\s*(?:-\\s*)?\\[Run (\\d+)\\]', 2), '')"
_DUCK_ALL_TIMES = f"""
WITH l AS (SELECT *, coalesce({_DUCK_NAMED}, {_DUCK_TITLE}) AS name, CASE WHEN {_DUCK_NAMED} IS NULL THEN {_DUCK_NUMBER} END AS number FROM ({fx.DUCK_ALL_LINES})),
seen AS (SELECT *, last_value(CASE WHEN name IS NOT NULL THEN {{'name': name, 'number': number}} END IGNORE NULLS) OVER (PARTITION BY folder, file ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND 0 PRECEDING) AS h,
  coalesce(lag({_IS_TOTAL}) OVER (PARTITION BY folder, file ORDER BY line_no), false) AS after_total FROM l),
timed AS (SELECT folder, file, line_no, coalesce(h.name, '') AS dataset, CAST(h.number AS BIGINT) AS given,
  try_cast(nullif(regexp_extract(line, '(\\d+(?:\\.\\d+)?)\\s*(?:s|segundos)', 1), '') AS DOUBLE) AS time_seconds
  FROM seen WHERE NOT after_total AND NOT {_IS_TOTAL})
SELECT folder, file, line_no, dataset, coalesce(given, row_number() OVER (PARTITION BY folder, file, dataset ORDER BY line_no)) AS run_no, time_seconds
FROM timed WHERE time_seconds IS NOT NULL
"""


@query("heading_times", f"SELECT folder, file, line_no, dataset, run_no, '[Run ' || run_no || ']' AS run, time_seconds FROM ({_DUCK_ALL_TIMES})")
def heading_times(spark: SparkSession, d: str) -> DataFrame:
    return reports.heading_times(fx.all_report_lines(spark, d), _FILES)


@query(
    "timing_summary_all",
    f"""
    SELECT folder, replace(replace(coalesce(nullif(dataset, ''), 'No especificado'), '.parquet', ''), 'meta_', '') AS dataset, count(*) AS n_runs,
      round(avg(time_seconds), 2) AS mean, round(stddev_samp(time_seconds), 2) AS std, round(min(time_seconds), 2) AS min, round(max(time_seconds), 2) AS max
    FROM ({_DUCK_ALL_TIMES}) GROUP BY 1, 2
    """,
)
def timing_summary_all(spark: SparkSession, d: str) -> DataFrame:
    """Every heading form, and times without a heading; no timed line is lost."""
    return timing.timing_summary([timing.timing_rows(fx.all_report_lines(spark, d))])


_SECTION_TEXT = (
    "'## KMeans Clustering [Run ' || CAST(o_orderkey % 9 AS STRING) || ']' || {nl} || '- Inicio: x' || {nl} || '- Duración: ' || CAST(o_custkey AS STRING) || '.25 segundos' || {nl} || "
    "'## Otro' || {nl} || 'Duración: 1.5 segundos' || {nl} || '## GBT Fast [Run 2]' || {nl} || 'Duración: ' || CAST(o_orderkey AS STRING) || '.5 segundos'"
)
_DUCK_SECTION = "'## ([^\\n\\[]*) \\[Run (\\d+)\\]\\n.*?Duración: (\\d+\\.\\d+) segundos'"


@query(
    "report_sections",
    f"""
    SELECT o_orderkey, trim(title) AS title, CAST(n AS INT) AS run_no, CASE WHEN CAST(n AS INT) > 5 THEN '[Run X]' ELSE '[Run ' || n || ']' END AS run, CAST(s AS DOUBLE) AS seconds
    FROM (SELECT o_orderkey, unnest(regexp_extract_all(t, {_DUCK_SECTION}, 1, 's')) AS title, unnest(regexp_extract_all(t, {_DUCK_SECTION}, 2, 's')) AS n,
      unnest(regexp_extract_all(t, {_DUCK_SECTION}, 3, 's')) AS s FROM (SELECT o_orderkey, {_SECTION_TEXT.format(nl="chr(10)")} AS t FROM orders))
    """,
)
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "orders").select("o_orderkey", F.expr(_SECTION_TEXT.format(nl="char(10)")).alias("text"))
    return reports.section_times(texts, "text", ["o_orderkey"], limit=tx.RUN_LIMIT)


def _markdown_sql() -> str:
    lines = f"WITH s AS ({_RUN_STATS})"
    row = "'| ' || event_type || ' | ' || format('{:.2f}', mean) || ' | ' || format('{:.2f}', std) || ' |'"
    return (
        f"{lines} SELECT run, 0 AS section, event_type AS sort_key, {row} AS line FROM s "
        "UNION ALL SELECT DISTINCT run, -3, NULL, '# ' || run FROM s "
        "UNION ALL SELECT DISTINCT run, -2, NULL, '| Container | Mean | Std |' FROM s "
        "UNION ALL SELECT DISTINCT run, -1, NULL, '|---|---|---|' FROM s"
    )


@query("markdown_rows", _markdown_sql())
def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = {"Container": F.col("event_type"), "Mean": tx.number(F.col("mean")), "Std": tx.number(F.col("std"))}
    return reports.table_lines(_run_stats(spark, d), ["run"], "event_type", cells)


def _table_sql(row: tuple[str, str, str], head: list[str], foot: list[str]) -> str:
    """The rows of a rendered table of run statistics, and the fixed lines around them."""
    start, between, end = row
    cells = f"'{between}'".join(["event_type || ", " || format('{:.2f}', mean) || ", " || coalesce(format('{:.2f}', std), '-')"])
    out = f"WITH s AS ({_RUN_STATS}) SELECT run, 0 AS section, event_type AS sort_key, '{start}' || {cells} || '{end}' AS line FROM s"
    for section, line in [*enumerate(head, -len(head)), *enumerate(foot, 1)]:
        out += f" UNION ALL SELECT DISTINCT run, {section}, NULL, {line} FROM s"
    return out


_TABLES = {
    "latex": (("", " & ", " \\\\\\hline"), ["'\\begin{table}[ht]'", "'\\caption{' || run || '}'", "'\\begin{tabular}{|c|c|c|}'", "'Container & Mean & Std \\\\\\hline'"], ["'\\end{tabular}'", "'\\end{table}'"]),
    "html": (("<tr><td>", "</td><td>", "</td></tr>"), ["'<h1>' || run || '</h1>'", "'<table>'", "'<tr><td>Container</td><td>Mean</td><td>Std</td></tr>'"], ["'</table>'"]),
    "plain": (("", "  ", ""), ["run", "'Container  Mean  Std'"], []),
}


def _rendered(style: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        cells = {"Container": F.col("event_type"), "Mean": tx.number(F.col("mean")), "Std": tx.number(F.col("std"))}
        return reports.table_lines(_run_stats(spark, d), ["run"], "event_type", cells, style)

    return run


for _style, _parts in _TABLES.items():
    query(f"{_style}_rows", _table_sql(*_parts))(_rendered(_style))


@query(
    "telemetry_stream",
    "SELECT 'op_' || event_type AS operation, CAST(user_id % 5 AS STRING) AS input_file, count(*) AS n_rows, round(sum(value), 4) AS total "
    "FROM events WHERE event_type <> 'view' GROUP BY ALL",
)
def telemetry_stream(spark: SparkSession, d: str) -> DataFrame:
    """All events as a file stream; ``view`` plays the idle state. The sink is read back as a table."""
    schema = table(spark, d, "events").schema
    raw = ingest.sample_stream(spark, d, schema, name_glob="events.parquet")
    samples = raw.withColumns(
        {
            "operation": F.when(F.col("event_type") != "view", F.concat(F.lit("op "), "event_type")),
            "input_file": (F.col("user_id") % 5).cast("string"),
        }
    )
    out = work_dir(spark, "stream")
    ingest.route_to_files(ingest.busy_samples(samples), f"{out}/data", f"{out}/progress").awaitTermination()
    back = spark.read.parquet(f"{out}/data").withColumn("input_file", F.col("input_file").cast("string"))
    return back.groupBy("operation", "input_file").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))


_MONITORED = {
    "monitor": "CAST(user_id % 7 AS INT)",
    "operation": "CASE WHEN event_type <> 'view' THEN 'op_' || event_type END",
    "input_file": "CASE WHEN user_id % 11 <> 0 THEN 'f' || CAST(user_id % 3 AS STRING) END",
}


@query(
    "stream_runs",
    f"""
    WITH samples AS (SELECT event_id, ts, {", ".join(f"{e} AS {n}" for n, e in _MONITORED.items())} FROM events),
    busy AS (SELECT monitor, operation, coalesce(input_file, 'unknown') AS input_file, ts, event_id FROM samples WHERE operation IS NOT NULL),
    steps AS (SELECT *, lag(operation || '/' || input_file) OVER (PARTITION BY monitor ORDER BY ts, event_id) AS before FROM busy),
    numbered AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM operation || '/' || input_file THEN 1 ELSE 0 END)
      OVER (PARTITION BY monitor, operation, input_file ORDER BY ts, event_id) AS run FROM steps)
    SELECT monitor, operation, input_file, CAST(run AS INT) AS run, count(*) AS n_samples, min(event_id) AS least_id, max(event_id) AS largest_id
    FROM numbered GROUP BY ALL
    """,
)
def stream_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events arrive in three slices of time; the stream is restarted for each and goes on from its state."""
    root = work_dir(spark, "monitor")
    events = table(spark, d, "events").select("event_id", "ts", *[F.expr(e).alias(n) for n, e in _MONITORED.items()])
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    slices = [first + (last - first) * k / 3 for k in (1, 2)] if first else []
    part = F.lit(0)
    for bound in slices:
        part = part + F.coalesce(F.col("ts") > F.lit(bound), F.lit(False)).cast("int")
    for k in range(len(slices) + 1):
        events.where(part == k).write.mode("append").parquet(f"{root}/in")
        samples = ingest.busy_samples(ingest.sample_stream(spark, f"{root}/in", events.schema))
        numbered = stream.number_runs(samples, "monitor", ["ts", "event_id"])
        with stream.keyed_state(spark):
            started = ingest.route_to_files(numbered, f"{root}/out", f"{root}/progress", ["monitor"])
        started.awaitTermination()
    back = spark.read.parquet(f"{root}/out")
    return back.groupBy("monitor", "operation", "input_file", "run").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min("event_id").alias("least_id"), F.max("event_id").alias("largest_id")
    )


_FILED = {
    "dataset": "CASE WHEN user_id % 2 = 0 THEN '00_AMZN_Spark_Raw' ELSE '01_AMZN_Ray_Model' END",
    "folder": "CASE WHEN user_id % 3 = 0 THEN '05_Spark_EDA_meta_Toys_stats' ELSE '06_Spark_Join_x' END",
    "run": "'run' || CAST(user_id % 4 + 1 AS STRING)",
}


@query(
    "telemetry_files",
    f"""
    WITH files AS (SELECT *, {", ".join(f"{e} AS {n}_" for n, e in _FILED.items())} FROM events)
    SELECT dataset_ AS dataset_name, CASE WHEN folder_ LIKE '05%' THEN 'EDA' ELSE 'Join' END AS operation_type,
      CASE WHEN dataset_ LIKE '%Spark%' OR folder_ LIKE '%Spark%' AND dataset_ NOT LIKE '%Ray%' THEN 'Spark' ELSE 'Ray' END AS framework,
      CAST(replace(run_, 'run', '') AS INT) AS run_number, CASE WHEN folder_ LIKE '05%' THEN 'Toys' ELSE 'General' END AS category,
      count(*) AS n_rows, round(avg(value), 4) AS cpu_mean, 1::BIGINT AS n_folders
    FROM files GROUP BY ALL
    """,
)
def telemetry_files(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry files of equal names in the folders of several runs, half of them without header and the others with their columns
    in another order; what a file belongs to is read off its path."""
    root = f"{work_dir(spark, 'filed')}/images"
    events = table(spark, d, "events")
    cpu = F.concat(F.col("value").cast("string"), F.lit("%")).alias("cpu_perc")
    names = [f.name for f in tm.TELEMETRY.fields]
    filled = {c: F.lit("x").alias(c) for c in names if c not in ("timestamp", "cpu_perc", "name")}
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss").alias("timestamp")
    places = [F.expr(e).alias(n) for n, e in _FILED.items()]
    rows = events.select("user_id", stamp, F.lit("spark-master").alias("name"), cpu, *filled.values(), *places)
    for header, kept in ((True, "user_id % 5 < 2"), (False, "user_id % 5 >= 2")):
        order = names[::-1] if header else names
        out = rows.where(kept).repartition(4, "run").select(*order, *_FILED)
        out.write.mode("append").option("header", header).partitionBy(*_FILED).csv(root)
    found = telemetry.read_telemetry(spark, root)
    facts = {**tx.folder_facts(F.col("path")), **tx.path_facts(F.col("path"))}
    parsed = tm.parse_telemetry(found).withColumns({n: c for n, c in facts.items() if n != "file_name"})
    groups = ["dataset_name", "operation_type", "framework", "run_number", "category"]
    named = parsed.withColumn("dataset_name", F.element_at(F.split("dataset_name", "="), -1))
    return named.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("cpu_perc"), 4).alias("cpu_mean"),
        F.count_distinct(F.regexp_extract("source", "^(.*)/", 1)).alias("n_folders"),
    )
