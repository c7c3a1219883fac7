"""Dirty and nested stand-ins derived from the whole test tables.

Scalar expressions are written once and used by Spark and by the SQL twin; the few that need
arrays, structs or formatting exist in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.testbed.registry import table

_SIZE = "CAST(p_size AS STRING)"
_PART = "CAST(p_partkey AS STRING)"
DIMS = (
    f"CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE {_SIZE} || ' x ' || CAST(p_size + 1 AS STRING) || "
    "CASE WHEN p_partkey % 5 = 0 THEN ' inches' ELSE ' x ' || CAST(p_size + 2 AS STRING) || ' inches' END END"
)
WEIGHT = f"CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE {_SIZE} || '.5 pounds' END"
HARDCOVER = f"CASE WHEN p_partkey % 3 = 0 THEN {_SIZE} || '0 pages' END"
PUBLISHER = "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand || '; ' || p_type || ' edition' END"
DETAILS = (
    "CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '{\"Publisher\": broken' "
    "ELSE '{\"Publisher\": \"' || p_brand || '; ' || p_type || ' edition\"' || "
    f"CASE WHEN p_partkey % 2 = 0 THEN ', \"Item Weight\": \"' || {_SIZE} || '.5 pounds\"' ELSE '' END || "
    f"CASE WHEN p_partkey % 3 = 0 THEN ', \"Hardcover\": \"' || {_SIZE} || '0 pages\"' ELSE '' END || "
    f"CASE WHEN p_partkey % 4 = 0 THEN ', \"Dimensions\": \"' || {_SIZE} || ' x 2.5 x 7 inches\"' ELSE '' END || "
    "CASE WHEN p_partkey % 5 = 0 THEN ', \"Language\": \"English\"' ELSE '' END || "
    f"CASE WHEN p_partkey % 7 = 0 THEN ', \"ISBN 10\": \"' || {_PART} || '\"' ELSE '' END || "
    f"CASE WHEN p_partkey % 8 = 0 THEN ', \"ISBN 13\": \"978' || {_PART} || '\"' ELSE '' END || '}}' END"
)


def _price(formatted: str) -> str:
    return (
        "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'from 9.99' "
        f"ELSE '$' || {formatted} END"
    )


SPARK_PRICE = _price("format_number(p_retailprice, 2)")
DUCK_PRICE = _price("format('{:,.2f}', p_retailprice)")

_META = {
    "parent_asin": _PART,
    "main_category": "CASE WHEN p_partkey % 9 <> 0 THEN p_type END",
    "title": "p_name",
    "average_rating": "CAST(p_size AS DOUBLE) / 10",
    "rating_number": "p_partkey * 3 % 1000",
    "details": DETAILS,
    "description": "p_name || ' ' || p_brand",
    "store": "p_brand",
    "bought together": "CASE WHEN p_partkey % 4 = 0 THEN p_name END",
    "subtitle": "p_type",
    "author": "p_brand",
}


def _urls(kind: str) -> list[str]:
    return [f"'http://img/{kind}/' || {_PART} || '/{i}'" for i in range(2)]


def _arrays(names: list[str], left: str, right: str, empty: str, every: int) -> dict[str, str]:
    return {n: f"CASE WHEN p_partkey % {every} = 0 THEN {empty} ELSE {left}{', '.join(_urls(n))}{right} END" for n in names}


_IMAGES = ["hi_res", "large", "thumb", "variant"]
_VIDEOS = ["title", "url", "user_id"]


def bronze_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    nested = {
        "price": SPARK_PRICE,
        "categories": "CASE WHEN p_partkey % 10 <> 0 THEN split(p_name, ' ') END",
        "features": "split(p_type, 'A')",
    }
    for name, children, every in (("images", _IMAGES, 5), ("videos", _VIDEOS, 3)):
        arrays = _arrays(children, "array(", ")", "CAST(array() AS ARRAY<STRING>)", every)
        nested[name] = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in arrays.items()) + ")"
    return part.select(*[F.expr(f"{e} AS `{n}`") for n, e in {**_META, **nested}.items()])


def _duck_meta() -> str:
    nested = {
        "price": DUCK_PRICE,
        "categories": "CASE WHEN p_partkey % 10 <> 0 THEN string_split(p_name, ' ') END",
        "features": "string_split(p_type, 'A')",
    }
    for name, children, every in (("images", _IMAGES, 5), ("videos", _VIDEOS, 3)):
        arrays = _arrays(children, "[", "]", "CAST([] AS VARCHAR[])", every)
        nested[name] = "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in arrays.items()) + ")"
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in {**_META, **nested}.items()) + " FROM part"


DUCK_META = _duck_meta()

_REVIEW = {
    "parent_asin": "CAST(l_partkey AS STRING)",
    "rating": "CAST(CAST(l_quantity AS BIGINT) % 5 + 1 AS DOUBLE)",
    "title": "l_returnflag || l_linestatus",
    "text": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)",
    "helpful_vote": "CAST(l_quantity AS BIGINT) - 1",
    "verified_purchase": "l_returnflag = 'R'",
    "asin": "CAST(l_partkey AS STRING)",
    "user_id": "CAST(l_suppkey AS STRING)",
}
_IMAGE_FIELDS = {"attachment_type": "l_returnflag", "large_image_url": "'l'", "medium_image_url": "'m'", "small_image_url": "'s'"}


def _image(i: int) -> dict[str, str]:
    return {f: f"{v} || '/' || CAST(l_orderkey AS STRING) || '/{i}'" for f, v in _IMAGE_FIELDS.items()}


def bronze_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = ", ".join(
        "named_struct(" + ", ".join(f"'{f}', {e}" for f, e in _image(i).items()) + ")" for i in range(4)
    )
    nested = {
        "images": f"CASE WHEN l_quantity <> 13 THEN slice(array({images}), 1, l_linenumber % 5) END",
        "timestamp": "unix_millis(CAST(l_shipdate AS TIMESTAMP))",
    }
    lineitem = table(spark, sf_dir, "lineitem")
    return lineitem.select(*[F.expr(f"{e} AS `{n}`") for n, e in {**_REVIEW, **nested}.items()])


def _duck_reviews() -> str:
    images = ", ".join("struct_pack(" + ", ".join(f"{f} := {e}" for f, e in _image(i).items()) + ")" for i in range(4))
    nested = {
        "images": f"CASE WHEN l_quantity <> 13 THEN ([{images}])[1:l_linenumber % 5] END",
        "timestamp": "epoch_ms(l_shipdate)",
    }
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in {**_REVIEW, **nested}.items()) + " FROM lineitem"


DUCK_REVIEWS = _duck_reviews()

_TELEMETRY = {
    "container_id": "'c' || CAST(user_id AS STRING)",
    "name": "CASE event_type WHEN 'view' THEN 'spark-master' WHEN 'click' THEN 'spark-worker-1' "
    "WHEN 'error' THEN 'spark-worker-2' WHEN 'purchase' THEN 'spark-worker-3' ELSE 'extra-node' END",
    "cpu_perc": "CASE WHEN event_id % 997 = 5 THEN 'n/a' ELSE CAST(value AS STRING) || '%' END",
    "mem_usage": "CASE WHEN event_id % 1009 = 7 THEN 'broken' WHEN event_id % 89 = 0 THEN CAST(value AS STRING) || 'KiB / 10GiB' "
    "WHEN event_id % 71 = 0 THEN '0B / 0B' WHEN event_id % 3 = 0 THEN CAST(value AS STRING) || 'MiB / 10GiB' "
    "ELSE CAST(value AS STRING) || 'GiB / 10GiB' END",
    "mem_perc": "CAST(value AS STRING) || '%'",
    "net_io": "'0B / 0B'",
    "block_io": "'0B / 0B'",
    "pids": "CAST(user_id AS STRING)",
    "source": "'Normalize_Dataset__meta_' || CAST(user_id AS STRING) || '__run' || CAST(user_id % 5 + 1 AS STRING)",
    "run": "CAST(user_id % 5 + 1 AS INT)",
    "event_id": "event_id",
}


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = {"timestamp": "date_format(ts, 'yyyyMMdd_HHmmss')"}
    return table(spark, sf_dir, "events").select(*[F.expr(f"{e} AS `{n}`") for n, e in {**stamp, **_TELEMETRY}.items()])


_DUCK_RAW_TELEMETRY = (
    "SELECT strftime(ts, '%Y%m%d_%H%M%S') AS timestamp, "
    + ", ".join(f'{e} AS "{n}"' for n, e in _TELEMETRY.items())
    + " FROM events"
)


def _duck_gb(part: int) -> str:
    text = f"string_split(mem_usage, ' / ')[{part}]"
    amount = f"try_cast(regexp_extract({text}, '^\\s*([\\d.]+)\\s*[A-Za-z]+\\s*$', 1) AS DOUBLE)"
    unit = f"regexp_extract({text}, '([A-Za-z]+)\\s*$', 1)"
    return (
        f"{amount} * CASE {unit} WHEN 'GiB' THEN 1.0::DOUBLE WHEN 'MiB' THEN 1.0::DOUBLE/1024 "
        f"WHEN 'KiB' THEN 1.0::DOUBLE/1048576 WHEN 'B' THEN 1.0::DOUBLE/1073741824 ELSE 0.0::DOUBLE END"
    )


DUCK_TELEMETRY = f"""
SELECT strptime(timestamp, '%Y%m%d_%H%M%S') AS timestamp, container_id, name, source, run, event_id,
  try_cast(replace(cpu_perc, '%', '') AS DOUBLE) AS cpu_perc,
  CASE WHEN u IS NOT NULL AND t IS NOT NULL THEN u END AS "mem_used_GB",
  CASE WHEN u IS NOT NULL AND t IS NOT NULL THEN t END AS "mem_total_GB",
  replace(replace(name, '-', '_'), 'spark_', '') AS name_clean
FROM (SELECT *, {_duck_gb(1)} AS u, {_duck_gb(2)} AS t FROM ({_DUCK_RAW_TELEMETRY}))
"""

# Six lines per order; 50 orders make one report file. Every third order closes a script run.
_LINES = [
    "'## Normalize Dataset - meta_' || o_orderpriority || '.parquet'",
    "'- Tamaño entrada: ' || CAST(o_custkey AS STRING) || ' GB'",
    "CASE WHEN o_orderkey % 11 = 0 THEN '## Pausa' ELSE '' END",
    "'- Tiempo: ' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '.25 s' ELSE '.5 segundos' END",
    "CASE WHEN o_orderkey % 3 = 0 THEN '## Tiempo total del script' ELSE '' END",
    "CASE WHEN o_orderkey % 3 = 0 THEN '- ' || CAST(o_custkey AS STRING) || '.75 segundos' "
    "WHEN o_orderkey % 7 = 0 THEN '- Tiempo: 3.5 s' ELSE '' END",
]
_FILE = {
    "file": "'report_' || CAST(CAST(floor(o_orderkey / 50) AS BIGINT) AS STRING) || "
    "CASE WHEN CAST(floor(o_orderkey / 50) AS BIGINT) % 2 = 0 THEN '_A_EDA.md' ELSE '_B_.md' END",
    "folder": "'data/report/' || CAST(CAST(floor(o_orderkey / 50) AS BIGINT) % 7 AS STRING)",
}


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = ", ".join(_LINES)
    return orders.select(
        *[F.expr(f"{e} AS {n}") for n, e in _FILE.items()],
        F.expr("o_orderkey % 50 AS slot"),
        F.expr(f"posexplode(array({lines})) AS (i, line)"),
    ).selectExpr("folder", "file", "slot * 6 + i AS line_no", "line")


DUCK_LINES = (
    "SELECT folder, file, slot * 6 + i AS line_no, lines[i + 1] AS line FROM (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _FILE.items())
    + f", o_orderkey % 50 AS slot, [{', '.join(_LINES)}] AS lines, unnest(range(6)) AS i FROM orders)"
)


# The same lines under each form of heading, and under none.
_FORMS = [
    _LINES[0],
    "'## EDA Meta Dataset - meta_' || o_orderpriority || '_normalized.parquet'",
    "'## EDA Reviews Dataset - reviews_' || o_orderstatus || '.parquet'",
    "'## GBT Verified Purchase - Fast - [Run ' || CAST(o_custkey % 7 AS STRING) || ']'",
    "'## KMeans Clustering Amazon23 [Run ' || CAST(o_custkey % 5 AS STRING) || ']'",
    "'## Resumen'",
]
_ALL_LINES = ["CASE " + " ".join(f"WHEN o_orderkey % 6 = {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END", *_LINES[1:]]


def all_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        *[F.expr(f"{e} AS {n}") for n, e in _FILE.items()],
        F.expr("o_orderkey % 50 AS slot"),
        F.expr(f"posexplode(array({', '.join(_ALL_LINES)})) AS (i, line)"),
    ).selectExpr("folder", "file", "slot * 6 + i AS line_no", "line")


DUCK_ALL_LINES = DUCK_LINES.replace(", ".join(_LINES), ", ".join(_ALL_LINES))


def lineitem_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary label and a score in [0, 1] for metric checks."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_returnflag = 'R' AS INT) AS label", "l_discount * 5 + l_tax * 6 AS score"
    )


DUCK_SCORES = "SELECT CAST(l_returnflag = 'R' AS INT) AS label, l_discount * 5 + l_tax * 6 AS score FROM lineitem"
