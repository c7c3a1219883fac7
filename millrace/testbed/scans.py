"""Scans, sinks, file discovery and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import projection as pj
from millrace.operators.batches import count_batches
from millrace.operators.documents import collected_document
from millrace.operators.profile import columns_by_type
from millrace.operators.reports import json_documents, numbered_lines
from millrace.plans.counting import filter_group_count
from millrace.plans.silver import silver_reviews
from millrace.session import work_dir
from millrace.sources import discovery, inventory, tables
from millrace.testbed import fixtures as fx
from millrace.testbed.registry import query, table

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_ORDERS_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
)


@query("scan_count", "SELECT count(*) AS n_rows FROM lineitem")
def scan_count(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_parquet(spark, f"{d}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n_rows"))


@query("read_count", "SELECT count(*) AS n_rows, 6::BIGINT AS n_columns FROM orders")
def read_count(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


@query(
    "csv_roundtrip",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
)
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark, "orders-csv")
    tables.write_csv(table(spark, d, "orders"), path)
    back = tables.read_csv(spark, path, _ORDERS_SCHEMA)
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("parquet_roundtrip", "SELECT * FROM customer")
def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark, "customer")
    tables.write_parquet(table(spark, d, "customer"), path)
    return tables.read_parquet(spark, path)


@query(
    "append_then_count",
    "SELECT n_regionkey, 2 * count(*) AS n_rows, count(DISTINCT n_nationkey) AS n_nations FROM nation GROUP BY n_regionkey",
)
def append_then_count(spark: SparkSession, d: str) -> DataFrame:
    path, nation = work_dir(spark, "nation"), table(spark, d, "nation")
    tables.write_parquet(nation, path)
    tables.write_parquet(nation, path, mode="append")
    return (
        tables.read_parquet(spark, path)
        .groupBy("n_regionkey")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("n_nationkey").alias("n_nations"))
    )


@query("repartitioned_write", "SELECT o_orderpriority, count(*) AS n_rows, 16::BIGINT AS n_files FROM orders GROUP BY ALL")
def repartitioned_write(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark, "orders-16")
    tables.write_parquet(table(spark, d, "orders"), path, files=16)
    back = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    files = back.agg(F.count_distinct("file")).scalar()
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_files", files)


@query(
    "target_sized_write",
    "SELECT kind, count(*) AS n_rows, true AS near_target, CASE WHEN kind = 'hot' THEN 1 ELSE count(DISTINCT l_partkey) END AS n_keys "
    "FROM lineitem, (VALUES ('hot'), ('as_is')) v(kind) GROUP BY kind",
)
def target_sized_write(spark: SparkSession, d: str) -> DataFrame:
    """Files of an eighth of the table's size, from rows as they are and from rows of one key. Sizes may be off by a factor of two."""
    rows = table(spark, d, "lineitem").drop("l_shipdate")
    out = []
    for kind, source in (("as_is", rows), ("hot", rows.withColumn("l_partkey", F.lit(7).cast("bigint")))):
        root = work_dir(spark, kind)
        tables.write_parquet(source, f"{root}/one")  # as the rows come: one file would be one task's work
        target = tables.bytes_below(spark, spark.read.parquet(f"{root}/one").inputFiles()) // 8
        tables.write_parquet(source, f"{root}/sized", target_bytes=target)
        sizes = inventory.list_files(spark, [inventory.resolved(spark, f"{root}/sized")]).where("path LIKE '%.parquet'")
        near = sizes.agg(F.bool_and(F.col("size_bytes").between(target / 2, target * 2))).scalar()
        back = spark.read.parquet(f"{root}/sized")
        counts = F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_partkey").alias("n_keys")
        out.append(back.agg(*counts).select(F.lit(kind).alias("kind"), "n_rows", near.alias("near_target"), "n_keys"))
    return out[0].unionByName(out[1])


@query("silver_reviews_passthrough", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def silver_reviews_passthrough(spark: SparkSession, d: str) -> DataFrame:
    path = work_dir(spark, "passthrough")
    tables.write_parquet(silver_reviews(table(spark, d, "orders")), path)
    return spark.read.parquet(path).drop("o_orderdate")


@query("json_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, customer = work_dir(spark, "customer-json"), table(spark, d, "customer")
    tables.write_json(customer, path)
    return spark.read.schema(customer.schema).json(path)


@query(
    "inventory_json",
    """
    WITH runs AS (
      SELECT CAST(o_custkey AS VARCHAR) AS script, o_orderkey, o_orderstatus,
        min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_key FROM orders)
    SELECT script, 0 AS section, o_orderkey AS sort_key,
      CASE WHEN o_orderkey = first_key THEN '' ELSE ',' END || '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS line
    FROM runs
    UNION ALL SELECT DISTINCT script, -1, NULL, '{"script":"' || script || '","runs":[' FROM runs
    UNION ALL SELECT DISTINCT script, 1, NULL, ']}' FROM runs
    """,
)
def inventory_json(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").withColumn("script", F.col("o_custkey").cast("string"))
    return json_documents(runs, "script", "o_orderkey", ["o_orderkey", "o_orderstatus"])


_COLLECTED = f"""
    WITH s AS (SELECT 'op_' || event_type AS name, user_id % 5 + 1 AS run, event_id, user_id FROM events WHERE user_id IS NOT NULL),
    n AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (SELECT DISTINCT name FROM s)),
    r AS (SELECT name, run, row_number() OVER (PARTITION BY name ORDER BY run) AS i FROM (SELECT DISTINCT name, run FROM s)),
    l AS (SELECT file AS name, line_no, line FROM ({fx.DUCK_LINES})),
    t AS (SELECT name, min(line_no) AS least, row_number() OVER (ORDER BY name) AS i FROM l GROUP BY name),
    f AS (SELECT 'customer.parquet' AS file, (SELECT count(*) FROM customer) AS n, '' AS c UNION ALL SELECT 'orders.parquet', (SELECT count(*) FROM orders), ','),
    entries AS (SELECT *, row_number() OVER (PARTITION BY name, run ORDER BY event_id) AS i FROM s)
    SELECT CAST(part AS INT) AS part, name, CAST(run AS BIGINT) AS run, CAST(level AS INT) AS level, CAST(sort_key AS BIGINT) AS sort_key, later, line FROM (
      SELECT 0 AS part, NULL AS name, NULL AS run, NULL AS level, NULL AS sort_key, NULL AS later, '{{"metrics":{{' AS line
      UNION ALL SELECT 2, NULL, NULL, NULL, NULL, NULL, '}},' UNION ALL SELECT 3, NULL, NULL, NULL, NULL, NULL, '"reports":{{'
      UNION ALL SELECT 5, NULL, NULL, NULL, NULL, NULL, '}},' UNION ALL SELECT 6, NULL, NULL, NULL, NULL, NULL, '"files":['
      UNION ALL SELECT 8, NULL, NULL, NULL, NULL, NULL, ']}}'
      UNION ALL SELECT 1, name, NULL, -2, NULL, false, CASE WHEN i > 1 THEN ',' ELSE '' END || '"' || name || '":[' FROM n
      UNION ALL SELECT 1, name, 9223372036854775807, 2, NULL, false, ']' FROM n
      UNION ALL SELECT 1, name, run, -1, NULL, false, CASE WHEN i > 1 THEN ',' ELSE '' END || '{{"run":' || run || ',"data":[' FROM r
      UNION ALL SELECT 1, name, run, 1, NULL, false, ']}}' FROM r
      UNION ALL SELECT 1, name, run, 0, event_id, i > 1, CASE WHEN i > 1 THEN ',' ELSE '' END || '{{"event_id":' || event_id || ',"user_id":' || user_id || '}}' FROM entries
      UNION ALL SELECT 4, name, NULL, -1, NULL, false, CASE WHEN i > 1 THEN ',' ELSE '' END || '"' || name || '":"' FROM t
      UNION ALL SELECT 4, name, NULL, 1, NULL, false, '"' FROM t
      UNION ALL SELECT 4, l.name, NULL, 0, line_no, false, CASE WHEN line_no > least THEN '\\n' ELSE '' END || line FROM l JOIN t ON l.name = t.name
      UNION ALL SELECT 7, NULL, NULL, 0, NULL, c = ',', c || '{{"file":"' || file || '","n_rows":' || n || '}}' FROM f)
"""


@query("collected_document", _COLLECTED)
def collected_document_query(spark: SparkSession, d: str) -> DataFrame:
    """Samples of runs, report texts and the inventory of two tables, as the fragments of one document."""
    samples = table(spark, d, "events").select(
        F.concat(F.lit("op_"), "event_type").alias("name"), (F.col("user_id") % 5 + 1).alias("run"), "event_id", "user_id"
    )
    lines = fx.report_lines(spark, d).select(F.col("file").alias("name"), "line_no", "line")
    found = inventory.file_inventory(spark, [f"{d}/customer.parquet", f"{d}/orders.parquet"])
    return collected_document(samples, ["event_id", "user_id"], "event_id", lines, found, ["file", "n_rows"])


@query(
    "partial_final_count",
    "SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_returnflag",
)
def partial_final_count(spark: SparkSession, d: str) -> DataFrame:
    """Partial and final counting are what a Spark aggregate does; the scan is asked for 16 tasks."""
    scan = tables.read_parallel(spark, f"{d}/lineitem.parquet", 16)
    return filter_group_count(scan, F.col("l_extendedprice") > 0, "l_returnflag", "n_rows")


@query(
    "map_batches_count",
    "SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_returnflag",
)
def map_batches_count(spark: SparkSession, d: str) -> DataFrame:
    partial = count_batches(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return partial.groupBy("l_returnflag").agg(F.sum("count").alias("n_rows"))


@query("file_provenance", "SELECT p_type AS category, p_size % 5 + 1 AS run_number, 'Spark' AS framework, count(*) AS n_rows FROM part GROUP BY ALL")
def file_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Parts written to one folder per type and run, found again by name pattern and told apart by path."""
    root = work_dir(spark, "Spark-parts")
    part = table(spark, d, "part").withColumns(
        {"folder": F.concat(F.lit("x_meta_"), "p_type", F.lit("_stats")), "run": F.concat(F.lit("run"), F.col("p_size") % 5 + 1)}
    )
    tables.write_parquet(part, root, partition_by=["folder", "run"])
    found = discovery.with_path_facts(discovery.read_found(spark, root, "*.parquet"))
    return found.groupBy("category", "run_number", "framework").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "file_inventory",
    "SELECT file, n_rows, n_columns FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS file, (SELECT count(*) FROM {t}) AS n_rows, "
        f"(SELECT count(*) FROM (DESCRIBE {t}))::INT AS n_columns"
        for t in ALL_TABLES
    )
    + ")",
)
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Sizes are part of the inventory but not of the comparison: SQL cannot see them."""
    listed = discovery.table_inventory(spark, [f"{d}/{t}.parquet" for t in ALL_TABLES])
    return listed.where("size_bytes > 0 AND size_mb IS NOT NULL").select("file", "n_rows", "n_columns")


@query(
    "folder_inventory",
    """
    SELECT 'by status/o_orderstatus=' || o_orderstatus AS folder, 'parquet' AS format, count(*) AS n_rows, 5::INT AS n_columns,
      0::BIGINT AS n_unreadable FROM orders GROUP BY ALL
    UNION ALL SELECT 'csv+files', 'csv', count(*), 5, 0 FROM customer
    UNION ALL SELECT 'none', 'parquet', 0, (SELECT count(*) FROM (DESCRIBE nation))::INT, 0
    UNION ALL SELECT 'broken', 'parquet', NULL, NULL, 2
    """,
)
def folder_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as Parquet and CSV below folders of odd names, one of them empty, next to two files that are none."""
    root = work_dir(spark, "inventory")
    tables.write_parquet(table(spark, d, "orders").repartition(3), f"{root}/by status", partition_by=["o_orderstatus"])
    tables.write_csv(table(spark, d, "customer"), f"{root}/csv+files")
    tables.write_parquet(table(spark, d, "nation").limit(0), f"{root}/none")
    broken = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/broken")
    files = broken.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, content in (("empty.parquet", b""), ("text.parquet", b"no footer here")):
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(broken, name))
        out.write(content)
        out.close()
    found = inventory.file_inventory(spark, [root])
    folder = F.element_at(F.split("directory", root.rsplit("/", 1)[1] + "/"), -1).alias("folder")
    return found.groupBy(folder, "format").agg(
        F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"), F.count("error").alias("n_unreadable")
    )


@query("file_sizes")
def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    return discovery.file_sizes(spark, d, "*.parquet").drop("directory", "path")


@query("range_sum", "SELECT sum(i)::BIGINT AS total, count(*) AS n_rows FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i)")
def range_sum(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").count()
    return tables.numbers(spark, n).agg(F.sum("id").alias("total"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "numeric_projection",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def numeric_projection(spark: SparkSession, d: str) -> DataFrame:
    return pj.numeric_projection(table(spark, d, "lineitem"))


@query(
    "columns_by_type",
    "SELECT n_rows, kind, n_columns, columns FROM (SELECT count(*) AS n_rows FROM lineitem), (VALUES "
    "('numeric', 8, 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax'), "
    "('string', 2, 'l_returnflag,l_linestatus'), ('other', 1, 'l_shipdate')) AS v(kind, n_columns, columns)",
)
def columns_by_type_query(spark: SparkSession, d: str) -> DataFrame:
    return columns_by_type(table(spark, d, "lineitem"))


@query(
    "rename_spaces",
    "SELECT c_custkey, c_name AS customer_name, c_acctbal AS account_balance_now, c_mktsegment FROM customer",
)
def rename_spaces(spark: SparkSession, d: str) -> DataFrame:
    spaced = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("customer name"), F.col("c_acctbal").alias("account balance now"), "c_mktsegment"
    )
    return pj.rename_spaces(spaced)


@query("drop_missing_ok", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def drop_missing_ok(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").drop("p_type", "no_such_column")


@query("sorted_columns", "SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders")
def sorted_columns(spark: SparkSession, d: str) -> DataFrame:
    return pj.sorted_columns(table(spark, d, "orders").drop("o_orderdate"))


@query("bool_to_int", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS is_final FROM orders")
def bool_to_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("is_final"))


@query(
    "conform_schema",
    "SELECT c_name AS name, '' AS segment, c_acctbal AS balance, 'customer' AS origin FROM customer "
    "UNION ALL SELECT s_name, '', s_acctbal, 'supplier' FROM supplier",
)
def conform_schema(spark: SparkSession, d: str) -> DataFrame:
    required = ["name", "segment", "balance", "origin"]
    customer = table(spark, d, "customer").selectExpr("c_acctbal AS balance", "c_name AS name", "'customer' AS origin")
    supplier = table(spark, d, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance", "'supplier' AS origin")
    return pj.conform(customer, required).unionByName(pj.conform(supplier, required))


@query(
    "schema_report",
    "SELECT * FROM (VALUES (1, 'n_nationkey', 'numeric', 'int'), (2, 'n_name', 'string', 'string'), "
    "(3, 'n_regionkey', 'numeric', 'int')) AS v(position, \"column\", kind, type), (SELECT count(*) AS n_values FROM nation)",
)
def schema_report(spark: SparkSession, d: str) -> DataFrame:
    return pj.schema_report(table(spark, d, "nation"))


@query(
    "report_lines",
    "SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM "
    "(SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)",
)
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = numbered_lines(table(spark, d, "documents"), "text", ["doc_id"])
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))
