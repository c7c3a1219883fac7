"""Nested columns, dirty scalars, filters, unions and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import clean, nested, text as tx
from millrace.operators import combine, impute
from millrace.operators.combine import map_lookup
from millrace.plans import counting, gold, silver
from millrace.testbed import fixtures as fx
from millrace.testbed.registry import query, table

_JSON_OK = "CASE WHEN json_valid(details) THEN details END"


def _detail(key: str) -> str:
    return f"json_extract_string({_JSON_OK}, '$.\"{key}\"')"


def _text_arrays(df: DataFrame) -> DataFrame:
    """Arrays as text and structs dropped, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out.append(F.array_join(f.name, "|").alias(f.name))
        elif kind != "struct":
            out.append(F.col(f.name))
    return df.select(*out)


@query(
    "array_length",
    f"SELECT parent_asin, coalesce(len(categories), -1)::INT AS categories_length FROM ({fx.DUCK_META})",
)
def array_length(spark: SparkSession, d: str) -> DataFrame:
    df = fx.bronze_meta(spark, d)
    return df.select("parent_asin", nested.array_length("categories").alias("categories_length"))


@query("vector_length", "SELECT vec_id, len(embedding)::INT AS embedding_length FROM embeddings")
def vector_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", nested.array_length("embedding").alias("embedding_length"))


@query(
    "silver_meta",
    """
    SELECT parent_asin, main_category, title, average_rating, rating_number, description, store,
      "bought together" AS bought_together, subtitle, author, price,
      array_to_string(categories, '|') AS categories, array_to_string(features, '|') AS features,
      coalesce(len(categories), -1)::INT AS categories_length, array_to_string(categories, '|') AS categories_as_list,
      coalesce(len(features), -1)::INT AS features_length, array_to_string(features, '|') AS features_as_list, """
    + ", ".join(f"images.{c}[1] AS {n}" for c, n in nested.STRUCT_CHILDREN["images"].items())
    + ", "
    + ", ".join(f"videos.{c}[1] AS {n}" for c, n in nested.STRUCT_CHILDREN["videos"].items())
    + ", "
    + ", ".join(
        f"{_detail(k)} IS NOT NULL AS details_{nested.key_name(k)}_exists, {_detail(k)} AS details_{nested.key_name(k)}_value"
        for k in nested.DETAIL_KEYS
    )
    + f" FROM ({fx.DUCK_META})",
)
def silver_meta(spark: SparkSession, d: str) -> DataFrame:
    return _text_arrays(silver.silver_meta(fx.bronze_meta(spark, d)))


@query(
    "struct_array_first",
    f"SELECT parent_asin, images.hi_res[1] AS images_hi_res_url, images.large[1] AS images_large_url, "
    f"images.thumb[1] AS images_thumb_url, images.variant[1] AS images_variant FROM ({fx.DUCK_META})",
)
def struct_array_first(spark: SparkSession, d: str) -> DataFrame:
    added = nested.struct_firsts("images", nested.STRUCT_CHILDREN["images"])
    return fx.bronze_meta(spark, d).select("parent_asin", *[c.alias(n) for n, c in added.items()])


_SPREAD = ", ".join(f"images[{i + 1}].{f} AS images_{i}_{f}" for i in range(3) for f in nested.IMAGE_FIELDS)


@query("spread_struct_array", f"SELECT text, {_SPREAD} FROM ({fx.DUCK_REVIEWS})")
def spread_struct_array(spark: SparkSession, d: str) -> DataFrame:
    added = nested.spread_structs("images", nested.IMAGE_FIELDS)
    return fx.bronze_reviews(spark, d).select("text", *[c.alias(n) for n, c in added.items()])


@query(
    "silver_reviews",
    f"SELECT parent_asin, rating, title, text, helpful_vote, verified_purchase, asin, user_id, timestamp, {_SPREAD} FROM ({fx.DUCK_REVIEWS})",
)
def silver_reviews(spark: SparkSession, d: str) -> DataFrame:
    return silver.silver_reviews(fx.bronze_reviews(spark, d))


@query(
    "json_map",
    "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS props_k_exists, json_extract_string(props, '$.k') AS props_k_value, "
    "json_extract_string(props, '$.missing') IS NOT NULL AS props_missing_exists, json_extract_string(props, '$.missing') AS props_missing_value FROM events",
)
def json_map(spark: SparkSession, d: str) -> DataFrame:
    added = nested.json_lookups("props", ["k", "missing"], "props")
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in added.items()])


@query(
    "parse_price",
    f"SELECT p_partkey, try_cast(regexp_replace({fx.DUCK_PRICE}, '[$,]', '', 'g') AS DOUBLE) AS price FROM part",
)
def parse_price(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", clean.money(F.expr(fx.SPARK_PRICE)).alias("price"))


@query(
    "parse_number",
    f"SELECT p_partkey, try_cast(regexp_extract({fx.WEIGHT}, '([\\d\\.]+)', 1) AS DOUBLE) AS weight, "
    f"try_cast(regexp_extract({fx.HARDCOVER}, '(\\d+)', 1) AS INT) AS hardcover FROM part",
)
def parse_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey",
        clean.first_number(F.expr(fx.WEIGHT)).alias("weight"),
        clean.first_int(F.expr(fx.HARDCOVER)).alias("hardcover"),
    )


def _duck_dims(column: str) -> list[str]:
    parts = f"string_split({column}, ' x ')"
    return [f"try_cast({parts}[1] AS DOUBLE)", f"try_cast({parts}[2] AS DOUBLE)", f"try_cast(string_split({parts}[3], ' ')[1] AS DOUBLE)"]


@query(
    "parse_dimensions",
    "SELECT p_partkey, "
    + ", ".join(f"{e} AS {n}" for e, n in zip(_duck_dims("dims"), ["width", "depth", "height"]))
    + f" FROM (SELECT p_partkey, {fx.DIMS} AS dims FROM part)",
)
def parse_dimensions(spark: SparkSession, d: str) -> DataFrame:
    dims = F.expr(fx.DIMS)
    axes = ["width", "depth", "height"]
    return table(spark, d, "part").select("p_partkey", *[clean.dimension(dims, i).alias(n) for i, n in enumerate(axes)])


@query("first_token", f"SELECT p_partkey, string_split({fx.PUBLISHER}, ';')[1] AS publisher FROM part")
def first_token(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", clean.before(F.expr(fx.PUBLISHER), ";").alias("publisher"))


@query(
    "null_to_unknown",
    f"SELECT parent_asin, coalesce(main_category, 'unknown') AS main_category FROM ({fx.DUCK_META})",
)
def null_to_unknown(spark: SparkSession, d: str) -> DataFrame:
    return fx.bronze_meta(spark, d).select("parent_asin", clean.known("main_category").alias("main_category"))


@query(
    "millis_to_ts",
    "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%g') AS at FROM events",
)
def millis_to_ts(spark: SparkSession, d: str) -> DataFrame:
    at = clean.from_millis(clean.to_millis("ts"))
    return table(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


@query(
    "date_parts",
    "SELECT o_orderkey, year(o_orderdate)::INT AS review_year, month(o_orderdate)::INT AS review_month FROM orders",
)
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("review_year"), F.month("o_orderdate").alias("review_month")
    )


@query("valid_flag", f"SELECT p_partkey, CAST(({fx.PUBLISHER}) IS NOT NULL AS INT) AS has_publisher FROM part")
def valid_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", clean.has_value(F.expr(fx.PUBLISHER)).alias("has_publisher"))


_URL_PATH = "'data/images/0' || CAST(page_id % 8 AS STRING) || '_' || CASE page_id % 4 WHEN 0 THEN 'Spark' WHEN 1 THEN 'Ray' WHEN 2 THEN 'Dask' ELSE 'x' END || '/' || url || '/run' || CAST(page_id % 5 + 1 AS STRING) || CASE WHEN page_id % 2 = 0 THEN '_meta_Books_stats' ELSE '_other' END || '.csv'"


@query(
    "path_facts",
    f"""
    SELECT page_id, nullif(regexp_extract(path, '(Spark|Ray|Dask)', 1), '') AS framework,
      try_cast(nullif(regexp_extract(path, 'run(\\d+)', 1), '') AS INT) AS run_number,
      coalesce(nullif(regexp_extract(path, '(_meta_|_review_)([A-Za-z_]+)_stats', 2), ''), 'General') AS category,
      string_split(path, '/')[-1] AS file_name, string_split(string_split(path, '/')[-1], '_')[2] AS token
    FROM (SELECT page_id, {_URL_PATH} AS path FROM pages)
    """,
)
def path_facts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "pages").select("page_id", F.expr(_URL_PATH).alias("path"))
    facts = tx.path_facts(F.col("path"))
    return df.withColumns(facts).withColumn("token", tx.token(F.col("file_name"), 1)).drop("path")


@query(
    "pattern_chain",
    "SELECT doc_id, coalesce("
    + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in [r"([A-Z][A-Z][A-Z]+)", r"([0-9][0-9]+)", r"([a-z]{12,})"])
    + ") AS found FROM documents",
)
def pattern_chain(spark: SparkSession, d: str) -> DataFrame:
    patterns = [r"([A-Z][A-Z][A-Z]+)", r"([0-9][0-9]+)", r"([a-z]{12,})"]
    return table(spark, d, "documents").select("doc_id", tx.first_pattern(F.col("text"), patterns).alias("found"))


_LABEL = "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'meta_' || replace(p_name, ' ', '_') || '.parquet' END"


@query(
    "clean_labels",
    f"""
    SELECT p_partkey, label, array_to_string(list_transform(string_split(replace(label, '_', ' '), ' '),
      lambda w: upper(w[1]) || lower(w[2:])), ' ') AS pretty
    FROM (SELECT p_partkey, replace(replace(coalesce({_LABEL}, 'No especificado'), '.parquet', ''), 'meta_', '') AS label FROM part)
    """,
)
def clean_labels(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", tx.clean_label(F.expr(_LABEL)).alias("label"))
    return df.withColumn("pretty", tx.pretty(F.col("label")))


@query(
    "format_numbers",
    """
    SELECT l_returnflag, l_linestatus, format('{:.2f}', sum(l_quantity)) AS quantity, format('{:.3f}', avg(l_discount)) AS discount,
      CASE WHEN l_returnflag = 'A' THEN '-' ELSE CAST(count(*) AS VARCHAR) END AS n_rows
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def format_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("l_returnflag") != "A", F.col("n"))
    sums = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("x"), F.count(F.lit(1)).alias("n")
    )
    return sums.select(
        "l_returnflag", "l_linestatus", tx.number(F.col("q")).alias("quantity"), tx.number(F.col("x"), 3).alias("discount"),
        tx.count_number(n).alias("n_rows"),
    )


_NAMES = {"STANDARD": "Books", "PROMO": "Electronics", "SMALL": "Toys_and_Games", "ECONOMY": "Home_and_Kitchen"}


@query(
    "map_lookup",
    "SELECT p_partkey, p_type, category FROM part JOIN (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in _NAMES.items())
    + ") AS m(p_type, category) USING (p_type)",
)
def map_lookup_query(spark: SparkSession, d: str) -> DataFrame:
    return map_lookup(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", _NAMES, "category")


@query(
    "classify_text",
    "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'EDA' WHEN p_name LIKE '%red%' THEN 'Reviews' ELSE 'Meta' END AS category FROM part",
)
def classify_text(spark: SparkSession, d: str) -> DataFrame:
    category = tx.classify(F.col("p_name"), [("ring", "EDA"), ("red", "Reviews")], "Meta")
    return table(spark, d, "part").select("p_partkey", category.alias("category"))


@query("not_contains", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '%URGENT%'")
def not_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(~F.col("o_orderpriority").contains("URGENT")).select("o_orderkey", "o_orderpriority")


@query("prefix_suffix", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') AND ends_with(p_name, 'ring')")
def prefix_suffix(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, d, "part").where(name.startswith("red") & name.endswith("ring")).select("p_partkey", "p_name")


@query("layer_filter", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 AND contains(s_name, '#0000')")
def layer_filter(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier")
    return df.where((F.col("s_nationkey") == 3) & F.col("s_name").contains("#0000")).select("s_suppkey", "s_name")


@query(
    "dropna_any",
    f"SELECT p_partkey, publisher, dims FROM (SELECT p_partkey, {fx.PUBLISHER} AS publisher, {fx.DIMS} AS dims, {fx.HARDCOVER} AS other FROM part) "
    "WHERE publisher IS NOT NULL AND dims IS NOT NULL",
)
def dropna_any(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select(
        "p_partkey", F.expr(fx.PUBLISHER).alias("publisher"), F.expr(fx.DIMS).alias("dims"), F.expr(fx.HARDCOVER).alias("other")
    )
    return df.na.drop(how="any", subset=["publisher", "dims"]).drop("other")


@query(
    "multi_equality",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 3",
)
def multi_equality(spark: SparkSession, d: str) -> DataFrame:
    same = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 3)
    return table(spark, d, "lineitem").where(same).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "filter_group_count",
    "SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_returnflag",
)
def filter_group_count(spark: SparkSession, d: str) -> DataFrame:
    return counting.filter_group_count(table(spark, d, "lineitem"), F.col("l_extendedprice") > 0, "l_returnflag", "n_rows")


@query(
    "group_cardinality",
    "SELECT count(DISTINCT l_suppkey) AS n_groups FROM lineitem WHERE l_extendedprice > 0",
)
def group_cardinality(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "lineitem").where(F.col("l_extendedprice") > 0)
    return kept.agg(F.count_distinct("l_suppkey").alias("n_groups"))


@query("distinct_values", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("union_categories", "SELECT p_partkey, p_name, p_type AS dataset_category FROM part")
def union_categories(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    slices = [
        part.where(F.col("p_type") == t).select("p_partkey", "p_name", F.lit(t).alias("dataset_category")) for t in _TYPES
    ]
    return combine.union_same(slices)


@query(
    "union_ragged",
    "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::BIGINT AS suppkey FROM customer "
    "UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier",
)
def union_ragged(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").selectExpr("c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    supplier = table(spark, d, "supplier").selectExpr("s_suppkey AS suppkey", "s_acctbal AS balance", "s_name AS name")
    return combine.union_ragged([customer, supplier])


@query(
    "fill_constants",
    f"SELECT p_partkey, coalesce({fx.PUBLISHER}, 'unknown') AS publisher, coalesce({fx.DIMS}, 'none') AS dims FROM part",
)
def fill_constants(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", F.expr(fx.PUBLISHER).alias("publisher"), F.expr(fx.DIMS).alias("dims"))
    return impute.fill_constants(df, {"publisher": "unknown", "dims": "none"})


_SIZE_HOLES = "CASE WHEN p_partkey % 5 <> 0 THEN p_size END"
_PRICE_HOLES = "CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END"


@query(
    "impute_mean",
    f"""
    WITH p AS (SELECT p_partkey, {_SIZE_HOLES} AS size, {_PRICE_HOLES} AS price FROM part)
    SELECT p_partkey, coalesce(size, CAST(trunc((SELECT avg(size) FROM p)) AS INT)) AS size,
      round(coalesce(price, (SELECT avg(price) FROM p)), 6) AS price FROM p
    """,
)
def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", F.expr(_SIZE_HOLES).alias("size"), F.expr(_PRICE_HOLES).alias("price"))
    return impute.impute_means(df, ["size", "price"]).withColumn("price", F.round("price", 6))


def _duck_gold() -> str:
    meta = f"""
    SELECT parent_asin, average_rating, rating_number, coalesce(main_category, 'unknown') AS main_category, title,
      try_cast(regexp_replace(price, '[$,]', '', 'g') AS DOUBLE) AS price,
      string_split({_detail("Publisher")}, ';')[1] AS details_publisher_value, {_detail("Language")} AS details_language_value,
      try_cast(regexp_extract({_detail("Hardcover")}, '(\\d+)', 1) AS INT) AS details_hardcover_value,
      try_cast(regexp_extract({_detail("Item Weight")}, '([\\d\\.]+)', 1) AS DOUBLE) AS details_item_weight_value,
      {_duck_dims(_detail("Dimensions"))[0]} AS details_dimensions_width,
      {_duck_dims(_detail("Dimensions"))[1]} AS details_dimensions_depth,
      {_duck_dims(_detail("Dimensions"))[2]} AS details_dimensions_height, subtitle AS dataset_category
    FROM ({fx.DUCK_META})
    """
    reviews = f"SELECT parent_asin, rating, helpful_vote, CAST(verified_purchase AS INT) AS verified_purchase, timestamp AS millis FROM ({fx.DUCK_REVIEWS})"
    return f"SELECT * FROM ({meta}) JOIN ({reviews}) USING (parent_asin)"


DUCK_GOLD = _duck_gold()


def gold_frame(spark: SparkSession, d: str, hot_rows: int | None = None) -> DataFrame:
    """Part types play the categories; one pair of tables carries all of them, so one join does."""
    meta = silver.silver_meta(fx.bronze_meta(spark, d), copy_arrays=False)
    reviews = silver.silver_reviews(fx.bronze_reviews(spark, d))
    return gold.gold_join(meta, reviews, F.col("subtitle"), hot_rows)


@query("gold_join", DUCK_GOLD)
def gold_join(spark: SparkSession, d: str) -> DataFrame:
    return gold_frame(spark, d).withColumn("millis", F.unix_millis("timestamp")).drop("timestamp")


@query("gold_join_hot", DUCK_GOLD)
def gold_join_hot(spark: SparkSession, d: str) -> DataFrame:
    """The same with products of more than 40 reviews spread over salts."""
    return gold_frame(spark, d, hot_rows=40).withColumn("millis", F.unix_millis("timestamp")).drop("timestamp")


_MEAN = {c: "double" for c in gold.MEAN_FILL} | {"details_hardcover_value": "int"}


def _duck_filled(c: str) -> str:
    mean = f"(SELECT avg({c}) FROM gold)"
    if _MEAN[c] == "int":
        return f"coalesce({c}, CAST(trunc({mean}) AS INT)) AS {c}"
    return f"round(coalesce({c}, {mean}), 6) AS {c}"


@query(
    "model_data",
    f"WITH gold AS ({DUCK_GOLD}) SELECT average_rating, dataset_category, "
    + ", ".join(_duck_filled(c) for c in gold.MEAN_FILL)
    + """, coalesce(details_language_value, 'unknown') AS details_language_value,
      coalesce(details_publisher_value, 'unknown') AS details_publisher_value, CAST(price IS NOT NULL AS INT) AS has_valid_price,
      helpful_vote, main_category, rating, rating_number, month(make_timestamp(millis * 1000))::INT AS review_month,
      year(make_timestamp(millis * 1000))::INT AS review_year, verified_purchase FROM gold""",
)
def model_data(spark: SparkSession, d: str) -> DataFrame:
    df = gold.model_data(gold_frame(spark, d))
    return df.withColumns({c: F.round(c, 6) for c in gold.MEAN_FILL if _MEAN[c] == "double"})
