from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import combine, impute, profile, telemetry as tm
from millrace.operators.projection import conform, numeric_projection, schema_report
from millrace.plans import counting, gold, silver, telemetry_report, timing
from millrace.testbed import fixtures as fx

MODEL_TYPES = {
    "average_rating": "double", "dataset_category": "string", "details_dimensions_depth": "double",
    "details_dimensions_height": "double", "details_dimensions_width": "double", "details_hardcover_value": "int",
    "details_item_weight_value": "double", "details_language_value": "string", "details_publisher_value": "string",
    "has_valid_price": "int", "helpful_vote": "bigint", "main_category": "string", "price": "double", "rating": "double",
    "rating_number": "bigint", "review_month": "int", "review_year": "int", "verified_purchase": "int",
}


def test_bronze_to_model_data_through_files(spark, sf_dir, tmp_path):
    """The whole chain as jobs, two categories; an inner join on a unique key keeps every review."""
    for c in ("Books", "Toys"):
        fx.bronze_meta(spark, sf_dir).write.parquet(f"{tmp_path}/bronze/meta_{c}")
        fx.bronze_reviews(spark, sf_dir).write.parquet(f"{tmp_path}/bronze/reviews_{c}")
        silver.silver_meta_job(spark, f"{tmp_path}/bronze/meta_{c}", f"{tmp_path}/silver/meta_{c}")
        silver.silver_reviews_job(spark, f"{tmp_path}/bronze/reviews_{c}", f"{tmp_path}/silver/reviews_{c}")
    gold.gold_job(spark, f"{tmp_path}/silver/meta_{{}}", f"{tmp_path}/silver/reviews_{{}}", f"{tmp_path}/gold", ["Books", "Toys"])
    n_reviews = fx.bronze_reviews(spark, sf_dir).count()
    joined = spark.read.parquet(f"{tmp_path}/gold")
    assert {r[0]: r[1] for r in joined.groupBy("dataset_category").count().collect()} == {"Books": n_reviews, "Toys": n_reviews}
    assert set(joined.columns) == {*gold.META_COLUMNS, *gold.REVIEW_COLUMNS}
    gold.model_data_job(spark, f"{tmp_path}/gold", f"{tmp_path}/model")
    model = spark.read.parquet(f"{tmp_path}/model")
    assert dict(model.dtypes) == MODEL_TYPES and model.columns == sorted(model.columns)
    assert model.na.drop().count() == 2 * n_reviews


def test_silver_meta_shape(spark, sf_dir):
    out = silver.silver_meta(fx.bronze_meta(spark, sf_dir))
    assert "details" not in out.columns and "bought_together" in out.columns
    assert len(out.columns) == 16 - 1 + 2 * 2 + 4 + 3 + 7 * 2
    slim = silver.silver_meta(fx.bronze_meta(spark, sf_dir), copy_arrays=False)
    assert not [c for c in slim.columns if c.endswith("_as_list")]


def test_hot_products_change_nothing(spark):
    meta = spark.range(20).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10).alias("v"))
    hot = F.when(F.col("id") % 3 > 0, F.lit("7")).when(F.col("id") % 5 == 0, F.lit(None)).otherwise((F.col("id") % 25).cast("string"))
    reviews = spark.range(2_000).select(hot.alias("k"), "id")
    assert [tuple(r) for r in combine.hot_salts(reviews, "k", 500).collect()] == [("7", 3)]
    assert combine.hot_salts(reviews, "k", 10**6).collect() == []
    plain = reviews.join(meta, "k").select("k", "id", "v")
    for rows in (500, 3, 10**6):
        split = combine.skew_join(reviews, meta, "k", rows).select("k", "id", "v")
        assert split.exceptAll(plain).count() == plain.exceptAll(split).count() == 0


def test_a_hot_key_is_dealt_over_salts(spark):
    """One key of all rows: no partition of the join has more than its share, and the plan holds no list of keys."""
    meta = spark.range(5).select(F.col("id").cast("string").alias("k"), "id")
    reviews = spark.range(8_000).select(F.lit("3").alias("k"), F.col("id").alias("r"))
    joined = combine.skew_join(reviews, meta, "k", 100)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 8_000 and max(sizes) < 3_000
    assert " IN (" not in joined._jdf.queryExecution().toString()


def test_gold_categories_stack(spark, sf_dir):
    meta = silver.silver_meta(fx.bronze_meta(spark, sf_dir), copy_arrays=False)
    reviews = silver.silver_reviews(fx.bronze_reviews(spark, sf_dir))
    both = gold.gold_table({"A": meta, "B": meta}, {"A": reviews, "B": reviews}, hot_rows=30)
    assert both.columns == gold.META_COLUMNS + gold.REVIEW_COLUMNS[1:]
    assert both.count() == 2 * reviews.count()


def test_count_job_reports_from_one_run(spark, sf_dir, tmp_path):
    found = counting.filter_group_count_job(
        spark, f"{sf_dir}/lineitem.parquet", str(tmp_path / "out"), F.col("l_quantity") > 25, "l_returnflag"
    )
    source = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kept = source.where("l_quantity > 25")
    assert found == {"rows_read": source.count(), "rows_kept": kept.count(), "groups": 3}
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0] == kept.count()


def test_imputation_edges(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, None), (2, float("nan"), None, None), (4, None, None, 3.0)], "i int, x double, e double, y double"
    )
    holes = df.withColumn("i", F.when(F.col("i") != 2, F.col("i")))
    out = impute.impute_means(holes.where("i IS NULL OR i > 0"), ["i", "e", "y"]).orderBy("y").collect()
    assert sorted(r.i for r in out) == [1, 2, 4]  # mean 2.5 truncated
    assert all(r.e is None for r in out) and all(r.y == 3.0 for r in out)
    filled = impute.impute_means(df.where("i <> 2"), ["x"]).collect()
    assert [r.x for r in filled] == [1.0, 1.0]


def test_profile_with_booleans_nans_and_batches(spark):
    df = spark.createDataFrame(
        [(1, "NaN", True, 1.0), (1, None, None, float("nan")), (None, "a", False, float("nan"))],
        "i int, s string, b boolean, x double",
    )
    for size in (1, 3, 8):
        got = {r.column: (r.n_rows, r.nulls, r.nans, r.uniques) for r in profile.column_profile(df, columns_per_pass=size).collect()}
        assert got == {"i": (3, 1, 0, 1), "s": (3, 1, 1, 2), "b": (3, 1, 0, 2), "x": (3, 0, 2, 2)}
    assert profile.column_profile(df, approximate=True).count() == 4
    assert {r.column: r.is_binary for r in profile.binary_columns(df).collect()} == {"i": False, "b": False, "x": False}


def test_describe_covers_text(spark):
    df = spark.createDataFrame([("b", 2), ("a", 4), (None, None)], "s string, n int")
    rows = {r.column: r for r in profile.describe_columns(df).collect()}
    assert (rows["s"].n_values, rows["s"].min_text, rows["s"].max_text, rows["s"].mean) == (2, "a", "b", None)
    assert (rows["n"].mean, rows["n"].min_number, rows["n"].max_number) == (3.0, 2.0, 4.0)


def test_projection_helpers(spark):
    df = spark.createDataFrame([(None, "x", 1.5)], "a int, b string, c double")
    assert numeric_projection(df).columns == ["a", "c"]
    assert conform(df, ["c", "z"]).collect()[0].z == ""
    assert [(r.column, r.n_values) for r in schema_report(df).collect()] == [("a", 0), ("b", 1), ("c", 1)]


def test_reindex_keeps_order_and_gaps(spark):
    df = spark.createDataFrame([("b", 1.0), ("z", 2.0)], "name string, v double")
    out = combine.reindex(df, "name", ["a", "b"]).orderBy("position").collect()
    assert [(r.name, r.v) for r in out] == [("a", None), ("b", 1.0)]


def test_single_sample_has_no_deviation(spark):
    df = spark.createDataFrame([("w", 1.0, 2.0)], "name string, cpu_perc double, mem_used_GB double")
    row = tm.wide_stats(tm.container_stats(df)).first()
    assert row.cpu_perc_std is None and row.cpu_perc_q25 == row.cpu_perc_median == 1.0


# Recorded seconds of five runs, their published mean and deviation.
RECORDED = {
    "meta_Books.parquet": ([237.08, 245.29, 255.59, 256.74, 260.09], 250.96, 9.53),
    "meta_Toys_and_Games.parquet": ([27.21, 29.24, 27.19, 29.56, 29.29], 28.5, 1.19),
}
# One recorded sample per container, with the memory in GB published for it.
SAMPLES = [
    ("spark-worker-1", "145.00%", "237MiB / 10GiB", 145.0, 0.2314453125),
    ("spark-worker-5", "154.17%", "233.9MiB / 10GiB", 154.17, 0.22841796875),
    ("spark-worker-4", "172.38%", "239.5MiB / 10GiB", 172.38, 0.23388671875),
    ("spark-worker-2", "100.12%", "189.4MiB / 10GiB", 100.12, 0.1849609375),
    ("spark-worker-3", "61.57%", "153.5MiB / 10GiB", 61.57, 0.14990234375),
    ("spark-master", "130.86%", "848.8MiB / 4GiB", 130.86, 0.82890625),
]


def test_recorded_telemetry(spark):
    rows = [("run2", "20250620_124944", n, c, m) for n, c, m, _, _ in SAMPLES]
    raw = spark.createDataFrame(rows, "source string, timestamp string, name string, cpu_perc string, mem_usage string")
    out = telemetry_report.container_report(raw).orderBy("position").collect()
    assert [r.name for r in out] == tm.CONTAINER_ORDER
    for name, _, _, cpu, memory in SAMPLES:
        row = next(r for r in out if r.name == name)
        for s in ("mean", "min", "max", "median", "q25", "q75"):
            assert (row[f"cpu_perc_{s}"], row[f"mem_used_GB_{s}"]) == (cpu, memory)
        assert row.cpu_perc_std is None and row.name_clean == name.replace("-", "_").replace("spark_", "")


def test_report_text_to_summary(spark):
    runs = max(len(t) for t, _, _ in RECORDED.values())
    lines = []
    for i in range(runs):
        for name, (seconds, _, _) in RECORDED.items():
            if i < len(seconds):
                lines += [f"## Normalize Dataset - {name}", "- Tamaño entrada: 7.27 GB", "- Tamaño salida: 9 GB", f"- Tiempo: {seconds[i]} s", ""]
        lines += ["", "## Tiempo total del script", "- 616.97 segundos"]
    df = spark.createDataFrame([("d", "00_A_report.md", i, l) for i, l in enumerate(lines)], "folder string, file string, line_no bigint, line string")
    rows = timing.timing_rows(df)
    assert rows.columns == ["file", "folder", "run", "dataset", "category", "time_seconds"]
    got = {r.dataset: r for r in timing.timing_summary([rows]).collect()}
    for name, (seconds, mean, std) in RECORDED.items():
        row = got[name.removeprefix("meta_").removesuffix(".parquet")]
        assert (row.n_runs, row.mean, row.std) == (len(seconds), mean, std)
        assert (row.min, row.max) == (min(seconds), max(seconds))


def test_runs_side_by_side(spark):
    rows = [
        (f"run{r}", f"2025010{r}_00000{i}", name, f"{10 * r + i}%", "1GiB / 2GiB", r)
        for r in (1, 2) for i in (0, 2) for name in ("spark-master", "spark-worker-1")
    ]
    raw = spark.createDataFrame(rows, "source string, timestamp string, name string, cpu_perc string, mem_usage string, run int")
    out = telemetry_report.run_comparison(raw, "run", [1, 2, 3], "cpu_perc", ["spark-worker-1", "spark-worker-2"])
    assert [tuple(r) for r in out.orderBy("position").collect()] == [
        ("spark-worker-1", 0, 11.0, 21.0, None), ("spark-worker-2", 1, None, None, None)
    ]


def test_column_means_skip_nulls_but_not_nans(spark):
    df = spark.createDataFrame([(1, 1.0), (None, float("nan")), (4, None)], "i int, x double")
    row = profile.column_means(df, ["i", "x"]).first()
    assert row.i == 2.5 and row.x != row.x
