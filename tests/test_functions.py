from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import clean, nested, telemetry as tf, text as tx


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_money(spark):
    assert values(spark, clean.money, ["$1,299.00", "from 9.99", None, "", "12"]) == [1299.0, None, None, None, 12.0]


def test_numbers_in_text(spark):
    assert values(spark, clean.first_number, ["3.5 pounds", "unknown", None, "1.2.3 oz"]) == [3.5, None, None, None]
    assert values(spark, clean.first_int, ["320 pages", "x", "12.7"]) == [320, None, 12]


def test_dimensions(spark):
    texts = ["5 x 6.5 x 7 inches", "5 x 6 inches", "big", None]
    assert values(spark, lambda c: clean.dimension(c, 0), texts) == [5.0, 5.0, None, None]
    assert values(spark, lambda c: clean.dimension(c, 1), texts) == [6.5, None, None, None]
    assert values(spark, lambda c: clean.dimension(c, 2), texts) == [7.0, None, None, None]


def test_first_token_and_unknown(spark):
    assert values(spark, lambda c: clean.before(c, ";"), ["Acme; 2nd", "Acme", "", None]) == ["Acme", "Acme", "", None]
    assert values(spark, clean.known, ["a", None, ""]) == ["a", "unknown", ""]


def test_millis_keep_fraction(spark):
    got = values(spark, lambda c: F.date_format(clean.from_millis(c), "yyyy-MM-dd HH:mm:ss.SSS"), [1588615855070], "bigint")
    assert got == ["2020-05-04 18:10:55.070"]


@pytest.mark.parametrize(
    ("text", "used", "total"),
    [
        ("1.752GiB / 10GiB", 1.752, 10.0),
        ("512MiB / 10GiB", 0.5, 10.0),
        ("1024KiB / 1GiB", 1 / 1024, 1.0),
        ("0B / 0B", 0.0, 0.0),
        ("3parsecs / 1GiB", 0.0, 1.0),
        ("x / 10GiB", None, None),
        ("1GiB", None, None),
        ("1GiB / 2GiB / 3GiB", None, None),
        (None, None, None),
    ],
)
def test_memory(spark, text, used, total):
    row = values(spark, tf.memory_gb, [text])[0]
    assert (row.used, row.total) == (used, total)


def test_telemetry_scalars(spark):
    assert values(spark, tf.percent, ["28.61%", "n/a", None]) == [28.61, None, None]
    assert values(spark, tf.clean_name, ["spark-worker-1", "ray-head"]) == ["worker_1", "ray_head"]
    got = values(spark, tf.compact_timestamp, ["20250617_115325", "bad"])
    assert got == [dt.datetime(2025, 6, 17, 11, 53, 25), None]


def test_duration(spark):
    lines = ["- Tiempo: 237.08 s", "- 20.33 segundos", "- Tamaño: 7.27 GB", "12s", ""]
    assert values(spark, tx.duration, lines) == [237.08, 20.33, None, 12.0, None]


def test_sections_are_not_greedy(spark):
    text = (
        "## KMeans Clustering [Run 1]\n- Inicio: a\n- Duración: 1.5 segundos\n\n"
        "## Otro\nnada\n## KMeans Clustering [Run 7]\n- Duración: 2.25 segundos\n"
    )
    got = values(spark, tx.sections, [text])[0]
    assert [(g.run, g.seconds) for g in got] == [("1", "1.5"), ("7", "2.25")]


def test_pattern_chain_and_classes(spark):
    chain = [r"\[Run (\d+)\]", r"## (\w+)"]
    assert values(spark, lambda c: tx.first_pattern(c, chain), ["## A [Run 3]", "## A", "x"]) == ["3", "A", None]
    rules = [("EDA", "EDA"), ("Reviews", "R")]
    assert values(spark, lambda c: tx.classify(c, rules, "Meta"), ["EDA Reviews", "Reviews", "?"]) == ["EDA", "R", "Meta"]


def test_folder_facts(spark):
    paths = ["/data/images/00_AMZN_Spark_X/05_Y_EDA_meta/run1/c.csv", "images/a_b/c.csv", "c.csv", "/x/images/c.csv", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    rows = df.select("i", *[c.alias(n) for n, c in tx.folder_facts(F.col("p")).items()]).orderBy("i").collect()
    assert [(r.dataset_name, r.operation_type) for r in rows] == [("00_AMZN_Spark_X", "EDA"), ("a_b", None), (None, None), (None, None), (None, None)]


def test_path_facts(spark):
    path = "data/images/00_Spark_Preproc/meta/Books/run3_meta_Toys_and_Games_stats.csv"
    df = spark.createDataFrame([(path,), ("other/file.csv",)], "p string")
    rows = df.select(*[c.alias(n) for n, c in tx.path_facts(F.col("p")).items()]).collect()
    assert tuple(rows[0]) == ("Spark", 3, "Toys_and_Games", "run3_meta_Toys_and_Games_stats.csv")
    assert tuple(rows[1]) == (None, None, "General", "file.csv")


def test_tokens(spark):
    assert values(spark, lambda c: tx.token(c, 1), ["a_b_c", "a"]) == ["b", None]
    assert values(spark, lambda c: tx.token(c, -1), ["a_b_c", "a"]) == ["c", "a"]
    assert values(spark, lambda c: tx.token(c, -2), ["a_b_c", "a"]) == ["b", None]


def test_number_formats(spark):
    assert values(spark, tx.number, [1.005, None, 2.0], "double")[1:] == ["-", "2.00"]
    assert values(spark, lambda c: tx.number(c, 3), [2.0, None], "double") == ["2.000", "-"]
    assert values(spark, tx.count_number, [3.0, 2.5, None], "double") == ["3", "2.50", "-"]


def test_labels(spark):
    assert values(spark, tx.clean_label, ["meta_Books.parquet", None]) == ["Books", "No especificado"]
    assert values(spark, tx.pretty, ["home_and_kitchen"]) == ["Home And Kitchen"]
    assert values(spark, tx.capped_run, [1, 5, 6], "int") == ["[Run 1]", "[Run 5]", "[Run X]"]
    assert values(spark, lambda c: tx.translate_keys(c, {"a": "A"}), ["a", "b"]) == ["A", None]


def test_sizes(spark):
    assert values(spark, tx.in_gb, [1024**3], "bigint") == [1.0]
    assert values(spark, tx.in_mb, [1536 * 1024], "bigint") == [1.5]


def test_null_array_has_length_minus_one(spark):
    df = spark.createDataFrame([([1, 2],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in df.select(nested.array_length("a")).collect()] == [2, 0, -1]


def test_spread_short_and_missing_arrays(spark):
    df = spark.createDataFrame([([("x", "y")],), ([],), (None,)], "a array<struct<f:string,g:string>>")
    rows = df.select(*[c.alias(n) for n, c in nested.spread_structs("a", ["f", "g"], 2).items()]).collect()
    assert [tuple(r) for r in rows] == [("x", "y", None, None), (None,) * 4, (None,) * 4]


def test_json_lookups(spark):
    df = spark.createDataFrame([('{"ISBN 10": "7", "n": {"a": 1}}',), ("{bad",), (None,)], "j string")
    out = df.select(*[c.alias(n) for n, c in nested.json_lookups("j", ["ISBN 10", "n"], "j").items()])
    assert out.columns == ["j_isbn_10_exists", "j_isbn_10_value", "j_n_exists", "j_n_value"]
    rows = [tuple(r) for r in out.collect()]
    assert rows[0] == (True, "7", True, '{"a":1}')
    assert rows[1] == (False, None, False, None) and rows[2] == (False, None, False, None)
