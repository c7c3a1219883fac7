"""Chunked windows, quantiles and ranks against brute force, one series holding most rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from millrace.operators import ordered, quantiles
from millrace.operators.lookup import lookup_join


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3_000):
        series = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        rows.append((series, i, rng.randrange(0, 40 * 3_600) * 1_000_000, rng.randrange(0, 3)))
    rows.append(("single", 9_999, 5_000_000, 1))
    return spark.createDataFrame(rows, "s string, id int, micros bigint, n int").repartition(5).cache()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def by_time():
    return Window.partitionBy("s").orderBy("micros", "id")


@pytest.mark.parametrize("size", [1, 200, 10_000])
def test_running_sum(events, size):
    chunked = ordered.balanced_chunks(events, "micros", rows_per_chunk=size)
    for inclusive, last in ((True, 0), (False, -1)):
        got = ordered.running_sum(chunked, ["s"], "__chunk", ["micros", "id"], F.col("n"), "t", inclusive)
        plain = events.withColumn("t", F.sum("n").over(by_time().rowsBetween(Window.unboundedPreceding, last)))
        want = plain.withColumn("t", F.coalesce("t", F.lit(0))) if not inclusive else plain
        assert rows_of(got.withColumn("t", F.coalesce("t", F.lit(0))), "s", "id", "t") == rows_of(want, "s", "id", "t")


@pytest.mark.parametrize("size", [1, 10_000])
def test_previous_and_row_numbers(events, size):
    chunked = ordered.balanced_chunks(events, "micros", rows_per_chunk=size)
    got = ordered.with_previous(chunked, ["s"], "__chunk", ["micros", "id"], "id", "p")
    assert rows_of(got, "s", "id", "p") == rows_of(events.withColumn("p", F.lag("id").over(by_time())), "s", "id", "p")
    numbered = ordered.row_numbers(chunked, ["s"], "__chunk", ["micros", "id"], "r")
    assert rows_of(numbered, "s", "id", "r") == rows_of(events.withColumn("r", F.row_number().over(by_time()).cast("bigint")), "s", "id", "r")


def test_segments(events):
    cut = ordered.segments(events, ["s"], "micros", ["micros", "id"], 300, rows_per_chunk=50)
    durations = ordered.segment_durations(cut, ["s"], "micros")
    assert durations.agg(F.sum("n_rows")).first()[0] == events.count()
    gap = F.col("micros") - F.lag("micros").over(by_time())
    plain = events.withColumn("jump", F.coalesce((gap > 300_000_000).cast("int"), F.lit(0)))
    want = plain.withColumn("segment", F.sum("jump").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    assert rows_of(cut, "s", "id", "segment") == rows_of(want, "s", "id", "segment")
    single = durations.where("s = 'single'").first()
    assert (single.duration_seconds, single.n_rows) == (0.0, 1)


@pytest.mark.parametrize("size", [5, 64, 10_000])
def test_look_back_over_block_borders(spark, size):
    rng = random.Random(3)
    rows = [(f, i, f"h{i}" if rng.random() < 0.15 else None, 1 if rng.random() < 0.2 else None) for f in "xy" for i in range(300)]
    df = spark.createDataFrame(rows, "f string, line_no bigint, h string, m int")
    got = ordered.look_back(df, ["f"], "line_no", {"near": (F.col("h"), 4), "after": (F.col("m"), 1)}, size)
    w = Window.partitionBy("f").orderBy("line_no")
    want = df.withColumns(
        {"near": F.last("h", ignorenulls=True).over(w.rowsBetween(-4, -1)), "after": F.lag("m").over(w)}
    )
    assert rows_of(got, "f", "line_no", "near", "after") == rows_of(want, "f", "line_no", "near", "after")


@pytest.mark.parametrize("chunks", [2, 16, 1024])
def test_quantiles_match_numpy(spark, chunks):
    rng = np.random.default_rng(11)
    groups = {
        "hot": rng.lognormal(2, 2, 2_000),
        "ties": np.repeat([1.0, 2.0], [300, 100]),
        "pair": np.array([1.0, 4.0]),
        "one": np.array([7.5]),
        "negative": -rng.random(51) * 1e6,
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.g, r.probability): r.quantile for r in quantiles.group_quantiles(df, ["g"], "v", probabilities, chunks).collect()}
    assert set(got) == {(g, p) for g in groups for p in probabilities}
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], p), rel=1e-12, abs=1e-12)


def test_boxplot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    row = quantiles.boxplot_numbers(spark.createDataFrame([("a", v) for v in values], "g string, v double"), ["g"], "v").first()
    assert (row.q25, row.median, row.q75) == (2.25, 3.5, 4.75)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (1.0, 5.0, 1)


def test_auc_with_ties(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(500)]
    got = quantiles.rank_auc(spark.createDataFrame(rows, "score double, y int"), "score", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert got.auc == pytest.approx(wins / (len(pos) * len(neg)))


def test_lookup_join_with_and_without_broadcast(spark):
    big = spark.range(1_000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50))
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    fits = rows_of(lookup_join(big, small, ["k"]), "id", "k", "v")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert fits == rows_of(lookup_join(big, small, ["k"]), "id", "k", "v") and len(fits) == 1_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    null = spark.createDataFrame([(None, 7), (1, 8)], "k long, v long")
    assert lookup_join(null.select("k"), null, ["k"]).count() == 1
    assert rows_of(lookup_join(null.select("k"), null, ["k"], null_safe=True).where("k is null"), "k", "v") == [(None, 7)]


def test_quantiles_with_infinite_values(spark):
    values = [float("-inf"), -5.0, 0.0, 1.0, 2.0, 3.0, float("inf"), float("inf")]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {r.probability: r.quantile for r in quantiles.group_quantiles(df, ["g"], "v", [2 / 7, 3 / 7, 4 / 7], 2).collect()}
    assert got == {2 / 7: 0.0, 3 / 7: 1.0, 4 / 7: 2.0}


@pytest.mark.parametrize("size", [1, 2, 30, 10_000])
def test_balanced_chunks_keep_the_order_and_the_size(spark, size):
    rng = random.Random(1)
    df = spark.createDataFrame([(int(rng.lognormvariate(15, 3)),) for _ in range(4_000)], "v bigint")
    rows = sorted((r.v, r["__chunk"]) for r in ordered.balanced_chunks(df, "v", rows_per_chunk=size).collect())
    chunks = [c for _, c in rows]
    assert chunks == sorted(chunks)
    biggest = max(chunks.count(c) for c in set(chunks))
    assert biggest <= max(2 * size + 8, 30)
