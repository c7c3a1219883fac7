from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    """Stratum ``a`` holds most rows; ``c`` a single one."""
    stratum = F.when(F.col("id") < 800, "a").when(F.col("id") < 999, "b").otherwise("c")
    return spark.range(1_000).select("id", stratum.alias("s")).repartition(6).cache()


@pytest.mark.parametrize("digits", [1, 3])
def test_stratified_split_is_exact(rows, digits):
    out = sampling.exact_split(rows, ["s"], ["id"], 0.8, digits=digits).collect()
    assert Counter((r.s, r.part) for r in out) == {
        ("a", "train"): 640, ("a", "test"): 160, ("b", "train"): 159, ("b", "test"): 40, ("c", "test"): 1
    }
    assert sorted(r.id for r in out) == list(range(1_000))


@pytest.mark.parametrize("fraction", [0.0, 0.5, 1.0])
def test_split_at_index(rows, fraction):
    out = sampling.exact_split(rows, [], ["id"], fraction)
    assert out.where("part = 'train'").count() == int(1_000 * fraction)


def test_split_does_not_depend_on_partitioning(rows):
    first = sampling.exact_split(rows, ["s"], ["id"], 0.3)
    second = sampling.exact_split(rows.repartition(2).orderBy(F.desc("id")), ["s"], ["id"], 0.3)
    assert first.exceptAll(second).count() == 0


@pytest.mark.parametrize("n", [1, 37, 1_000, 5_000])
def test_keyed_rows(rows, n):
    got = {r.id for r in sampling.keyed_rows(rows, n, ["id"]).collect()}
    want = {r.id for r in rows.withColumn("h", sampling.key_hash(["id"])).orderBy("h", "id").limit(n).collect()}
    assert got == want and len(got) == min(n, 1_000)


@pytest.mark.parametrize("n", [10, 400, 2_000])
def test_random_rows_has_the_size_asked_for(rows, n):
    got = [r.id for r in sampling.random_rows(rows, n).collect()]
    assert len(got) == len(set(got)) == min(n, 1_000)


def test_fractions(rows):
    assert sampling.keyed_sample(rows, 0.0, ["id"]).count() == 0
    assert sampling.keyed_sample(rows, 1.0, ["id"]).count() == 1_000
    assert 400 < sampling.keyed_sample(rows, 0.5, ["id"]).count() < 600


def test_keyed_split_keeps_all_rows(rows):
    assert Counter(r.part for r in sampling.keyed_split(rows, 0.8, ["id"]).collect()).total() == 1_000


def test_head_rows(rows):
    assert sampling.head_rows(rows, 7).count() == 7
    assert sampling.sample_head(rows, 0.5, 20).count() == 20


def test_rows_without_a_label_are_split_like_others(spark):
    label = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3)
    rows = spark.range(900).withColumn("label", label)
    for fraction in (0.0, 0.5, 0.8, 1.0):
        got = sampling.exact_split(rows, ["label"], ["id"], fraction).groupBy("label", "part").count().collect()
        sizes = {(r.label, r.part): r["count"] for r in got}
        for value in (None, 1, 2):
            assert sizes.get((value, "train"), 0) == int(fraction * 300) and sizes.get((value, "test"), 0) == 300 - int(fraction * 300)
