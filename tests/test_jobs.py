"""The jobs as a user calls them, on files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.sources import tables

LINE = "2025010{}_00000{},c,{},{}%,1GiB / 2GiB,1%,0B / 0B,0B / 0B,8"


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    df = spark.range(400).select(
        F.rand(1).alias("price"), (F.col("id") % 7).alias("n"), (F.rand(1) > 0.5).cast("int").alias("verified_purchase"),
        F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("main_category"),
    )
    tables.write_parquet(df, f"{path}/t")
    tables.write_csv(df, f"{path}/csv")
    return path


def test_cluster_jobs(spark, model, capsys):
    main(["kmeans", f"{model}/t", f"{model}/k"])
    assert spark.read.parquet(f"{model}/k").count() == 400
    assert "5:" in capsys.readouterr().out
    main(["kmeans", f"{model}/t", f"{model}/ks", "--sample", "100"])
    assert spark.read.parquet(f"{model}/ks").count() == 100
    main(["kmeans-head", f"{model}/t", f"{model}/kh"])
    assert spark.read.parquet(f"{model}/kh").columns == ["price", "n", "verified_purchase", "cluster"]


def test_gbt_from_parquet_and_csv(spark, model, capsys):
    main(["gbt", f"{model}/t", f"{model}/g"])
    schema = "price double, n bigint, verified_purchase int, main_category string"
    main(["gbt", f"{model}/csv", f"{model}/gc", "--csv-schema", schema])
    areas = [float(x) for x in capsys.readouterr().out.split()]
    assert len(areas) == 2 and all(a > 0.95 for a in areas)
    assert spark.read.parquet(f"{model}/g").columns == ["prediction", "probability", "verified_purchase"]


def test_count_and_profile(spark, model):
    main(["count", f"{model}/t", f"{model}/c"])
    assert {r.main_category: r["count"] for r in spark.read.parquet(f"{model}/c").collect()} == {"a": 100, "b": 300}
    main(["profile", f"{model}/t,{model}/c", f"{model}/p"])
    rows = {(r.source.rsplit("/", 1)[1], r.column): r.uniques for r in spark.read.parquet(f"{model}/p").collect()}
    assert rows["t", "n"] == 7 and rows["c", "main_category"] == 2


def test_telemetry_job(spark, tmp_path):
    lines = [LINE.format(1, i, name, cpu) for i, (name, cpu) in enumerate([("spark-master", 10), ("spark-master", 30)])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x__run1.csv").write_text("\n".join(lines) + "\n")
    main(["telemetry", str(tmp_path / "in"), str(tmp_path / "out")])
    rows = {r.name: r for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()}
    assert (rows["spark-master"].cpu_perc_mean, rows["spark-master"].cpu_perc_q25) == ("20.0", "15.0")
    assert rows["spark-worker-5"].cpu_perc_mean is None


def test_timing_job(spark, tmp_path):
    folder = tmp_path / "in" / "00_A"
    folder.mkdir(parents=True)
    block = "## Normalize Dataset - meta_Books.parquet\n- Tamaño entrada: 7 GB\n- Tiempo: {} s\n\n## Tiempo total del script\n- 99.0 segundos\n"
    (folder / "a_report.md").write_text(block.format("1.0") + block.format("3.0"))
    main(["timing", str(tmp_path / "in"), str(tmp_path / "out")])
    row = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert (row.folder, row.dataset, row.n_runs, row.mean, row.std) == ("00_A", "Books", "2", "2.0", "1.41")
