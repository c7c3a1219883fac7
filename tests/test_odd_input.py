"""NULL groups, ties, empty files and other input that the fixtures lack."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from millrace.operators import learning, quantiles, reports, telemetry as tm
from millrace.plans import clustering, telemetry_report, timing
from millrace.session import drop_staged, staged, staged_so_far
from millrace.sources import discovery, tables, telemetry


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(5)] + [("a", 1.0)], "name string, cpu_perc double")
    box = {r.name: r for r in quantiles.boxplot_numbers(df, ["name"], "cpu_perc").collect()}
    assert (box[None].median, box[None].mean, box["a"].median) == (2.0, 2.0, 1.0)
    stats = {r.name: r for r in tm.container_stats(df, metrics=["cpu_perc"]).collect()}
    assert (stats[None].median, stats[None].q75, stats["a"].q25) == (2.0, 3.0, 1.0)


def test_json_with_ties_and_null_keys(spark, tmp_path):
    rows = [("s", 1, "x"), ("s", 1, "y"), ("s", 1, "y"), ("s", None, "z"), (None, 2, "n"), (None, 2, "m")]
    lines = reports.json_documents(spark.createDataFrame(rows, "k string, run int, note string"), "k", "run", ["note"])
    tables.write_documents(lines, "k", str(tmp_path / "d"))
    texts = ["".join(f.read_text() for f in sorted(p.glob("part-*"))) for p in (tmp_path / "d").glob("k=*")]
    found = {d["k"]: sorted(x["note"] for x in d["runs"]) for d in map(json.loads, texts)}
    assert found == {"s": ["x", "y", "y", "z"], None: ["m", "n"]}


def test_a_null_cell_keeps_its_place(spark):
    df = spark.createDataFrame([("m", 1, None, "b")], "kind string, i int, a string, b string")
    lines = reports.table_lines(df, ["kind"], "i", {"A": F.col("a"), "B": F.col("b")})
    assert "| - | b |" in [r.line for r in lines.collect()]


def test_constant_columns_and_single_classes(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1), (1.0, 7.0, 1), (None, 9.0, 1)], "c double, x double, y int")
    assert [r.c for r in learning.zscore(df, ["c", "x"]).orderBy("x").collect()] == [0.0, 0.0, None]
    assert quantiles.rank_auc(df, "x", "y").first().auc is None


def test_missing_features_can_be_left_out(spark):
    rows = [(float(i % 2) * 10 + i / 100, float(i)) for i in range(40)] + [(None, 1.0)]
    out, k, _ = clustering.kmeans_clusters(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], ks=(2,), on_missing="skip")
    assert k == 2 and out.count() == 40


def test_rows_without_a_timestamp_reach_the_gate(spark, tmp_path):
    rest = ",c1,w,{}%,512MiB / 10GiB,5%,0B / 0B,0B / 0B,8\n"
    stamps = ["20250617_115321", "20250617_115322", ""]
    (tmp_path / "bad.csv").write_text("".join(s + rest.format(1) for s in stamps))
    (tmp_path / "good.csv").write_text("timestamp,a,name,b,c,d,e,f,g\n" + "".join(s + rest.format(2) for s in stamps[:2]))
    raw = telemetry.read_telemetry(spark, str(tmp_path))
    assert raw.count() == 5
    good = telemetry_report.gated_samples(raw)
    assert {r.source for r in good.collect()} == {"good.csv"} and good.first().mem_perc == 5.0
    assert [tuple(r) for r in tm.failed_rules(tm.parse_telemetry(raw)).collect()] == [("bad.csv", "timestamp_present")]


def test_every_timed_line_is_in_the_summary(spark):
    text = """## EDA Meta Dataset - meta_Books_normalized.parquet
- Tiempo: 1.5 s
## Read Filter Write Ray [Run 7]
- Tiempo: 2 s
## GBT Verified Purchase - Fast - [Run 2]
- Duración: 3.25 segundos
## Búsqueda de k
-
-
-
-
- Tiempo: 4 s
## Tiempo total del script
- 99 segundos"""
    lines = spark.createDataFrame([("f", "04_x.md", i, x) for i, x in enumerate(text.split("\n"))], "folder string, file string, line_no bigint, line string")
    got = {(r.dataset, r.run, r.time_seconds) for r in reports.heading_times(lines, ["folder", "file"]).collect()}
    assert got == {
        ("meta_Books_normalized.parquet", "[Run 1]", 1.5), ("Read Filter Write Ray", "[Run 7]", 2.0), ("GBT Verified Purchase - Fast", "[Run 2]", 3.25), ("", "[Run 1]", 4.0)
    }
    assert timing.timing_summary([timing.timing_rows(lines)]).agg(F.sum("n_runs")).first()[0] == 4


def test_files_without_rows_or_extension(spark, tmp_path):
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.range(0).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    files = discovery.table_inventory(spark, [str(tmp_path / "t")]).collect()
    assert sorted(r.n_rows for r in files)[-1] == 4 and all(r.size_bytes > 0 for r in files)
    (tmp_path / "a.b").mkdir()
    (tmp_path / "a.b" / "README").write_text("x")
    assert discovery.file_sizes(spark, str(tmp_path / "a.b")).first().extension == ""


def test_staged_tables_are_deleted_between_marks(spark):
    before = staged_so_far()
    first = staged(spark.range(3), "first")
    mark = staged_so_far()
    second = staged(spark.range(4), "second")
    paths = [f.inputFiles()[0].removeprefix("file://") for f in (first, second)]
    drop_staged(spark, mark, staged_so_far())
    assert [os.path.exists(p) for p in paths] == [True, False] and first.count() == 3
    drop_staged(spark, before)
    assert not os.path.exists(paths[0]) and staged_so_far() == mark + 1
