from __future__ import annotations

import html
import json
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from millrace.operators import documents, reports, telemetry as tm
from millrace.plans.telemetry_report import good_samples
from millrace.session import staged, work_dir
from millrace.sources import discovery, inventory, tables, telemetry, text

HEADER = "timestamp,container_id,name,cpu_perc,mem_usage,mem_perc,net_io,block_io,pids"


def test_telemetry_with_and_without_header(spark, tmp_path):
    line = "20250617_11532{},c1,spark-worker-1,{}%,512MiB / 10GiB,5%,0B / 0B,0B / 0B,8"
    (tmp_path / "a__run1.csv").write_text("\n".join([HEADER, line.format(1, 10), line.format(2, 20)]) + "\n")
    (tmp_path / "b__run2.csv").write_text("\n".join([line.format(3, 30), line.format(4, "x")]) + "\n")
    raw = telemetry.read_telemetry(spark, str(tmp_path))
    assert sorted((r.source, r.cpu_perc) for r in raw.collect()) == [
        ("a__run1.csv", "10%"), ("a__run1.csv", "20%"), ("b__run2.csv", "30%"), ("b__run2.csv", "x%")
    ]
    good = good_samples(raw).orderBy("timestamp").collect()
    assert [(r.cpu_perc, r.mem_used_GB, round(r.elapsed_minutes * 60, 6)) for r in good] == [(10.0, 0.5, 0.0), (20.0, 0.5, 1.0)]


def test_files_of_equal_names_in_two_runs(spark, tmp_path):
    """Folders of odd names, a header in another order and with fewer columns, one repeated in the middle, and none."""
    line = "20250617_11532{},c1,w,{}%,512MiB / 10GiB,5%,0B / 0B,0B / 0B,8"
    for run, lines in {
        "run 1+": [HEADER, line.format(1, 10), HEADER, line.format(2, 20)],
        "run%202": [line.format(3, 30)],
        "run3": ["cpu_perc,timestamp,mem_usage,name", "40%,20250617_115324,1GiB / 2GiB,w"],
        "run4": [],
    }.items():
        (tmp_path / "images" / run).mkdir(parents=True)
        (tmp_path / "images" / run / "c.csv").write_text("\n".join(lines))
    raw = telemetry.read_telemetry(spark, str(tmp_path / "images"))
    got = sorted((r.source, r.timestamp[-1], r.cpu_perc, r.name, r.pids) for r in raw.collect())
    assert got == [("run 1+/c.csv", "1", "10%", "w", "8"), ("run 1+/c.csv", "2", "20%", "w", "8"), ("run%202/c.csv", "3", "30%", "w", "8"), ("run3/c.csv", "4", "40%", "w", None)]
    assert {r.path for r in raw.collect()} == {f"file://{tmp_path}/images/{s}" for s in ("run 1+/c.csv", "run%202/c.csv", "run3/c.csv")}
    two = telemetry.read_telemetry(spark, [str(tmp_path / "images" / "run%202"), str(tmp_path / "images" / "run3" / "c.csv")])
    assert sorted(r.source for r in two.collect()) == ["run%202/c.csv", "run3/c.csv"]


def test_quality_gate_reasons(spark, tmp_path):
    rows = [
        ("one", "20250101_000000", "1%", "1GiB / 2GiB"),
        ("bad_memory", "20250101_000000", "1%", "1GiB / 2GiB"),
        ("bad_memory", "20250101_000001", "1%", "oops"),
        ("infinite", "20250101_000000", "Infinity%", "1GiB / 2GiB"),
        ("infinite", "20250101_000001", "1%", "1GiB / 2GiB"),
        ("bad_time", "20250101_000000", "1%", "1GiB / 2GiB"),
        ("bad_time", "soon", "1%", "1GiB / 2GiB"),
    ]
    df = spark.createDataFrame([(s, t, "n", c, m) for s, t, c, m in rows], "source string, timestamp string, name string, cpu_perc string, mem_usage string")
    failed = {(r.source, r.rule) for r in tm.quality_rules(tm.parse_telemetry(df)).where("NOT passed").collect()}
    assert failed == {
        ("one", "enough_rows"), ("bad_memory", "memory_present"), ("infinite", "finite"), ("bad_time", "timestamp_present")
    }


def test_report_lines_across_splits(spark, tmp_path):
    """A file cut into many splits still numbers its lines from its start."""
    big = [f"line {i} " + "x" * (i % 37) for i in range(2_000)]
    (tmp_path / "big.md").write_text("\n".join(big) + "\n")
    (tmp_path / "small.md").write_text("one\n\nthree\n")
    (tmp_path / "other.txt").write_text("not a report\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = text.read_report_lines(spark, str(tmp_path))
        rows = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {("big.md", i): v for i, v in enumerate(big)} | {("small.md", i): v for i, v in enumerate(["one", "", "three"])}


def test_report_texts(spark, tmp_path):
    (tmp_path / "a.md").write_text("## KMeans Clustering [Run 6]\n- Fin: x\n- Duración: 2.5 segundos\n")
    texts = text.read_report_texts(spark, str(tmp_path))
    row = reports.section_times(texts, "text", ["file"]).first()
    assert (row.title, row.run_no, row.run, row.seconds) == ("KMeans Clustering", 6, "[Run 6]", 2.5)
    assert reports.section_times(texts, "text", ["file"], limit=5).first().run == "[Run X]"


def test_inventory(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_parquet(spark.range(100), path, files=4)
    per_file = discovery.table_inventory(spark, [path])
    assert per_file.count() == 4 and per_file.agg(F.sum("n_rows")).first()[0] == 100
    whole = discovery.table_inventory(spark, [path], base_name=True).first()
    assert (whole.table, whole.n_rows, whole.n_columns, whole.n_files) == ("t", 100, 1, 4)
    sizes = discovery.file_sizes(spark, path, "*.parquet")
    assert sizes.agg(F.sum("size_bytes")).first()[0] == whole.size_bytes
    assert {r.extension for r in sizes.collect()} == {".parquet"}


def test_inventory_of_mixed_folders(spark, tmp_path):
    """Paths with blanks and signs, nested columns, quoted headers, files without rows, broken and empty files."""
    odd = tmp_path / "a b+c%20é"
    tables.write_parquet(spark.range(7).selectExpr("id", "named_struct('x', id, 'y', id) AS s"), str(odd / "t.parquet"), files=2)
    (odd / "name, two.csv").write_text('"first, name",b,c\n1,2,3\n\n4,5,6\n')
    (odd / "only-head.csv").write_text("a,b")
    (odd / "empty.csv").write_text("")
    (tmp_path / "bad.parquet").write_text("no footer")
    (tmp_path / "zero.parquet").write_bytes(b"")
    (tmp_path / "cut.parquet").write_bytes(next((odd / "t.parquet").glob("*.parquet")).read_bytes()[:-20])
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    (tmp_path / "_hidden.csv").write_text("a\n1\n")
    got = inventory.file_inventory(spark, [str(tmp_path)]).collect()
    by_name = {r.file if r.directory.endswith(("20é", tmp_path.name)) else r.directory.rsplit("/", 1)[1]: (r.format, r.n_rows, r.n_columns) for r in got}
    parts = [r for r in got if r.directory.endswith("t.parquet")]
    assert sum(r.n_rows for r in parts) == 7 and {r.n_columns for r in parts} == {2} and {r.directory for r in parts} == {f"file://{odd}/t.parquet"}
    assert {k: v for k, v in by_name.items() if k != "t.parquet"} == {
        "name, two.csv": ("csv", 2, 3), "only-head.csv": ("csv", 0, 2), "empty.csv": ("csv", 0, 0), "none": ("parquet", 0, 1),
        "bad.parquet": ("parquet", None, None), "zero.parquet": ("parquet", None, None), "cut.parquet": ("parquet", None, None),
    }
    assert {r.file for r in got if r.error} == {"bad.parquet", "cut.parquet", "zero.parquet"} and all(r.size_gb is not None for r in got)
    groups = {(r.directory.rsplit("/", 1)[1], r.base_name): r for r in inventory.grouped_inventory(inventory.file_inventory(spark, [str(tmp_path)])).collect()}
    part = groups["t.parquet", "part"]
    assert (part.n_rows, part.n_files, part.n_columns, part.format, part.n_unreadable) == (7, 2, 2, "parquet", 0)
    assert groups[tmp_path.name, "bad"].n_unreadable == 1 and groups[odd.name, "only"].format == "csv"


def test_a_long_header_and_many_rows(spark, tmp_path):
    wide = ",".join(f"column_number_{i}" for i in range(9_000))
    (tmp_path / "wide.csv").write_text(wide + "\n" + "\n".join(["1"] * 5000) + "\n")
    assert [(r.n_rows, r.n_columns) for r in inventory.file_inventory(spark, [str(tmp_path)]).collect()] == [(5000, 9000)]


def test_category_fan_in(spark, tmp_path):
    for c in ("A", "B"):
        tables.write_parquet(spark.range(3), str(tmp_path / f"meta_{c}.parquet"))
    frames = tables.read_categories(spark, str(tmp_path / "meta_{}.parquet"), ["A", "B"])
    assert {c: f.count() for c, f in frames.items()} == {"A": 3, "B": 3}


def test_csv_infers_or_takes_a_schema(spark, tmp_path):
    tables.write_csv(tables.rows(spark, [{"a": 1, "b": "x"}], "a int, b string"), str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c")).dtypes == [("a", "int"), ("b", "string")]
    assert tables.read_csv(spark, str(tmp_path / "c"), "a bigint, b string").first().a == 1


def test_json_documents_are_valid(spark, tmp_path):
    df = spark.createDataFrame([("s1", 2, "x"), ("s1", 1, 'q"'), ("s2", 5, "y"), ('q"', 1, "z")], "script string, run int, note string")
    lines = reports.json_documents(df, "script", "run", ["run", "note"])
    tables.write_documents(lines, "script", str(tmp_path / "docs"))
    folders = (tmp_path / "docs").glob("script=*")
    texts = ["".join(f.read_text() for f in sorted(p.glob("part-*"))) for p in folders]
    documents = {d["script"]: d["runs"] for d in map(json.loads, texts)}
    assert documents == {
        "s1": [{"run": 1, "note": 'q"'}, {"run": 2, "note": "x"}], "s2": [{"run": 5, "note": "y"}], 'q"': [{"run": 1, "note": "z"}]
    }


def test_a_document_of_three_sources(spark, tmp_path):
    """Quotes and line ends in names and texts, equal samples, runs without name, NULL lines; then no rows at all."""
    samples = spark.createDataFrame(
        [('a"1', 2, 1, "x"), ('a"1', 10, 1, "y"), ('a"1', 2, 0, "z"), ('a"1', 2, 1, "x"), ("b", 1, 5, None), (None, 1, 1, "no"), ("b", None, 1, "no")],
        "name string, run int, t bigint, v string",
    )
    lines = spark.createDataFrame([("r", 3, 'say "hi"\t'), ("r", 4, None), ("r", 5, "\\\\ end"), ("s", 0, "ñ"), (None, 1, "no")], "name string, line_no bigint, line string")
    files = spark.createDataFrame([("p/x.parquet", 5), ("p/x.parquet", 5), ("p/a.parquet", None)], "path string, n_rows bigint")

    def written(*sources):
        out = str(tmp_path / f"doc{len(list(tmp_path.iterdir()))}")
        tables.write_ordered(documents.collected_document(sources[0], ["t", "v"], "t", sources[1], sources[2], ["path", "n_rows"]), documents.ORDER, out)
        return json.loads("".join("".join(p.read_text().splitlines()) for p in sorted(Path(out).glob("part-*"))))

    a, b = {"path": "p/a.parquet", "n_rows": None}, {"path": "p/x.parquet", "n_rows": 5}
    assert written(samples, lines, files) == {
        "metrics": {
            'a"1': [{"run": 2, "data": [{"t": 0, "v": "z"}, {"t": 1, "v": "x"}, {"t": 1, "v": "x"}]}, {"run": 10, "data": [{"t": 1, "v": "y"}]}],
            "b": [{"run": 1, "data": [{"t": 5}]}],
        },
        "reports": {"r": 'say "hi"\t\n\n\\\\ end', "s": "ñ"},
        "files": [a, b, b],
    }
    assert written(samples.limit(0), lines.limit(0), files.limit(0)) == {"metrics": {}, "reports": {}, "files": []}


def test_tables_in_every_style(spark):
    df = spark.createDataFrame([("meta", "w2", 2.0), ("meta", "w1", None)], "kind string, name string, v double")
    for style in reports.FORMATS:
        lines = reports.table_lines(df, ["kind"], "name", {"Name": F.col("name"), "V": F.format_string("%s", "v")}, style)
        body = [r.line for r in lines.orderBy("section", "sort_key").collect() if r.section == 0]
        assert len(body) == 2 and "w1" in body[0] and "w2" in body[1]
    markdown = reports.table_lines(df, ["kind"], "name", {"Name": F.col("name")}).orderBy("section", "sort_key")
    assert [r.line for r in markdown.collect()] == ["# Meta", "| Name |", "|---|", "| w1 |", "| w2 |"]


def test_a_parallel_scan_keeps_its_setting_to_itself(spark, tmp_path):
    setting = "spark.sql.files.minPartitionNum"
    spark.range(40_000).repartition(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    before = spark.conf.get(setting, None)
    scan = tables.read_parallel(spark, str(tmp_path / "t"), 16)
    assert scan.rdd.getNumPartitions() >= 12 and scan.count() == 40_000
    assert spark.conf.get(setting, None) == before and scan.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    plain = spark.read.parquet(str(tmp_path / "t"))
    assert plain.rdd.getNumPartitions() < 12
    assert scan.join(plain, "id").count() == 40_000


def test_files_of_a_target_size(spark, tmp_path):
    """From one hot key as well; appended files too, and a target above the whole size."""
    for key in ("id", "1"):
        rows = spark.range(60_000).selectExpr(f"{key} AS k", "uuid() AS a", "uuid() AS b")
        tables.write_parquet(rows, str(tmp_path / key), target_bytes=500_000)
        sizes = [p.stat().st_size for p in (tmp_path / key).glob("*.parquet")]
        assert len(sizes) > 4 and all(250_000 < s < 1_000_000 for s in sizes) and spark.read.parquet(str(tmp_path / key)).count() == 60_000
    tables.write_parquet(rows.limit(10), str(tmp_path / "1"), mode="append", target_bytes=10**9)
    assert len(list((tmp_path / "1").glob("*.parquet"))) == len(sizes) + 1


def test_cells_are_escaped_for_each_format(spark):
    text = 'a|b & <c> "d" 5% _x_ {y} \\\\z\nnew'
    df = spark.createDataFrame([("m&m_1", 1, text)], "kind string, i int, a string")
    body = {}
    for style in reports.FORMATS:
        lines = reports.table_lines(df, ["kind"], "i", {"A_1": F.col("a")}, style, label="stats", note="1 < 2 & more").collect()
        body[style] = {r.section: r.line for r in lines}
    assert body["html"][0] == "<tr><td>" + html.escape(text, quote=False).replace('"', "&quot;") + "</td></tr>"
    assert body["html"][2] == "<p>1 &lt; 2 &amp; more</p>" and body["html"][-3] == "<h1>M&amp;m 1</h1>"
    assert body["markdown"][0] == '| a\\|b & <c> "d" 5% _x_ {y} \\\\\\\\z<br>new |'
    assert body["latex"][0] == 'a|b \\& <c> "d" 5\\% \\_x\\_ \\{y\\} \\textbackslash{}\\textbackslash{}z new \\\\\\hline'
    assert body["latex"][-3] == "\\label{tab:stats_mm_1}" and body["latex"][-1] == "A\\_1 \\\\\\hline"
    assert body["latex"][4] == "\\textit{Note. 1 < 2 \\& more}" and body["plain"][0].endswith("z new")


def test_many_documents_in_few_files(spark, tmp_path):
    df = spark.range(500).selectExpr("concat('k', id % 97) AS k", "id AS run")
    tables.write_documents(reports.json_documents(df, "k", "run", ["run"]), "k", str(tmp_path / "d"), folders=False)
    files = sorted((tmp_path / "d").glob("*.parquet"))
    texts: dict[str, str] = {}
    for f in files:
        for row in pq.read_table(f).to_pylist():
            texts[row["k"]] = texts.get(row["k"], "") + row["line"]
    assert len(files) <= 16 and {k: len(json.loads(t)["runs"]) for k, t in texts.items()} == {f"k{i}": 6 if i < 15 else 5 for i in range(97)}


def test_staging_uses_the_configured_folder(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    assert staged(spark.range(5), "five").count() == 5
