from __future__ import annotations

import random

import numpy as np

from millrace.streaming import ingest, runs

SCHEMA = "operation string, input_file string, cpu double"


def test_restart_neither_loses_nor_repeats(spark, tmp_path):
    source, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        samples = ingest.busy_samples(ingest.sample_stream(spark, source, schema, files_per_trigger=1))
        ingest.route_to_files(samples, out, progress).awaitTermination()
        return spark.read.parquet(out)

    first = arrive([("EDA Meta", "a b.parquet", 1.0), ("idle", "x", 2.0), (None, "x", 3.0)])
    assert [(r.operation, r.input_file) for r in first.collect()] == [("EDA_Meta", "a_b.parquet")]
    second = arrive([("EDA Meta", "a b.parquet", 4.0), ("Join", "c", 5.0)])
    assert sorted(r.cpu for r in second.collect()) == [1.0, 4.0, 5.0]


def brute_runs(rows):
    """(monitor, key, run) of time-ordered (monitor, time, key) rows."""
    current, counts, out = {}, {}, []
    for monitor, _, key in rows:
        if current.get(monitor) != key:
            current[monitor] = key
            counts[monitor, key] = counts.get((monitor, key), 0) + 1
        out.append((monitor, key, counts[monitor, key]))
    return out


def test_runs_go_on_over_triggers_and_restarts(spark, tmp_path):
    """Alternating keys of several monitors, some NULL; idle samples between; the provider setting is as before."""
    rng = random.Random(2)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    schema = "monitor string, operation string, input_file string, t bigint, cpu double"
    rows = [(rng.choice(["m1", "m1", "m2", None]), rng.choice(["A", "B b", "idle", None]), rng.choice(["x", "y z", None]), t, 0.5) for t in range(300)]
    for start in range(0, 300, 50):
        part = rows[start : start + 50]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        samples = ingest.busy_samples(ingest.sample_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema))
        with runs.keyed_state(spark):
            query = ingest.route_to_files(runs.number_runs(samples, "monitor", ["t"]), str(tmp_path / "out"), str(tmp_path / "progress"), ["operation"])
        query.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    busy = [(m, t, f"{op.replace(' ', '_')}__{(f or 'unknown').replace(' ', '_')}") for m, op, f, t, _ in rows if op not in (None, "idle")]
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.t)
    assert [(r.monitor, f"{r.operation}__{r.input_file}", r.run) for r in got] == brute_runs(busy)


def test_one_monitor_over_two_keys():
    keys = np.array(["a", "a", "b", "a", "b", "b", "a"], object)
    so_far = {"a": 3}
    assert runs.run_numbers(keys, "a", so_far).tolist() == [3, 3, 1, 4, 2, 2, 5] and so_far == {"a": 5, "b": 2}
    assert runs.run_numbers(keys[:1], None, {}).tolist() == [1]
