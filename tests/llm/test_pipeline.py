"""The corpus pipeline end to end on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from millrace.llm import decontam, jaccard, langid, passages
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, sf_dir, stages):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [s.columns == columns for s in stages] == [True] * 4 + [False]


def test_each_decision_takes_effect(spark, sf_dir, stages):
    known, distinct, cut, clean, mix = stages
    n = [s.count() for s in stages]
    assert n[0] > n[1] > n[2] - 1 and n[2] > n[3] > 0
    found = jaccard.ngram_components(known).where("component_id = doc_id").select("doc_id")
    assert {r[0] for r in found.collect()} == {r[0] for r in distinct.select("doc_id").collect()}
    assert passages.repeated_passages(distinct).select("doc_id").distinct().count() >= distinct.join(cut, ["doc_id", "text"], "left_anti").count()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontam.contained_items(clean, items).count() == 0 < decontam.contained_items(cut, items).count()
    assert {r[0] for r in mix.select("doc_id").collect()} <= {r[0] for r in clean.select("doc_id").collect()}


@pytest.fixture(scope="module")
def odd_folder(spark, sf_dir, tmp_path_factory):
    """Some documents, some of them twice, NULLs in every column, blank and very long texts, and columns of likely names."""
    root = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60)
    first = docs.orderBy("doc_id").limit(1)
    long = first.withColumn("doc_id", F.lit(10**6).cast("bigint")).withColumn("text", F.repeat(F.concat("text", F.lit(" the quick ")), 40))
    odd = [first.withColumn(c, F.lit(None).cast(t)) for c, t in docs.dtypes]
    odd += [first.withColumn("text", F.lit(x)).withColumn("doc_id", F.lit(10**6 + 1 + i).cast("bigint")) for i, x in enumerate(["", " \n", "...", "word"])]
    whole = docs
    for part in [docs.limit(5), long, *odd]:
        whole = whole.unionByName(part)
    whole = whole.withColumns({c: F.lit(c) for c in ("size", "spans", "h", "lang_pred", "component_id", "word")})
    whole.write.parquet(str(root / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_odd_rows_pass_through_all_stages(spark, odd_folder, tmp_path):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    mix = corpus_pipeline.run(spark, odd_folder)
    assert set(docs.columns) <= set(mix.columns) and 0 < mix.count()
    kept = {r.doc_id for r in mix.select("doc_id").collect()}
    assert kept <= {r.doc_id for r in docs.select("doc_id").collect()} and not kept & {10**6 + i for i in (1, 2, 3)}
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{odd_folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_operators_are_registered():
    names = {n.split("_")[0] for n in driver.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in driver.queries()


def test_scored_words_go_when_a_worker_turns_to_other_work(spark, make_docs):
    rows = make_docs([(i, " ".join(prose(i, 40)), ["en", "de"][i % 2], "a") for i in range(40)]).repartition(4)
    model = langid.fit(rows)
    assert langid.predict(rows, model).count() == 40 and langid.predict(rows, model).where("score >= 0").count() == 40

    def kept(batches):
        import gc

        import pyarrow as pa

        for batch in batches:
            n = sum(type(o).__name__ == "_Scores" for o in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    assert spark.range(64, numPartitions=16).mapInArrow(kept, "n long").agg({"n": "max"}).first()[0] == 0
