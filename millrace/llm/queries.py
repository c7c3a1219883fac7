"""One query for each operator, over its whole table, and the SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import (
    chat,
    decontam,
    html_extract,
    jaccard,
    langid,
    licenses,
    mixing,
    oracles,
    passages,
    periodic,
    spotsigs,
    tokencounts,
    variants,
    warc,
)
from millrace.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query("op2_warc_assembly", oracles.WARC)
def warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    found = warc.captures(warc.read_warc(spark, path))
    return found.select(
        "page_id",
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to_page").alias("refers_to"),
    )


@_query("op3_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


@_query("op4_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_pairs(_table(spark, sf_dir, "documents"))


@_query("op5_preference_format", oracles.PREFERENCES)
def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.swapped_answers(_table(spark, sf_dir, "conversations"))
    found = chat.preferences(pairs)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return found.select(
        "conv_id",
        F.col("n_common").cast("long").alias("n_common"),
        "prompt",
        "chosen_text",
        "rejected_text",
        spans("chosen_mask").alias("chosen_mask"),
        spans("rejected_mask").alias("rejected_mask"),
    )


@_query("op6_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


@_query("op7_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["exact"])
    words = F.transform(base, lambda m: m["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda m: m["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


@_query("op8_mix_sources", oracles.MIXING)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


@_query("op9_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op10_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_components(_table(spark, sf_dir, "documents"))


@_query("op11_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"))


@_query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


@_query("op13_spelling_variants", oracles.VARIANTS)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.spelling_variants(_table(spark, sf_dir, "documents"), plant=True)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
