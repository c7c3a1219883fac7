"""Boosted-tree classification of a binary column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import boosting, learning
from millrace.operators.projection import columns_of
from millrace.operators.sampling import SEED, keyed_split
from millrace.sources.tables import read_csv, write_parquet

LABEL = "verified_purchase"


def random_parts(df: DataFrame, fraction: float = 0.8, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    train, test = df.randomSplit([fraction, 1 - fraction], seed=seed)
    return train, test


def keyed_parts(df: DataFrame, keys: Sequence[str], fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    tagged = keyed_split(df, fraction, keys, "__part")
    return tagged.where("__part = 'train'").drop("__part"), tagged.where("__part = 'test'").drop("__part")


def gbt_predictions(
    df: DataFrame,
    label: str = LABEL,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] | None = None,
    rounds: int = 1,
    depth: int = 5,
    step: float = 0.1,
    on_missing: str = "error",
) -> DataFrame:
    """Train on 80 %, return (prediction, probability, label and raw score) of the other 20 %.

    With ``keys`` the split depends on the row keys alone; otherwise it is Spark's random split.
    """
    names = list(columns) if columns is not None else columns_of(df, "numeric", exclude=[label])
    if not keys:  # a random split sorts whole rows
        df = df.select(*names, label)
    train, test = keyed_parts(df, keys) if keys else random_parts(df)
    vectors = learning.assemble(train, names, on_missing=on_missing).select("features", label)
    fitted = learning.fit_gbt(vectors, label, rounds, depth, step)
    return fitted.transform(learning.assemble(test, names, on_missing=on_missing))


def gbt_rounds(
    df: DataFrame,
    label: str = LABEL,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    rounds: int = 100,
    depth: int = 5,
    step: float = 0.1,
    stop_early: bool = False,
    at: Sequence[int] | None = None,
    on_missing: str = "error",
) -> tuple[GBTClassificationModel, DataFrame]:
    """Train on 80 % by key; the model, and (round, train_auc, test_auc, n_train, n_test) for each round or those of ``at``.

    With ``stop_early`` the other 20 % also decide when to stop.
    """
    names = list(columns) if columns is not None else columns_of(df, "numeric", exclude=[label, *keys])
    tagged = keyed_split(df, 0.8, keys or names, "part").withColumn("held_out", F.col("part") == "test")
    vectors = learning.assemble(tagged, names, on_missing=on_missing).select("features", label, "part", "held_out")
    learnt = vectors if stop_early else vectors.where("NOT held_out")
    model = learning.fit_gbt(learnt, label, rounds, depth, step, validation="held_out" if stop_early else None)
    scores = boosting.auc_by_round(model, vectors, label, ["part"], at)
    size = F.col("n_positive") + F.col("n_negative")
    pick = lambda c, part: F.max(F.when(F.col("part") == part, c))
    return model, scores.groupBy("round").agg(
        pick(F.col("auc"), "train").alias("train_auc"),
        pick(F.col("auc"), "test").alias("test_auc"),
        pick(size, "train").alias("n_train"),
        pick(size, "test").alias("n_test"),
    )


def gbt_job(
    spark: SparkSession,
    source: str,
    target: str,
    label: str = LABEL,
    csv_schema: str | None = None,
    rounds: int = 1,
    depth: int = 5,
    step: float = 0.1,
) -> float:
    """Train on a Parquet table, or on CSV of the given schema; write the predictions, return the area under ROC."""
    df = spark.read.parquet(source) if csv_schema is None else read_csv(spark, source, csv_schema)
    scored = gbt_predictions(df, label, rounds=rounds, depth=depth, step=step)
    write_parquet(scored.select("prediction", "probability", label), target)
    return learning.area_under_roc(scored, label)
