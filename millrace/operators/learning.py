"""Feature vectors, clustering, boosted trees and their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators import kmeans
from millrace.operators.boosting import merged_rows
from millrace.operators.sampling import SEED
from millrace.session import persisted, sized

MERGED_PART = 20_000  # merged rows of a task: a round is many short jobs, so their tasks are few
SPLIT_BINS = 1 << 10  # far above what a feature has: Spark looks for thresholds in the square of it, here all rows up to 1 million


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features", on_missing: str = "error") -> DataFrame:
    """Numeric columns to one vector; ``on_missing`` is ``error``, ``skip`` or ``keep``."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid=on_missing).transform(df)


def fit_scaler(df: DataFrame, column: str = "features_unscaled", out: str = "features") -> StandardScalerModel:
    return StandardScaler(inputCol=column, outputCol=out, withMean=True, withStd=True).fit(df)


def zscore(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """Mean 0, deviation 1 as plain columns, the moments coming from one scalar subquery.

    ``population`` divides by n instead of n - 1. A column of one value becomes 0.
    """
    deviation = F.stddev_pop if population else F.stddev_samp
    moments = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("mean"), deviation(c).alias("std")).alias(c) for c in columns]).alias("m")
    ).scalar()
    scaled = {}
    for c in columns:
        away, std = F.col(c) - moments.getField(c)["mean"], moments.getField(c)["std"]
        scaled[c] = F.when(std == 0, F.when(F.col(c).isNotNull(), F.lit(0.0))).otherwise(F.try_divide(away, std))
    return df.withColumns(scaled)


def moments(df: DataFrame, columns: Sequence[str], population: bool = False) -> dict[str, tuple[str, float, float]]:
    """For a scaled column of each name: the column it comes from, its mean and deviation. Meant for heads and samples."""
    deviation = F.stddev_pop if population else F.stddev_samp
    found = df.agg(*[F.struct(F.avg(c), deviation(c)) for c in columns]).first()
    return {f"__scaled_{i}": (c, *found[i]) for i, c in enumerate(columns)}


def standardised(scale: dict[str, tuple[str, float, float]]) -> dict[str, Column]:
    """Scaled columns by moments found elsewhere, as expressions; a column of one value becomes 0 where it has a value."""
    return {
        name: F.when(F.col(c).isNotNull(), F.lit(0.0)) if not std else (F.col(c) - F.lit(mean)) / F.lit(std)
        for name, (c, mean, std) in scale.items()
    }


def nearest_centroid(columns: Sequence[str], centroids: Sequence[Sequence[float]]) -> Column:
    """Index of the closest centroid (squared Euclidean, lowest index on ties) as one expression."""
    distances = []
    for i, centre in enumerate(centroids):
        total = F.lit(0.0)
        for c, x in zip(columns, centre, strict=True):
            total = total + (F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x)))
        distances.append(F.struct(total.alias("distance"), F.lit(i).alias("cluster")))
    return F.array_min(F.array(*distances))["cluster"]


def fit_kmeans(df: DataFrame, k: int, seed: int = SEED, features: str = "features") -> KMeansModel:
    """Spark keeps the rows as blocks of plain numbers: a row as an object takes several times their room, and spills at size."""
    return KMeans(featuresCol=features, k=k, seed=seed, solver="block").fit(df)


def silhouette(predictions: DataFrame, distance: str = "squaredEuclidean", features: str = "features") -> float:
    return ClusteringEvaluator(featuresCol=features, metricName="silhouette", distanceMeasure=distance).evaluate(predictions)


def search_k(
    scaled: DataFrame, ks: Sequence[int], seed: int = SEED, blocks: DataFrame | None = None
) -> tuple[int, KMeansModel, dict[int, float | None]]:
    """Fit each k; best silhouette by squared distance wins. All k are fitted in the same passes, and scored in the same two.

    ``blocks`` are the rows of ``scaled`` as ``kmeans.packed`` gives them, for when several searches read them.
    A k that ends with one cluster has no score.
    """
    if blocks is None:
        blocks = kmeans.packed(scaled)
    centres = kmeans.fit(blocks, list(dict.fromkeys(ks)), seed)
    scores = kmeans.silhouettes(blocks, centres)
    best = max(scores, key=lambda k: -2.0 if scores[k] is None else scores[k])
    return best, kmeans.model(scaled.sparkSession, centres[best], best, seed), scores


def fit_gbt(
    train: DataFrame, label: str, rounds: int = 1, depth: int = 5, step: float = 0.1, seed: int = SEED,
    validation: str | None = None, tolerance: float = 0.01,
) -> GBTClassificationModel:
    """``validation`` names a boolean column: rows where it is true are not learnt from, and rounds end when the
    error on them no longer falls by ``tolerance`` (as a share of it, or of 0.01 if it is smaller).

    Rows that lie in the same bins are learnt from as one row with their number as weight: every round reads them several times."""
    gbt = GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, validationTol=tolerance,
        maxBins=SPLIT_BINS, weightCol="__weight",
    )
    if validation is not None:
        gbt = gbt.setValidationIndicatorCol(validation)
    merged = merged_rows(train, [label] if validation is None else [label, validation], "__weight")
    with persisted(sized(merged, MERGED_PART)) as rows:
        model = gbt.fit(rows)
    model.clear(model.weightCol)  # the rows that it is used on have none
    return model


def area_under_roc(predictions: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(
        labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC", numBins=0
    ).evaluate(predictions)


def prediction_table(predictions: DataFrame, label: str) -> DataFrame:
    """prediction (probability over one half), probability of class 1, and the label."""
    p = vector_to_array("probability")[1]
    return predictions.select((p > 0.5).cast("int").alias("prediction"), p.alias("probability"), label)


def accuracy(df: DataFrame, probability: str, label: str, threshold: float = 0.5) -> DataFrame:
    hit = (F.col(probability) > threshold).cast("int") == F.col(label)
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_rows"))


def log_loss(df: DataFrame, probability: str, label: str, clip: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(probability), F.lit(clip)), F.lit(1 - clip))
    y = F.col(label).cast("double")
    return df.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.count(F.lit(1)).alias("n_rows"))
