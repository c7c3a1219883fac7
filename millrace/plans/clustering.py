"""KMeans over all rows, over a sample, and trained on the head."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import learning
from millrace.operators.projection import columns_of, numeric_projection
from millrace.operators.sampling import SEED, head_rows, keyed_sample, random_rows
from millrace.operators.silhouette import euclidean_silhouette
from millrace.session import staged, training_table
from millrace.sources.tables import write_parquet

K_RANGE = (5,)
SAMPLE_ROWS = 5_000


def scaled_features(df: DataFrame, columns: Sequence[str] | None = None, on_missing: str = "error") -> DataFrame:
    """Assembled and standardised numeric columns."""
    names = list(columns) if columns is not None else columns_of(df, "numeric")
    if not names:
        raise ValueError("no numeric columns to cluster on")
    raw = learning.assemble(df, names, "features_unscaled", on_missing)
    return learning.fit_scaler(raw).transform(raw)


def kmeans_clusters(
    df: DataFrame, columns: Sequence[str] | None = None, ks: Sequence[int] = K_RANGE, seed: int = SEED, on_missing: str = "error"
) -> tuple[DataFrame, int, dict[int, float]]:
    """Every row with its cluster under the k of best silhouette; also that k and all scores.

    ``on_missing="skip"`` leaves out rows with a NULL feature; by default one ends the job.
    """
    scaled = training_table(scaled_features(df, columns, on_missing).drop("features_unscaled"), "scaled")
    k, model, scores = learning.search_k(scaled, ks, seed)
    return model.transform(scaled), k, scores


def kmeans_sampled(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = SAMPLE_ROWS, ks: Sequence[int] = K_RANGE, seed: int = SEED,
    on_missing: str = "error",
) -> tuple[DataFrame, int, dict[int, float]]:
    """The same on a uniform sample of ``n`` rows."""
    return kmeans_clusters(random_rows(df, n, seed), columns, ks, seed, on_missing)


def _head(df: DataFrame, columns: Sequence[str], n: int, on_missing: str, population: bool) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], DataFrame]:
    """Usable rows, what assembles and scales rows by the first ``n`` of them, and the vectors of those, as a written table."""
    if on_missing not in ("error", "skip"):
        raise ValueError(f"on_missing: {on_missing}")
    if on_missing == "skip":
        df = df.na.drop(subset=list(columns))
    head = head_rows(df.select(*columns), n)
    moments = learning.moments(head, columns, population)

    def scaled(rows: DataFrame) -> DataFrame:
        return learning.assemble(rows.withColumns(learning.standardised(moments)), list(moments)).drop(*moments)

    return df, scaled, staged(scaled(head).select("features"), "head")


def train_on_head(
    df: DataFrame, columns: Sequence[str], n: int = SAMPLE_ROWS, k: int = 5, seed: int = SEED, on_missing: str = "error", population: bool = True
) -> DataFrame:
    """Every row with its ``cluster`` under scaler and clusters of the first ``n`` rows; see ``search_on_head``."""
    df, scaled, near = _head(df, columns, n, on_missing, population)
    return learning.fit_kmeans(near, k, seed).transform(scaled(df)).drop("features").withColumnRenamed("prediction", "cluster")


def search_on_head(
    df: DataFrame, columns: Sequence[str], n: int = SAMPLE_ROWS, ks: Sequence[int] = K_RANGE, seed: int = SEED,
    on_missing: str = "error", population: bool = True,
) -> tuple[DataFrame, int, dict[int, float | None]]:
    """The same under the k of best silhouette; also that k and the scores of all.

    The score is the silhouette by plain Euclidean distance over the head, whose rows are compared block against block.
    ``on_missing="skip"`` leaves rows with a NULL or NaN feature out of the head and of the result, by default one ends the job.
    ``population`` scales by the deviation of the head as a whole, not as a sample.
    """
    df, scaled, near = _head(df, columns, n, on_missing, population)
    fits = {k: learning.fit_kmeans(near, k, seed) for k in dict.fromkeys(ks)}
    scores = {k: euclidean_silhouette(m.transform(near)).first()["silhouette"] for k, m in fits.items()}
    best = max(scores, key=lambda k: -2.0 if scores[k] is None else scores[k])
    placed = fits[best].transform(scaled(df)).drop("features").withColumnRenamed("prediction", "cluster")
    return placed, best, scores


def sampled_silhouette(clustered: DataFrame, fraction: float, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(n_rows, silhouette) by plain Euclidean distance of the rows that ``fraction`` of the key space chooses.

    With ``columns`` instead of ``features`` the vectors are assembled here, of these rows only: an assembler lets no filter through.
    """
    rows = keyed_sample(clustered, fraction, keys)
    return euclidean_silhouette(rows if columns is None else learning.assemble(rows, columns))


def kmeans_job(
    spark: SparkSession, source: str, target: str, sample: int | None = None, ks: Sequence[int] = K_RANGE, on_missing: str = "error"
) -> dict[int, float]:
    """Cluster all rows (or a sample) of a Parquet table, write (prediction, features), return the silhouettes."""
    df = spark.read.parquet(source)
    out, _, scores = kmeans_clusters(df, ks=ks, on_missing=on_missing) if sample is None else kmeans_sampled(df, n=sample, ks=ks, on_missing=on_missing)
    write_parquet(out.select("prediction", "features"), target)
    return scores


def head_job(
    spark: SparkSession, source: str, target: str, n: int = SAMPLE_ROWS, ks: Sequence[int] = K_RANGE, mode: str = "overwrite", on_missing: str = "error"
) -> dict[int, float | None]:
    """Train on the first rows, write the numeric columns of every row with its cluster, return the silhouettes."""
    df = numeric_projection(spark.read.parquet(source))
    out, _, scores = search_on_head(df, df.columns, n, ks, on_missing=on_missing)
    write_parquet(out, target, mode=mode)
    return scores
