"""Python functions over Arrow batches, for work that has no expression form."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

BATCH_ROWS = 2_000


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Apply a stateless frame-to-frame function to every batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def map_with_state(
    df: DataFrame,
    make_state: Callable[[], object],
    fn: Callable[[object, pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Build state once per task, then call ``fn(state, batch)`` on at most ``batch_rows`` rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = make_state()
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                yield fn(state, batch.iloc[start : start + batch_rows])

    return df.mapInPandas(run, schema)


def count_batches(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per batch: rows with a positive value counted by key. Sum the counts for the result."""
    narrow = df.select(key, value)
    key_type = df.schema[key].dataType

    def count(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[batch[value] > 0].groupby(key).size().reset_index(name="count")

    schema = T.StructType([T.StructField(key, key_type), T.StructField("count", T.LongType())])
    return map_batches(narrow, count, schema)


def score_batches(
    df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]], name: str = "cluster"
) -> DataFrame:
    """Nearest centroid per row with numpy; same result as the expression form."""
    columns = list(columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])

    def score(centres: np.ndarray, batch: pd.DataFrame) -> pd.DataFrame:
        points = batch[columns].to_numpy(dtype=float)
        distances = np.zeros((len(points), len(centres)))
        for j in range(points.shape[1]):
            step = points[:, j : j + 1] - centres[None, :, j]
            distances += step * step
        return batch.assign(**{name: distances.argmin(axis=1).astype("int32")})

    return map_with_state(df, lambda: np.asarray(centroids, dtype=float), score, schema)
