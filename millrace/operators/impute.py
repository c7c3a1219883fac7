"""Filling missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

_FRACTIONAL = (T.FloatType, T.DoubleType)


def fill_constants(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(fills))


def impute_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill NULL (and NaN in fractional columns) with the column mean.

    All means come from one aggregate that enters the plan as a scalar subquery, so nothing is
    joined and no job runs here. The mean takes the type of its column: integers are truncated.
    A column without any value stays NULL.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("means")).scalar()
    types = {f.name: f.dataType for f in df.schema.fields}

    def filled(c: str):
        value = F.nanvl(F.col(c), F.lit(None)) if isinstance(types[c], _FRACTIONAL) else F.col(c)
        return F.coalesce(value, means.getField(c).cast(types[c]))

    return df.withColumns({c: filled(c) for c in columns})
