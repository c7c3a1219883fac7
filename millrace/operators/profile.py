"""Column profiles, descriptions and binary-column search in single passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.operators.combine import union_same
from millrace.operators.projection import columns_of, kind_of

COLUMNS_PER_PASS = 8


def _batches(names: Sequence[str], size: int) -> list[list[str]]:
    return [list(names[i : i + size]) for i in range(0, len(names), size)]


def _nans(name: str, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.count_if(F.isnan(name))
    if isinstance(data_type, T.StringType):
        return F.count_if(F.col(name) == "NaN")
    return F.lit(0).cast("bigint")


def _tall(row: DataFrame, names: Sequence[str], fields: Sequence[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """One wide aggregate row to one row per profiled column."""
    structs = []
    for i, name in enumerate(names):
        parts = [F.lit(name).alias("column")]
        if kinds is not None:
            parts.append(F.lit(kinds[name]).alias("kind"))
        parts += [F.col(f"{f}_{i}").alias(f) for f in fields]
        structs.append(F.struct(*parts))
    return row.select(F.inline(F.array(*structs)))


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    columns_per_pass: int = COLUMNS_PER_PASS,
    approximate: bool = False,
) -> DataFrame:
    """Rows, NULLs, NaNs and distinct values per numeric, string and boolean column.

    Exact distinct counts over many columns at once multiply each row by the number of columns,
    so the columns are taken a few at a time; each pass reads only its own columns from a columnar
    file, so the passes together read the table once. ``approximate`` needs a single pass.
    """
    names = list(columns) if columns is not None else columns_of(df, "numeric", "string", "boolean")
    types = {f.name: f.dataType for f in df.schema.fields}
    kinds = {n: kind_of(types[n]) for n in names}
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    passes = []
    for batch in _batches(names, len(names) if approximate else columns_per_pass):
        measures = []
        for i, n in enumerate(batch):
            measures += [
                F.count(F.lit(1)).alias(f"n_rows_{i}"),
                F.count_if(F.col(n).isNull()).alias(f"nulls_{i}"),
                _nans(n, types[n]).alias(f"nans_{i}"),
                distinct(F.col(n)).alias(f"uniques_{i}"),
            ]
        passes.append(_tall(df.agg(*measures), batch, ["n_rows", "nulls", "nans", "uniques"], kinds))
    return union_same(passes)


def describe_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min and max per column in one pass.

    Numbers report their range in ``min_number``/``max_number``, text in ``min_text``/``max_text``.
    """
    names = list(columns) if columns is not None else columns_of(df, "numeric", "string")
    numeric = set(columns_of(df, "numeric"))
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    measures = []
    for i, n in enumerate(names):
        c = F.col(n)
        is_number = n in numeric
        measures += [
            F.count(c).alias(f"n_values_{i}"),
            (F.avg(c) if is_number else F.max(no_number)).alias(f"mean_{i}"),
            (F.stddev_samp(c) if is_number else F.max(no_number)).alias(f"stddev_{i}"),
            F.min(c.cast("double") if is_number else no_number).alias(f"min_number_{i}"),
            F.max(c.cast("double") if is_number else no_number).alias(f"max_number_{i}"),
            F.min(no_text if is_number else c).alias(f"min_text_{i}"),
            F.max(no_text if is_number else c).alias(f"max_text_{i}"),
        ]
    fields = ["n_values", "mean", "stddev", "min_number", "max_number", "min_text", "max_text"]
    return _tall(df.agg(*measures), names, fields)


def columns_by_type(df: DataFrame) -> DataFrame:
    """Row total, column total and the comma-separated column names of each kind."""
    kinds: dict[str, list[str]] = {}
    for f in df.schema.fields:
        kinds.setdefault(kind_of(f.dataType), []).append(f.name)
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(len(v)).alias("n_columns"), F.lit(",".join(v)).alias("columns"))
            for k, v in kinds.items()
        ]
    )
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(rows))


def binary_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Which columns hold only 0 and 1 (a NULL disqualifies), all decided in one pass."""
    names = list(columns) if columns is not None else columns_of(df, "numeric", "boolean")
    tests = [
        F.bool_and(F.coalesce(F.col(n).cast("double").isin(0.0, 1.0), F.lit(False))).alias(f"is_binary_{i}")
        for i, n in enumerate(names)
    ]
    return _tall(df.agg(*tests), names, ["is_binary"])


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])
