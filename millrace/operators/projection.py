"""Column selection and schema shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T


def rename_spaces(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.replace(" ", "_") for c in df.columns if " " in c})


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def conform(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Exactly the required columns in that order; missing ones are ''."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in required])


KINDS = {
    "numeric": T.NumericType,
    "string": T.StringType,
    "boolean": T.BooleanType,
    "array": T.ArrayType,
    "struct": T.StructType,
}


def columns_of(df: DataFrame, *kinds: str, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the columns of the given kinds, from the schema alone."""
    types = tuple(KINDS[k] for k in kinds)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types) and f.name not in exclude]


def kind_of(data_type: T.DataType) -> str:
    return next((k for k, t in KINDS.items() if isinstance(data_type, t)), "other")


def numeric_projection(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*columns_of(df, "numeric", exclude=exclude))


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, kind, type, and how many rows have a value."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(kind_of(f.dataType)).alias("kind"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col(f"c{i}").alias("n_values"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counts.select(F.inline(rows))
