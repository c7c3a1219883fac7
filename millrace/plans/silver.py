"""Bronze to silver: nested product and review tables made flat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from millrace.functions import nested
from millrace.operators.projection import rename_spaces
from millrace.sources.tables import write_parquet


def normalize_columns(df: DataFrame, copy_arrays: bool = True) -> DataFrame:
    """Array lengths (and copies) and first elements of known structs, by column type, in one projection."""
    added: dict[str, Column] = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            added |= nested.array_columns(field.name, copy_arrays)
        elif isinstance(field.dataType, T.StructType) and field.name in nested.STRUCT_CHILDREN:
            added |= nested.struct_firsts(field.name, nested.STRUCT_CHILDREN[field.name])
    return df.withColumns(added) if added else df


def silver_meta(df: DataFrame, copy_arrays: bool = True, detail_keys: Sequence[str] = tuple(nested.DETAIL_KEYS)) -> DataFrame:
    flat = normalize_columns(rename_spaces(df), copy_arrays)
    if "details" in df.columns:
        flat = flat.withColumns(nested.json_lookups("details", detail_keys, "details"))
    return flat.drop("details")


def silver_reviews(df: DataFrame, n: int = 3) -> DataFrame:
    """Spread the first review images; a table without ``images`` passes through unchanged."""
    if "images" not in df.columns:
        return df
    return df.withColumns(nested.spread_structs("images", nested.IMAGE_FIELDS, n)).drop("images")


def silver_meta_job(spark: SparkSession, source: str, target: str) -> None:
    write_parquet(silver_meta(spark.read.parquet(source)), target)


def silver_reviews_job(spark: SparkSession, source: str, target: str) -> None:
    write_parquet(silver_reviews(spark.read.parquet(source)), target)


