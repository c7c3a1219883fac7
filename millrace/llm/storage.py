"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import staged


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, so that no other column can clash with a working column."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def code_points(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


__all__ = ["code_points", "keyed", "staged"]
