"""Unions, the product-review join and fixed-order lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.operators.lookup import lookup_join
from millrace.session import staged


def union_same(frames: Sequence[DataFrame]) -> DataFrame:
    """Union-all by column name; every frame has the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_ragged(frames: Sequence[DataFrame]) -> DataFrame:
    """Union-all by column name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def hot_salts(df: DataFrame, key: str, rows_per_salt: int) -> DataFrame:
    """(key, salts) of keys with more than ``rows_per_salt`` rows: how many parts of at most about so many rows each.

    Counting combines map-side, so the shuffle carries one row per key and task, and at most rows / ``rows_per_salt`` keys remain.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_salt)
    return counts.select(key, F.ceil(F.col("n") / rows_per_salt).cast("int").alias("salts"))


def skew_join(big: DataFrame, small: DataFrame, key: str, rows_per_salt: int) -> DataFrame:
    """Inner equi-join that spreads the hot keys of ``big`` over salts.

    A row of ``big`` with a hot key takes one of the key's salts by a hash of the whole row; the rows of ``small`` with that key
    are repeated for each of its salts, so every pair meets once. Rows of other keys have salt 0. Both sides are
    shuffled once, by (key, salt); the table of hot keys is joined, not fetched. Equal rows of ``big`` share a salt.
    """
    hot = staged(hot_salts(big, key, rows_per_salt), "hot")
    salts = F.coalesce("__salts", F.lit(1))
    hot = hot.withColumnRenamed("salts", "__salts")
    plain = [c for c, kind in big.dtypes if not kind.startswith(("map", "variant"))]
    salted = big.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*plain), salts).cast("int")).drop("__salts")
    copies = F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt")
    repeated = small.join(hot, key, "left").select(*small.columns, copies)
    return salted.join(repeated, [key, "__salt"]).drop("__salt")


def reindex(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows for exactly the listed keys, with their position; keys without data have NULLs.

    Meant for per-key results: unlisted keys are filtered out first, so what is joined has the
    size of the list.
    """
    listed = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(order)], f"{key} string, position int")
    known = df.where(F.col(key).isin(list(order)))
    return listed.join(known, key, "left")


def map_lookup(df: DataFrame, key: str, mapping: dict[str, str], name: str) -> DataFrame:
    """Translate keys through a dictionary; rows with unknown keys are dropped."""
    table = df.sparkSession.createDataFrame(list(mapping.items()), f"{key} string, {name} string")
    return lookup_join(df, table, [key])
