"""Joins against results that are expected to be small."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from millrace.session import staged


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join ``big`` with a result expected to be small.

    ``small`` is computed once and written to the shared folder, so Catalyst knows its exact size: below the broadcast
    threshold ``big`` is neither shuffled nor exposed to hot keys, above it AQE splits skewed partitions of the
    join. Nothing passes through the driver. With ``null_safe`` a NULL key matches a NULL key.
    """
    side = staged(small, "lookup")
    if not null_safe:
        return big.join(side, list(on), how)
    side = side.withColumnsRenamed({k: f"__{k}" for k in on})
    same = reduce(lambda a, b: a & b, [big[k].eqNullSafe(side[f"__{k}"]) for k in on])
    return big.join(side, same, how).drop(*[f"__{k}" for k in on])
