"""Ordered windows that do not need a whole series in one task.

A series (file, container, label) may hold a third of all rows, so a plain
``Window.partitionBy(series).orderBy(...)`` would sort that third in one task. Here every row
carries a ``chunk``: a deterministic, order-preserving coarsening of its position (line number
divided by a block size, a hash prefix, a quantile bucket). What a chunk needs from
the ones before it is aggregated first (one small row per series and chunk) and then enters the
chunk as an extra leading row, so the data is shuffled once, by (series, chunk), and never joined.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

_LEAD = "__lead"
_VALUE = "__value"
LINES_PER_CHUNK = 100_000
ROWS_PER_CHUNK = 1_000_000
QUANTILE_CHUNKS = 1024


def quantile_chunks(df: DataFrame, value: str, chunk: str, chunks: int = QUANTILE_CHUNKS) -> DataFrame:
    """Add an order-preserving bucket of ``value`` holding about 1/``chunks`` of all rows.

    The bounds are fetched once (at most ``chunks`` numbers, from a mergeable sketch) and become
    literals, so later passes over ``df`` agree on them. Results that use the buckets do not depend
    on how good the bounds are, only the balance does. A group never has more rows in a bucket than
    the bucket has overall, so hot groups are split as well. ``value`` must be a non-NULL double.
    """
    steps = [i / chunks for i in range(1, chunks)]
    bounds = df.agg(F.percentile_approx(value, steps, 4 * chunks)).first()[0] or []
    finite = sorted({b for b in bounds if b == b and abs(b) != float("inf")})
    if len(finite) == 0:
        return df.withColumn(chunk, F.lit(0.0))
    splits = [-float("inf"), *finite, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol=chunk, handleInvalid="keep").transform(df)


def balanced_chunks(
    df: DataFrame, position: str, chunk: str = "__chunk", rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Add an order-preserving chunk of a numeric ``position`` with about ``rows_per_chunk`` rows.

    One pass finds the row count, the range and a few hundred quantiles. Up to that many chunks are
    quantile buckets; beyond, each bucket is cut into equal-width pieces. As chunks are balanced over
    all rows, no series has more rows in a chunk than that, however long it is.
    """
    steps = [i / QUANTILE_CHUNKS for i in range(1, QUANTILE_CHUNKS)]
    n, low, high, bounds = df.agg(
        F.count(position), F.min(position), F.max(position), F.percentile_approx(position, steps, 4 * QUANTILE_CHUNKS)
    ).first()
    wanted = math.ceil(n / rows_per_chunk)
    buckets = min(wanted, QUANTILE_CHUNKS)
    inner = sorted({float(bounds[i * QUANTILE_CHUNKS // buckets - 1]) for i in range(1, buckets)})
    if not inner:
        return df.withColumn(chunk, F.lit(0).cast("bigint"))
    splits = [-float("inf"), *inner, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=position, outputCol=chunk, handleInvalid="keep").transform(df)
    bucket = F.col(chunk).cast("bigint")
    pieces = math.ceil(wanted / QUANTILE_CHUNKS)
    if pieces == 1:
        return bucketed.withColumn(chunk, bucket)
    edges = F.array(*[F.lit(e) for e in (float(low), *inner, float(high))])
    start, end = F.get(edges, bucket.cast("int")), F.get(edges, (bucket + 1).cast("int"))
    share = (F.col(position) - start) / F.greatest(end - start, F.lit(1e-300))
    piece = F.least(F.floor(share * pieces), F.lit(pieces - 1))
    return bucketed.withColumn(chunk, bucket * pieces + piece)


def totals_before(df: DataFrame, series: Sequence[str], chunk: str, value: Column, name: str = _VALUE) -> DataFrame:
    """Per (series, chunk): sum of ``value`` over all earlier chunks of the series."""
    earlier = Window.partitionBy(*series).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*series, chunk).agg(F.sum(value).alias(name))
    return cells.withColumn(name, F.coalesce(F.sum(name).over(earlier), F.lit(0)))


def running_sum(
    df: DataFrame,
    series: Sequence[str],
    chunk: str,
    order: Sequence[str],
    value: Column,
    name: str,
    include_row: bool = True,
    before: DataFrame | None = None,
) -> DataFrame:
    """Cumulative sum of an integer expression along each series.

    ``before`` gives the sums of earlier chunks as ``totals_before`` returns them, for inputs whose
    totals come cheaper from somewhere else.
    """
    tagged = df.withColumn(_VALUE, value.cast("bigint"))
    if before is None:
        before = totals_before(tagged, series, chunk, F.col(_VALUE), _VALUE)
    rows = tagged.withColumn(_LEAD, F.lit(1)).unionByName(before.withColumn(_LEAD, F.lit(0)), allowMissingColumns=True)
    last = Window.currentRow if include_row else -1
    w = Window.partitionBy(*series, chunk).orderBy(_LEAD, *order).rowsBetween(Window.unboundedPreceding, last)
    return rows.withColumn(name, F.sum(_VALUE).over(w)).where(F.col(_LEAD) == 1).drop(_LEAD, _VALUE)


def row_numbers(df: DataFrame, series: Sequence[str], chunk: str, order: Sequence[str], name: str) -> DataFrame:
    """1-based position of each row in its series; ``order`` must be total within a series."""
    return running_sum(df, series, chunk, order, F.lit(1), name)


def with_previous(
    df: DataFrame, series: Sequence[str], chunk: str, order: Sequence[str], column: str, name: str
) -> DataFrame:
    """The value of ``column`` on the row before, across chunk borders."""
    # One plain ordering column keeps the aggregate hash-based; ties matter only for other columns.
    position = F.col(order[0]) if len(order) == 1 or column == order[0] else F.struct(*order)
    latest = F.max_by(column, position)
    by_chunk = Window.partitionBy(*series).orderBy(chunk)
    carried = (
        df.groupBy(*series, chunk)
        .agg(latest.alias(_VALUE))
        .withColumn(_VALUE, F.lag(_VALUE).over(by_chunk))
        .withColumn(_LEAD, F.lit(0))
    )
    rows = df.withColumns({_VALUE: F.col(column), _LEAD: F.lit(1)}).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*series, chunk).orderBy(_LEAD, *order)
    return rows.withColumn(name, F.lag(_VALUE).over(w)).where(F.col(_LEAD) == 1).drop(_LEAD, _VALUE)


def look_back(
    df: DataFrame,
    series: Sequence[str],
    position: str,
    wanted: Mapping[str, tuple[Column, int]],
    lines_per_chunk: int = LINES_PER_CHUNK,
) -> DataFrame:
    """Add, per ``name: (value, reach)``, the nearest non-NULL value among the ``reach`` rows before.

    ``position`` is dense per series. The last rows of a block, as many as the longest reach, are
    copied into the next block, so blocks are independent and all columns come from one shuffle.
    """
    reach = max(r for _, r in wanted.values())
    slot = F.floor(F.col(position) / lines_per_chunk)
    near_end = F.col(position) % lines_per_chunk >= lines_per_chunk - reach
    rows = df.withColumns({f"__{n}": v for n, (v, _) in wanted.items()} | {"__home": slot}).withColumn(
        "__block", F.explode(F.when(near_end, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home")))
    )
    w = Window.partitionBy(*series, "__block").orderBy(position)
    found = rows.withColumns(
        {n: F.last(f"__{n}", ignorenulls=True).over(w.rowsBetween(-r, -1)) for n, (_, r) in wanted.items()}
    )
    return found.where(F.col("__home") == F.col("__block")).drop("__home", "__block", *[f"__{n}" for n in wanted])


def line_chunks(df: DataFrame, position: str, chunk: str = "__chunk", size: int = LINES_PER_CHUNK) -> DataFrame:
    return df.withColumn(chunk, F.floor(F.col(position) / size))


def segments(
    df: DataFrame,
    series: Sequence[str],
    micros: str,
    order: Sequence[str],
    threshold_seconds: float,
    name: str = "segment",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Number the stretches of a series that are separated by jumps longer than the threshold."""
    chunked = balanced_chunks(df, micros, rows_per_chunk=rows_per_chunk)
    gaps = with_previous(chunked, series, "__chunk", order, micros, "__previous")
    jump = (F.col(micros) - F.col("__previous")) > threshold_seconds * 1_000_000
    flagged = gaps.withColumn("__jump", F.coalesce(jump.cast("int"), F.lit(0)))
    counted = running_sum(flagged, series, "__chunk", order, F.col("__jump"), name)
    return counted.drop("__chunk", "__previous", "__jump")


def segment_durations(df: DataFrame, series: Sequence[str], micros: str, segment: str = "segment") -> DataFrame:
    """Start, end, duration and row count of each segment."""
    start, end = F.min(micros), F.max(micros)
    return df.groupBy(*series, segment).agg(
        start.alias("start_micros"),
        end.alias("end_micros"),
        ((end - start) / 1_000_000).alias("duration_seconds"),
        F.count(F.lit(1)).alias("n_rows"),
    )
