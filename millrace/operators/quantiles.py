"""Exact quantiles, box-plot numbers and rank statistics without a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.lookup import lookup_join
from millrace.operators.ordered import QUANTILE_CHUNKS, balanced_chunks, quantile_chunks, running_sum, totals_before
from millrace.session import pinned


def _piece(value: Column, low: Column, high: Column, pieces: int = 1024) -> Column:
    """Equal-width piece of a bucket, rising with the value; also for infinite borders."""
    share = F.nanvl((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.5))
    return (
        F.when(value == low, F.lit(0))
        .when(value == high, F.lit(pieces))
        .otherwise(F.least(F.floor(share * pieces), F.lit(pieces)))
        .cast("bigint")
    )


def group_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float], chunks: int = QUANTILE_CHUNKS
) -> DataFrame:
    """Linear-interpolation quantiles per group as rows (groups, probability, quantile).

    ``percentile`` keeps every distinct value of a group in one task's memory. Here a counting
    pass per (group, value bucket) finds which bucket holds each wanted rank, and only the rows of
    those buckets, merged by value, are ranked, piece by piece. NULL and NaN values are skipped; NULL is a group.
    """
    base = df.select(*groups, F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    chunked = quantile_chunks(base, "__v", "__chunk", chunks)

    in_group = Window.partitionBy(*groups)
    earlier = in_group.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        chunked.groupBy(*groups, "__chunk")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(in_group))
    )
    position = {p: F.lit(p) * (F.col("__total") - 1) for p in probabilities}
    wanted = F.array(
        *[
            F.struct(F.lit(float(p)).alias("p"), rank(pos).cast("bigint").alias("rank"), (pos - F.floor(pos)).alias("part"))
            for p, pos in position.items()
            for rank in (F.floor, F.ceil)
        ]
    )
    inside = F.filter(
        wanted, lambda w: (w["rank"] >= F.col("__before")) & (w["rank"] < F.col("__before") + F.col("__n"))
    )
    needed = (
        cells.withColumn("__wanted", F.array_distinct(inside))
        .where(F.size("__wanted") > 0)
        .select(*groups, "__chunk", "__before", "__wanted", "__min", "__max")
    )

    candidates = lookup_join(chunked, needed, [*groups, "__chunk"], null_safe=True)
    by_value = candidates.groupBy(*groups, "__chunk", "__v").agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in ("__before", "__wanted", "__min", "__max")]
    )
    # A few buckets' worth of distinct values; kept because ranking reads them twice.
    kept = pinned(by_value.withColumn("__fine", _piece(F.col("__v"), F.col("__min"), F.col("__max"))))
    ranked = running_sum(kept, [*groups, "__chunk"], "__fine", ["__v"], F.col("__n"), "__upto")
    hits = (
        ranked.withColumn("__end", F.col("__before") + F.col("__upto"))
        .select(*groups, "__v", "__n", "__end", F.inline("__wanted"))
        .where((F.col("rank") < F.col("__end")) & (F.col("rank") >= F.col("__end") - F.col("__n")))
    )
    low, high = F.min("__v"), F.max("__v")
    return hits.groupBy(*groups, F.col("p").alias("probability")).agg(
        (low + (high - low) * F.first("part")).alias("quantile")
    )


def spread_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, named: dict[str, float], chunks: int = QUANTILE_CHUNKS
) -> DataFrame:
    """``group_quantiles`` with one column per name."""
    tall = group_quantiles(df, groups, value, sorted(set(named.values())), chunks)
    return tall.groupBy(*groups).agg(
        *[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for n, p in named.items()]
    )


def boxplot_numbers(df: DataFrame, groups: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, mean, whiskers at ``reach`` inter-quartile ranges and outlier count per group."""
    quartiles = spread_quantiles(df, groups, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    spread = F.col("q75") - F.col("q25")
    fences = quartiles.withColumns(
        {"__low": F.col("q25") - reach * spread, "__high": F.col("q75") + reach * spread}
    )
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    v = F.col(value)
    inside = (v >= F.col("__low")) & (v <= F.col("__high"))
    return (
        lookup_join(data, fences, groups, null_safe=True)
        .groupBy(*groups, "q25", "median", "q75")
        .agg(
            F.avg(v).alias("mean"),
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count(F.when(~inside, v)).alias("n_outliers"),
        )
    )


def rank_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from exact average ranks (ties count half), one row; NULL if a class is missing.

    Rows are merged by score before ranking. The negatives below each score bucket are counted on the
    rows themselves, so the merged scores are shuffled once and read once.
    """
    base = df.select(F.col(score).cast("double").alias("__v"), F.col(label).cast("int").alias("__y"))
    chunked = balanced_chunks(base, "__v")
    below = totals_before(chunked, [], "__chunk", (1 - F.col("__y")).cast("bigint"))
    by_score = chunked.groupBy("__chunk", "__v").agg(
        F.sum("__y").cast("bigint").alias("__pos"), F.sum(1 - F.col("__y")).cast("bigint").alias("__neg")
    )
    ranked = running_sum(by_score, [], "__chunk", ["__v"], F.col("__neg"), "__below", include_row=False, before=below)
    wins = F.col("__pos") * (F.col("__below").cast("double") + F.col("__neg") / 2)
    return ranked.agg(
        F.try_divide(F.sum(wins), F.sum("__pos").cast("double") * F.sum("__neg").cast("double")).alias("auc"),
        F.sum("__pos").alias("n_positive"),
        F.sum("__neg").alias("n_negative"),
    )


def rank_auc_by(df: DataFrame, groups: Sequence[str], score: str, n_positive: str, n_negative: str) -> DataFrame:
    """The same for each group, of rows that are merged by score already (one for each group and score, with counts).

    Chunks are balanced over all rows, so a group of very many scores is spread as well. ``df`` is read more than once.
    """
    chunked = balanced_chunks(df, score)
    ranked = running_sum(chunked, groups, "__chunk", [score], F.col(n_negative), "__below", include_row=False)
    pos, neg = F.col(n_positive), F.col(n_negative)
    wins = pos * (F.col("__below").cast("double") + neg / 2)
    return ranked.groupBy(*groups).agg(
        F.try_divide(F.sum(wins), F.sum(pos).cast("double") * F.sum(neg).cast("double")).alias("auc"),
        F.sum(pos).alias("n_positive"),
        F.sum(neg).alias("n_negative"),
    )
