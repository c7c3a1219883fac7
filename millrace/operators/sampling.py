"""Samples and splits.

The native forms (``sample``, ``randomSplit``, ``orderBy(rand())``) depend on how the input is
partitioned. The keyed forms depend on the row key alone: a row's md5 decides, so the same rows
come out on any cluster and after any recomputation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.lookup import lookup_join
from millrace.operators.ordered import row_numbers
from millrace.session import pinned

SEED = 42
_DIGITS = 16  # of the hash that a fraction is compared with
PREFIX_DIGITS = 3  # 4096 slots: few enough to combine fully before the shuffle


def key_hash(keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))


def _threshold(fraction: float) -> str:
    return format(min(int(fraction * 16**_DIGITS), 16**_DIGITS - 1), f"0{_DIGITS}x")


def below_fraction(keys: Sequence[str], fraction: float) -> Column:
    """Whether the row falls into the first ``fraction`` of the hash space."""
    if fraction >= 1:
        return F.lit(True)
    return F.substring(key_hash(keys), 1, _DIGITS) < F.lit(_threshold(fraction))


def random_rows(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Uniform sample of exactly ``n`` rows, pinned so that later passes see the same rows.

    Sorting everything by a random number would send ``n`` rows per task to the last step. A
    Bernoulli sample expected to hold a little more than ``n`` rows is drawn first and cut to size,
    which is as uniform. In the very unlikely case it falls short, all rows are sorted.
    """
    total = df.count()
    fraction = (n + 10 * n**0.5 + 100) / total if total else 1.0
    if fraction < 1:
        drawn = pinned(df.where(F.rand(seed) < fraction))
        if drawn.count() >= n:
            return pinned(drawn.orderBy(F.rand(seed + 1)).limit(n))
    return pinned(df.orderBy(F.rand(seed)).limit(n))


def head_rows(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows from the front, as a fixed table that is written in the cluster."""
    return pinned(df.limit(n))


def keyed_sample(df: DataFrame, fraction: float, keys: Sequence[str]) -> DataFrame:
    return df.where(below_fraction(keys, fraction))


def sample_head(df: DataFrame, fraction: float, n: int, seed: int = SEED) -> DataFrame:
    return head_rows(df.sample(fraction=fraction, seed=seed), n)


def keyed_split(df: DataFrame, fraction: float, keys: Sequence[str], name: str = "part") -> DataFrame:
    """Tag each row ``train`` or ``test``; map-only."""
    return df.withColumn(name, F.when(below_fraction(keys, fraction), "train").otherwise("test"))


def _with_cut(
    df: DataFrame, strata: Sequence[str], keys: Sequence[str], take: Callable[[Column], Column], digits: int
) -> DataFrame:
    """Add a boolean ``__taken`` for the first ``take(rows of the stratum)`` rows in key-hash order.

    Counting rows per hash prefix finds the one prefix per stratum in which the cut falls. Only the
    rows of that prefix (about 1/16**digits of the data) are ranked, in pieces by a longer prefix, to
    find the last row taken. Its hash and key then decide every row where it is, without a shuffle.
    ``keys`` must identify a row.
    """
    hashed = df.withColumn("__h", key_hash(keys))
    slotted = hashed.select(*strata, *[k for k in keys if k not in strata], "__h").withColumn(
        "__slot", F.substring("__h", 1, digits)
    )
    in_stratum = Window.partitionBy(*strata)
    earlier = in_stratum.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        slotted.groupBy(*strata, "__slot")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .withColumn("__take", take(F.sum("__n").over(in_stratum)))
    )
    holds_cut = (F.col("__before") < F.col("__take")) & (F.col("__take") <= F.col("__before") + F.col("__n"))
    cuts = slots.where(holds_cut).select(*strata, "__slot", (F.col("__take") - F.col("__before")).alias("__need"))
    near = lookup_join(slotted, cuts, [*strata, "__slot"], null_safe=True).withColumn("__fine", F.substring("__h", 1, digits + 3))
    place = F.struct("__h", *keys)
    last = (
        row_numbers(near, strata, "__fine", ["__h", *keys], "__rank")
        .where(F.col("__rank") == F.col("__need"))
        .select(*strata, place.alias("__last"))
    )
    if strata:
        placed = lookup_join(hashed, last, strata, "left", null_safe=True)
    else:
        placed = hashed.withColumn("__last", last.agg(F.max("__last")).scalar())
    return placed.withColumn("__taken", F.coalesce(place <= F.col("__last"), F.lit(False))).drop("__h", "__last")


def exact_split(
    df: DataFrame,
    strata: Sequence[str],
    keys: Sequence[str],
    fraction: float,
    name: str = "part",
    digits: int = PREFIX_DIGITS,
) -> DataFrame:
    """Tag exactly floor(fraction * n) rows of each stratum ``train``, the rest ``test``. Rows without a label are a stratum, too."""
    cut = _with_cut(df, strata, keys, lambda n: F.floor(F.lit(fraction) * n), digits)
    return cut.withColumn(name, F.when(F.col("__taken"), "train").otherwise("test")).drop("__taken")


def keyed_rows(df: DataFrame, n: int, keys: Sequence[str], digits: int = PREFIX_DIGITS) -> DataFrame:
    """The ``n`` rows with the smallest key hash (all rows if there are fewer), without sorting them all."""
    cut = _with_cut(df, [], keys, lambda rows: F.least(rows, F.lit(n)), digits)
    return cut.where("__taken").drop("__taken")
