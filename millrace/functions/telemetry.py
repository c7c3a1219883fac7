"""Parsing of container telemetry text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Timestamp layout, memory usage and its units in GB, name prefix.
TIMESTAMP_LAYOUT = "yyyyMMdd_HHmmss"
USAGE = r"^\s*([\d.]+)\s*([A-Za-z]+)\s+/\s+([\d.]+)\s*([A-Za-z]+)\s*$"
UNIT_GB = {"GiB": 1.0, "MiB": 1 / 1024, "KiB": 1 / 1024**2, "B": 1 / 1024**3}
NAME_PREFIX = "spark_"


def percent(c: Column) -> Column:
    return F.replace(c, F.lit("%"), F.lit("")).try_cast("double")


def compact_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(TIMESTAMP_LAYOUT))


def memory_parts(c: Column) -> tuple[Column, Column]:
    """The two amounts of ``used / total`` in GB, each NULL when the text or that amount is malformed.

    A well-formed number with an unknown unit counts as 0.
    """

    def amount(group: int) -> Column:
        unit = F.regexp_extract(c, USAGE, group + 1)
        known = F.create_map(*[F.lit(x) for item in UNIT_GB.items() for x in item])
        factor = F.coalesce(F.try_element_at(known, unit), F.lit(0.0))
        return F.regexp_extract(c, USAGE, group).try_cast("double") * factor

    return amount(1), amount(3)


def both_or_neither(used: Column, total: Column) -> tuple[Column, Column]:
    good = used.isNotNull() & total.isNotNull()
    return F.when(good, used), F.when(good, total)


def memory_gb(c: Column) -> Column:
    """``used / total`` to a struct of two GB numbers; both NULL when either is malformed."""
    used, total = both_or_neither(*memory_parts(c))
    return F.struct(used.alias("used"), total.alias("total"))


def clean_name(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("-"), F.lit("_")), F.lit(NAME_PREFIX), F.lit(""))
