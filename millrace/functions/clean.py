"""Dirty text to numbers, dates and flags. Unparsable text becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """``$1,299.00`` to 1299.0; ``from 9.99`` to NULL."""
    return F.regexp_replace(_col(c), "[$,]", "").try_cast("double")


def first_number(c: Column | str) -> Column:
    """First run of digits and dots, unit ignored."""
    return F.regexp_extract(_col(c), r"([\d\.]+)", 1).try_cast("double")


def first_int(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), r"(\d+)", 1).try_cast("int")


def dimension(c: Column | str, axis: int) -> Column:
    """One of the numbers in ``w x d x h unit``; only the last carries the unit."""
    part = F.get(F.split(_col(c), " x "), F.lit(axis))
    if axis == 2:
        part = F.get(F.split(part, " "), F.lit(0))
    return part.try_cast("double")


def before(c: Column | str, separator: str) -> Column:
    """Text in front of the first ``separator``."""
    return F.substring_index(_col(c), separator, 1)


def known(c: Column | str, fill: str = "unknown") -> Column:
    return F.coalesce(_col(c), F.lit(fill))


def from_millis(c: Column | str) -> Column:
    return F.timestamp_millis(_col(c))


def to_millis(c: Column | str) -> Column:
    """Epoch milliseconds of a timestamp with or without zone (session zone UTC)."""
    return F.unix_millis(_col(c).cast("timestamp"))


def to_micros(c: Column | str) -> Column:
    return F.unix_micros(_col(c).cast("timestamp"))


def flag(condition: Column) -> Column:
    return condition.cast("int")


def has_value(c: Column | str) -> Column:
    return _col(c).isNotNull().cast("int")
