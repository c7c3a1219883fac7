"""Facts from report text, paths and labels, and number formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# The report format.
DURATION = r"(\d+(?:\.\d+)?)\s*(?:s|segundos)"
TOTAL_MARKER = "Tiempo total del script"
DATASET_HEADING = r"## (?:Normalize|EDA) (?:Reviews |Meta )?Dataset - (.+)"
RUN_HEADING = r"## (.+?)\s*(?:-\s*)?\[Run (\d+)\]"
SECTION = r"(?s)## ([^\n\[]*) \[Run (\d+)\]\n.*?Duración: (\d+\.\d+) segundos"
FRAMEWORK = "(Spark|Ray|Dask)"
RUN_NUMBER = r"run(\d+)"
STATS_CATEGORY = "(_meta_|_review_)([A-Za-z_]+)_stats"
RUN_UNKNOWN = "[Run X]"
RUN_LIMIT = 5
MISSING_LABEL = "No especificado"
SUFFIX = ".parquet"


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Like ``regexp_extract`` but NULL, not '', when nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def duration(c: Column) -> Column:
    """First ``<number> s`` or ``<number> segundos`` in the text, in seconds."""
    return extract(c, DURATION).try_cast("double")


def first_pattern(c: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches."""
    return F.coalesce(*[extract(c, p) for p in patterns])


def sections(c: Column, pattern: str = SECTION, groups: Sequence[str] = ("title", "run", "seconds")) -> Column:
    """All matches of a multi-line pattern as an array of structs, one field per group.

    The text is searched once; the groups are then taken from each short match.
    """
    return F.transform(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(0)),
        lambda match: F.struct(*[F.regexp_extract(match, pattern, i + 1).alias(g) for i, g in enumerate(groups)]),
    )


def folder_facts(path: Column, below: str = "images") -> dict[str, Column]:
    """What the places of a file's folders say: ``dataset_name`` is the folder that lies in the first one named ``below``, and
    ``operation_type`` the third word of the name of the folder two above the file. NULL where there is no such folder."""
    parts = F.split(path, "/")
    marker = F.array_position(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), below).cast("int")
    return {
        "dataset_name": F.when(marker > 0, F.try_element_at(parts, marker + 1)),
        "operation_type": token(F.try_element_at(parts, F.lit(-3)), 2),
    }


def path_facts(path: Column) -> dict[str, Column]:
    """Framework, run number and category named by a path, and its last part."""
    parts = F.split(path, "/")
    return {
        "framework": extract(path, FRAMEWORK),
        "run_number": extract(path, RUN_NUMBER).try_cast("int"),
        "category": F.coalesce(extract(path, STATS_CATEGORY, 2), F.lit("General")),
        "file_name": F.element_at(parts, -1),
    }


def token(c: Column, position: int, separator: str = "_") -> Column:
    """Positional token; negative positions count from the end. NULL when absent."""
    parts = F.split(c, separator)
    if position >= 0:
        return F.get(parts, F.lit(position))
    return F.try_element_at(parts, F.lit(position))


def classify(c: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first needle the text contains."""
    out = F.lit(otherwise)
    for needle, label in reversed(rules):
        out = F.when(c.contains(needle), F.lit(label)).otherwise(out)
    return out


def clean_label(c: Column, remove: Sequence[str] = (SUFFIX, "meta_")) -> Column:
    out = F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING_LABEL))
    for literal in remove:
        out = F.replace(out, F.lit(literal), F.lit(""))
    return out


def pretty(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def number(c: Column, decimals: int = 2) -> Column:
    """NULL and NaN as ``-``, otherwise fixed decimals."""
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit("-")).otherwise(F.format_string(f"%.{decimals}f", c.cast("double")))


def count_number(c: Column) -> Column:
    """NULL and NaN as ``-``, whole numbers plain, anything else with two decimals."""
    value = c.cast("double")
    whole = value == F.floor(value)
    return (
        F.when(c.isNull() | F.isnan(value), F.lit("-"))
        .when(whole, value.cast("bigint").cast("string"))
        .otherwise(F.format_string("%.2f", value))
    )


def translate_keys(c: Column, mapping: Mapping[str, str]) -> Column:
    """Short fixed dictionaries as a CASE; unknown keys become NULL."""
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def capped_run(n: Column, limit: int = RUN_LIMIT) -> Column:
    """``[Run n]``, or ``[Run X]`` beyond the limit."""
    return F.when(n > limit, F.lit(RUN_UNKNOWN)).otherwise(F.concat(F.lit("[Run "), n.cast("string"), F.lit("]")))


def in_gb(size: Column) -> Column:
    return size / F.lit(1024.0**3)


def in_mb(size: Column) -> Column:
    return F.round(size / F.lit(1024.0**2), 2)
