"""One JSON document of three unlike sources: the samples of runs, report texts, and facts of files.

The document is a frame of fragments, a row each, whose order columns give their place. Every source contributes
its own fragments, so nothing is ever gathered by document, report or run; a report line is a piece of its JSON string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.combine import union_same
from millrace.operators.lookup import lookup_join
from millrace.session import staged

ORDER = ("part", "name", "run", "level", "sort_key", "later", "line")
_SCHEMA = {"part": "int", "name": "string", "run": "bigint", "level": "int", "sort_key": "bigint", "later": "boolean", "line": "string"}
# what opens and closes each of the three parts, in front of its body and behind it
_EDGES = [(0, '{"metrics":{'), (2, "},"), (3, '"reports":{'), (5, "},"), (6, '"files":['), (8, "]}")]
_METRICS, _REPORTS, _FILES = 1, 4, 7


def json_text(text: Column) -> Column:
    """What stands between the quotes of a JSON string; nothing for NULL."""
    whole = F.to_json(F.struct(F.coalesce(text.cast("string"), F.lit("")).alias("x")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)


def array_entries(df: DataFrame, groups: Sequence[str], order: str, entry: Column) -> DataFrame:
    """(groups, sort_key, later, line): the entries of a JSON array per group; ``later`` ones have a leading comma.

    The first one is the smallest by ``order``, then text. Equal entries of one place have a line each. NULL groups are groups.
    """
    entries = df.select(*groups, F.col(order).alias("sort_key"), entry.alias("__entry"))
    entries = staged(entries.groupBy(*groups, "sort_key", "__entry").agg(F.count(F.lit(1)).alias("__n")), "entries")
    place = F.struct("sort_key", "__entry")
    if groups:
        first = entries.groupBy(*groups).agg(F.min(place).alias("__first"))
        entries = lookup_join(entries, first, list(groups), null_safe=True)
    else:
        entries = entries.withColumn("__first", entries.agg(F.min(place)).scalar())
    each = entries.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
    later = ~place.eqNullSafe(F.col("__first")) | (F.col("__copy") > 1)
    return each.select(*groups, "sort_key", later.alias("later"), F.concat(F.when(later, F.lit(",")).otherwise(F.lit("")), "__entry").alias("line"))


def _fragments(df: DataFrame, part: int, level: int, line: Column, **places: Column) -> DataFrame:
    values = {"part": F.lit(part), "level": F.lit(level), "later": F.lit(False), "line": line, **places}
    return df.select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _SCHEMA.items()])


def _opened(names: DataFrame, part: int, level: int, by: Sequence[str], opening: Column) -> DataFrame:
    """The line that opens each last column of ``by``, with a comma before all but the first of its parent."""
    *parent, own = by
    if parent:
        names = lookup_join(names, names.groupBy(*parent).agg(F.min(own).alias("__least")), parent)
    else:
        names = names.withColumn("__least", names.agg(F.min(own)).scalar())
    comma = F.when(F.col(own) > F.col("__least"), F.lit(",")).otherwise(F.lit(""))
    return _fragments(names, part, level, F.concat(comma, opening), **{c: F.col(c) for c in by})


def collected_document(samples: DataFrame, entry: Sequence[str], order: str, lines: DataFrame, files: DataFrame, facts: Sequence[str]) -> DataFrame:
    """Fragments (``ORDER``) of ``{"metrics":{name:[{"run":n,"data":[...]}]},"reports":{name:text},"files":[...]}``.

    ``samples`` has ``name`` and ``run`` (samples without them are left out), the columns of ``entry`` and a number to ``order`` them
    by; ``lines`` has ``name``, ``line_no``, ``line``; ``files`` has the columns of ``facts``, in the order of the first. Sorted by
    ``ORDER``, NULLs first, the lines are the document. Sources without rows give an empty object or array.
    """
    quoted = F.concat(F.lit('"'), json_text(F.col("name")), F.lit('":'))
    at_name, at_run = {"name": F.col("name")}, {"name": F.col("name"), "run": F.col("run")}
    edges = samples.sparkSession.createDataFrame(_EDGES, "part int, line string")

    known = samples.where("name IS NOT NULL AND run IS NOT NULL").withColumn("run", F.col("run").cast("bigint"))
    runs = staged(known.select("name", "run").distinct(), "runs")
    names = runs.select("name").distinct()
    data = array_entries(known, ["name", "run"], order, F.to_json(F.struct(*entry)))
    run_line = F.concat(F.lit('{"run":'), F.col("run").cast("string"), F.lit(',"data":['))

    lines = lines.where("name IS NOT NULL")
    reports = staged(lines.groupBy("name").agg(F.min("line_no").alias("__first")), "reports")
    break_ = F.when(F.col("line_no") > F.col("__first"), F.lit("\\n")).otherwise(F.lit(""))
    text = F.concat(break_, json_text(F.col("line")))

    listed = files.select(F.lit(0).alias("__place"), F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}).alias("__facts"))
    parts = [
        edges.select(*[F.col(c) if c in edges.columns else F.lit(None).cast(kind).alias(c) for c, kind in _SCHEMA.items()]),
        _opened(names, _METRICS, -2, ["name"], F.concat(quoted, F.lit("["))),
        _opened(runs, _METRICS, -1, ["name", "run"], run_line),
        _fragments(data, _METRICS, 0, F.col("line"), sort_key=F.col("sort_key"), later=F.col("later"), **at_run),
        _fragments(runs, _METRICS, 1, F.lit("]}"), **at_run),
        _fragments(names, _METRICS, 2, F.lit("]"), run=F.lit(2**63 - 1), **at_name),
        _opened(reports, _REPORTS, -1, ["name"], F.concat(quoted, F.lit('"'))),
        _fragments(lookup_join(lines, reports, ["name"]), _REPORTS, 0, text, sort_key=F.col("line_no"), **at_name),
        _fragments(reports, _REPORTS, 1, F.lit('"'), **at_name),
        _fragments(array_entries(listed, [], "__place", F.col("__facts")), _FILES, 0, F.col("line"), later=F.col("later")),
    ]
    return union_same(parts)
