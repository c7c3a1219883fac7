"""Timing facts from report lines, and result tables rendered as text lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import text as tx
from millrace.operators.documents import array_entries
from millrace.operators.lookup import lookup_join
from millrace.operators.ordered import LINES_PER_CHUNK, line_chunks, look_back, row_numbers, running_sum

# Columns of a timing row, and the category rules on file name or text.
TIMING_COLUMNS = ["file", "folder", "run", "dataset", "category", "time_seconds"]
LOOK_BACK = 4


def numbered_lines(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Text rows to (keys, line_no, line), counting from 0."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _heading(pattern: str) -> Column:
    return F.trim(tx.extract(F.col("line"), pattern))


def skip_after(df: DataFrame, file: Sequence[str], marker: Column, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Drop marker lines and the line right after each.

    A marker right after a marker is still a marker: it hides its own successor too.
    """
    seen = look_back(df, file, "line_no", {"after": (F.when(marker, F.lit(1)), 1)}, lines_per_chunk)
    return seen.where(~marker & F.col("after").isNull()).drop("after")


def nearest_heading(
    df: DataFrame,
    file: Sequence[str],
    pattern: str = tx.DATASET_HEADING,
    name: str = "dataset",
    reach: int = LOOK_BACK,
    lines_per_chunk: int = LINES_PER_CHUNK,
) -> DataFrame:
    """Group 1 of the closest heading within the ``reach`` lines before each line, '' if none."""
    found = look_back(df, file, "line_no", {name: (_heading(pattern), reach)}, lines_per_chunk)
    return found.withColumn(name, F.coalesce(F.col(name), F.lit("")))


def timed_lines(df: DataFrame, file: Sequence[str], lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Lines with a duration that are neither a script total nor right after its marker, with
    ``dataset`` ('' if no heading is near) and ``time_seconds``; one shuffle for both look-backs.
    """
    seen = look_back(
        df,
        file,
        "line_no",
        {"dataset": (_heading(tx.DATASET_HEADING), LOOK_BACK), "after": (F.when(is_total(), F.lit(1)), 1)},
        lines_per_chunk,
    )
    timed = seen.where(~is_total() & F.col("after").isNull()).withColumns(
        {"dataset": F.coalesce("dataset", F.lit("")), "time_seconds": tx.duration(F.col("line"))}
    )
    return timed.where(F.col("time_seconds").isNotNull()).drop("after")


def execution_blocks(
    df: DataFrame, file: Sequence[str], marker: Column, name: str = "block", lines_per_chunk: int = LINES_PER_CHUNK
) -> DataFrame:
    """1 + number of markers above: every line belongs to the run the next marker closes."""
    chunked = line_chunks(df, "line_no", size=lines_per_chunk)
    counted = running_sum(chunked, file, "__chunk", ["line_no"], marker.cast("int"), name, include_row=False)
    return counted.withColumn(name, F.coalesce(F.col(name), F.lit(0)) + 1).drop("__chunk")


def number_runs(
    df: DataFrame,
    series: Sequence[str],
    position: str = "line_no",
    name: str = "run_no",
    lines_per_chunk: int = LINES_PER_CHUNK,
) -> DataFrame:
    """Running number within each series, in line order."""
    chunked = line_chunks(df, position, size=lines_per_chunk)
    return row_numbers(chunked, series, "__chunk", [position], name).drop("__chunk")


def is_total(line: str = "line") -> Column:
    return F.col(line).contains(tx.TOTAL_MARKER)


def report_times(
    lines: DataFrame,
    file: Sequence[str] = ("file",),
    lines_per_chunk: int = LINES_PER_CHUNK,
    limit: int | None = None,
) -> DataFrame:
    """(file keys, line_no, dataset, run_no, run, time_seconds) of every timed line that is no script total.

    Runs are numbered per dataset in line order; lines without a dataset get the unknown-run label.
    With ``limit`` higher run numbers get it as well.
    """
    timed = timed_lines(lines, file, lines_per_chunk)
    numbered = number_runs(timed, [*file, "dataset"], lines_per_chunk=lines_per_chunk)
    label = tx.capped_run(F.col("run_no"), limit if limit is not None else 2**62)
    run = F.when(F.col("dataset") == "", F.lit(tx.RUN_UNKNOWN)).otherwise(label)
    return numbered.select(*file, "line_no", "dataset", "run_no", run.alias("run"), "time_seconds")


def heading_times(
    lines: DataFrame, file: Sequence[str] = ("file",), lines_per_chunk: int = LINES_PER_CHUNK
) -> DataFrame:
    """(file keys, line_no, dataset, run_no, run, time_seconds) of every timed line that is no script total.

    The line itself or the nearest of the lines before it names a dataset, or a title and its run. Times without
    a run of their own are numbered in line order: per dataset, and per file where no heading is near
    (``dataset`` is then '').
    """
    line = F.col("line")
    named, title = _heading(tx.DATASET_HEADING), _heading(tx.RUN_HEADING)
    number = tx.extract(line, tx.RUN_HEADING, 2).try_cast("bigint")
    heading = F.when(named.isNotNull(), F.struct(named.alias("dataset"), F.lit(None).cast("bigint").alias("run_no"))).when(
        title.isNotNull(), F.struct(title.alias("dataset"), number.alias("run_no"))
    )
    wanted = {"heading": (heading, LOOK_BACK), "after": (F.when(is_total(), F.lit(1)), 1)}
    seen = look_back(lines, file, "line_no", wanted, lines_per_chunk)
    nearest = F.coalesce(heading, F.col("heading"))
    timed = seen.where(~is_total() & F.col("after").isNull()).withColumns({
        "dataset": F.coalesce(nearest["dataset"], F.lit("")), "given": nearest["run_no"], "time_seconds": tx.duration(line),
    }).where(F.col("time_seconds").isNotNull())
    numbered = number_runs(timed.select(*file, "line_no", "dataset", "given", "time_seconds"), [*file, "dataset"], lines_per_chunk=lines_per_chunk)
    run_no = F.coalesce("given", "run_no")
    return numbered.select(
        *file, "line_no", "dataset", run_no.alias("run_no"), tx.capped_run(run_no, 2**62).alias("run"), "time_seconds"
    )


def block_times(
    lines: DataFrame, file: Sequence[str] = ("file",), lines_per_chunk: int = LINES_PER_CHUNK
) -> DataFrame:
    """Timed lines labelled with the execution they belong to; only executions closed by a marker count."""
    blocked = execution_blocks(lines, file, is_total(), lines_per_chunk=lines_per_chunk)
    closed = lines.groupBy(*file).agg(F.count_if(is_total()).alias("__closed"))
    timed = timed_lines(blocked, file, lines_per_chunk)
    return (
        lookup_join(timed, closed, file)
        .where(F.col("block") <= F.col("__closed"))
        .select(*file, "line_no", "dataset", "block", tx.capped_run(F.col("block"), 2**62).alias("run"), "time_seconds")
    )


def section_times(df: DataFrame, text: str, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """(keys, title, run, seconds) of every complete section in a report text; with ``limit`` higher runs are unknown ones."""
    rows = df.select(*keys, F.inline(tx.sections(F.col(text))))
    run = F.col("run").cast("int")
    return rows.select(
        *keys, F.trim("title").alias("title"), run.alias("run_no"),
        tx.capped_run(run, limit if limit is not None else 2**31 - 1).alias("run"), F.col("seconds").cast("double").alias("seconds"),
    )


def drop_unknown_runs(df: DataFrame, run: str = "run") -> DataFrame:
    return df.where(~F.col(run).contains("Run X"))


def timing_summary(df: DataFrame, groups: Sequence[str] = ("folder", "dataset")) -> DataFrame:
    """Count, mean, sample deviation, min and max of the times per group, two decimals."""
    t = F.col("time_seconds")
    return df.groupBy(*groups).agg(
        F.count(t).alias("n_runs"),
        F.round(F.avg(t), 2).alias("mean"),
        F.round(F.stddev_samp(t), 2).alias("std"),
        F.round(F.min(t), 2).alias("min"),
        F.round(F.max(t), 2).alias("max"),
    )


# How one row, the header and the closing lines look in each output format, and what a cell may not hold as it is.
_ROW = {
    "markdown": ("| ", " | ", " |"),
    "latex": ("", " & ", " \\\\\\hline"),
    "html": ("<tr><td>", "</td><td>", "</td></tr>"),
    "plain": ("", "  ", ""),
}
FORMATS = sorted(_ROW)
_SPECIAL = {
    "markdown": {"\\": "\\\\", "|": "\\|", "\r\n": "<br>", "\n": "<br>", "\r": "<br>"},
    "latex": {
        "\\": "\\textbackslash{}", "&": "\\&", "%": "\\%", "$": "\\$", "#": "\\#", "_": "\\_", "{": "\\{", "}": "\\}",
        "~": "\\textasciitilde{}", "^": "\\textasciicircum{}", "\n": " ", "\r": " ",
    },
    "html": {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"},
    "plain": {"\n": " ", "\r": " "},
}


def escaped(c: Column, style: str) -> Column:
    """Text that a format shows as it is: every special character replaced once, none of a replacement again."""
    special = _SPECIAL[style]
    found = F.regexp_extract_all(c, F.lit("(?s)" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + "|."), F.lit(0))
    pairs = F.create_map(*[F.lit(x) for pair in special.items() for x in pair])
    # most cells hold nothing special
    plain = ~c.rlike("|".join(re.escape(s) for s in special))
    return F.when(plain, c).otherwise(F.array_join(F.transform(found, lambda x: F.coalesce(F.try_element_at(pairs, x), x)), ""))


def _line(cells: Sequence[Column], style: str) -> Column:
    start, between, end = _ROW[style]
    shown = [escaped(F.coalesce(c.cast("string"), F.lit("-")), style) for c in cells]
    return F.concat(F.lit(start), F.concat_ws(between, *shown), F.lit(end))


def _frame(style: str, headers: Sequence[str], title: Column, label: Column | None, note: str | None) -> tuple[list[Column], list[Column]]:
    names = _line([F.lit(h) for h in headers], style)
    title = escaped(title, style)
    noted = escaped(F.lit(note), style) if note is not None else None
    if style == "markdown":
        foot = [F.lit(""), F.concat(F.lit("*"), noted, F.lit("*"))] if note is not None else []
        return [F.concat(F.lit("# "), title), names, F.lit("|" + "---|" * len(headers))], foot
    if style == "latex":
        labelled = [F.concat(F.lit("\\label{tab:"), label, F.lit("}"))] if label is not None else []
        foot = [F.lit("\\smallskip"), F.concat(F.lit("\\textit{Note. "), noted, F.lit("}"))] if note is not None else []
        return [
            F.lit("\\begin{table}[ht]"),
            F.concat(F.lit("\\caption{"), title, F.lit("}")),
            *labelled,
            F.lit("\\begin{tabular}{|" + "c|" * len(headers) + "}"),
            names,
        ], [F.lit("\\end{tabular}"), F.lit("\\end{table}"), *foot]
    if style == "html":
        foot = [F.concat(F.lit("<p>"), noted, F.lit("</p>"))] if note is not None else []
        return [F.concat(F.lit("<h1>"), title, F.lit("</h1>")), F.lit("<table>"), names], [F.lit("</table>"), *foot]
    return [title, names], [noted] if note is not None else []


def _edges(head: Sequence[Column], foot: Sequence[Column]) -> Column:
    """Fixed lines around a body: sections -n..-1 in front of it (section 0), 1..m behind it."""
    placed = [(i - len(head), c) for i, c in enumerate(head)] + [(i + 1, c) for i, c in enumerate(foot)]
    return F.inline(F.array(*[F.struct(F.lit(s).alias("section"), c.alias("line")) for s, c in placed]))


def table_lines(
    df: DataFrame, document: Sequence[str], order: str, cells: dict[str, Column], style: str = "markdown",
    label: str | None = None, note: str | None = None,
) -> DataFrame:
    """Render a result table as text, one row per line: (document, section, sort_key, line).

    Sorting a document by (section, sort_key) gives its text. Nothing is collected per document,
    so it may have any number of rows. Cells, titles and the ``note`` below the table are escaped for the format. With ``label`` a
    LaTeX table can be referred to as ``tab:<label>`` and the document's keys, joined by ``_``; only letters, digits, ``:``, ``-`` and ``_`` stay.
    """
    title = F.concat_ws(" ", *[tx.pretty(F.col(d).cast("string")) for d in document])
    key = F.regexp_replace(F.concat_ws("_", F.lit(label), *document), "[^A-Za-z0-9:_-]", "") if label is not None else None
    head, foot = _frame(style, list(cells), title, key, note)
    body = df.select(
        *document, F.lit(0).alias("section"), F.col(order).alias("sort_key"), _line(list(cells.values()), style).alias("line")
    )
    edges = df.select(*document).distinct().select(*document, _edges(head, foot))
    return body.unionByName(edges, allowMissingColumns=True)


def json_documents(df: DataFrame, key: str, order: str, entry: Sequence[str], name: str = "runs") -> DataFrame:
    """One JSON document per key as ordered text fragments (key, section, sort_key, line).

    The lines of a key in (section, sort_key) order, those without a leading comma first, are ``{"<key>":...,"<name>":[...]}``. A key may
    have any number of entries; only the smallest one is looked up, to know where no comma goes. Equal entries of one
    place have a line each; a NULL key is the document of ``null``.
    """
    keyed = df.select(key, F.col(order).alias("sort_key"), F.to_json(F.struct(*entry)).alias("__entry"))
    body = array_entries(keyed, [key], "sort_key", F.col("__entry")).select(key, F.lit(0).alias("section"), "sort_key", "line")
    as_json = F.to_json(F.struct(key), {"ignoreNullFields": "false"})
    opening = F.concat(F.regexp_replace(as_json, r"\}$", ""), F.lit(f',"{name}":['))
    edges = df.select(key).distinct().select(key, _edges([opening], [F.lit("]}")]))
    return body.unionByName(edges, allowMissingColumns=True)
