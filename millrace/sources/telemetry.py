"""Telemetry CSV files of many runs, told apart by their whole path."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millrace.operators.lookup import lookup_join
from millrace.operators.telemetry import TELEMETRY
from millrace.sources.inventory import first_cells, list_files, plain_path, resolved

WIDEST = 64  # columns a file may have; those beyond are not read
_NAMES = [f.name for f in TELEMETRY.fields]
_FIRST = _NAMES[0]  # the name by which a header line is known


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, header) of the files whose first line names the columns."""
    for batch in batches:
        found = [(path, [c.strip() for c in first_cells(path)]) for path in batch.column(0).to_pylist()]
        found = [(path, cells) for path, cells in found if _FIRST in cells]
        paths = pa.array([p for p, _ in found], pa.string())
        yield pa.RecordBatch.from_arrays([paths, pa.array([c for _, c in found], pa.list_(pa.string()))], names=["path", "header"])


def read_telemetry(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Telemetry columns as text, ``source`` and ``path`` of all ``.csv`` files at and below the given places.

    ``path`` is the file's whole decoded path, ``source`` the part of it below the deepest folder that holds all given places, so
    files of equal names in different folders stay apart. A file whose first line names the columns is read by those names,
    in whatever order they come, with NULL for missing ones (names that are no telemetry column's leave the places they stand
    at as they are); any other file has ``TELEMETRY`` in order. Lines that
    repeat a header are left out; rows without a timestamp stay, for the gate. Only first lines are read beforehand.
    """
    places = [re.sub("^file:/+", "file:///", resolved(spark, p)) for p in ([path] if isinstance(path, str) else path)]
    folders = [p.rsplit("/", 1)[0] if p.endswith(".csv") else p.rstrip("/") for p in places]
    base = "/".join(posixpath.commonprefix([f.split("/") for f in folders]))
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(WIDEST)])
    raw = spark.read.schema(wide).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(places)
    cells = F.array(*wide.fieldNames())
    raw = raw.select(cells.alias("cells"), plain_path(F.col("_metadata.file_path")).alias("path"))
    listed = list_files(spark, places).where("path LIKE '%.csv'").select("path")
    headers = listed.mapInArrow(_headers, "path string, header array<string>")
    rows = lookup_join(raw.where(~F.coalesce(F.array_contains("cells", _FIRST), F.lit(False))), headers, ["path"], "left")
    columns = []
    for i, name in enumerate(_NAMES):
        named = F.array_position("header", name).cast("int") - 1
        taken = F.coalesce(F.get("header", F.lit(i)).isin(_NAMES), F.lit(False))
        at = F.when(named >= 0, named).when(~taken, F.lit(i))
        columns.append(F.get("cells", at).alias(name))
    source = F.substring("path", len(base) + 2, 2**31 - 1).alias("source")
    return rows.select(*columns, source, "path")
