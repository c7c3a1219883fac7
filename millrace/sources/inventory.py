"""An inventory of the Parquet and CSV files below some folders.

Tasks list the folders, a subfolder each, and open each file: of a Parquet file only the footer is read, of a CSV file the
header line. Rows of CSV files are counted by Spark's reader, which splits large files. A file that cannot be
read, an empty one too, keeps its row, with the error. The driver holds the given folders only.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.text import in_gb, in_mb

FORMATS = ("parquet", "csv")
HEADER_BYTES = 1 << 16  # read at a time until the header line ends
PARTS_PER_CORE = 4
_LISTED = "path string, size_bytes bigint, is_folder boolean"
_CONTENTS = "path string, size_bytes bigint, format string, footer_rows bigint, n_columns int, error string"


def plain_path(column: Column) -> Column:
    """Decoded path with one form of the ``file:`` scheme; ``_metadata.file_path`` is percent-encoded, listed paths are not."""
    return one_scheme(F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))))


def one_scheme(column: Column) -> Column:
    return F.regexp_replace(column, "^file:/+", "file:///")


def resolved(spark: SparkSession, folder: str) -> str:
    """The place behind a mount point, which tasks can open without Spark; other folders as they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.resolvePath(path).toString()


def _place(path: str):
    """File system, path on it, and what stands before that path in a URI."""
    from pyarrow import fs

    scheme, authority, rest = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):)?(?://([^/]*))?(.*)", path, re.DOTALL).groups()
    scheme = scheme or "file"
    files, place = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}{quote(rest)}")
    return files, place, f"{scheme}://{authority or ''}" if place.startswith("/") else f"{scheme}://"


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _listed(recursive: bool):
    """What lies in each folder, or a file itself. Files below hidden folders are left out."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place, before = _place(path)
                (own,) = files.get_file_info([place])
                found = [own] if own.is_file else files.get_file_info(fs.FileSelector(place, recursive=recursive))
                start = 0 if own.is_file else len(place)
                found = [f for f in found if own.is_file or not any(map(_hidden, f.path[start:].strip("/").split("/")))]
                columns = [f"{before}{f.path}" for f in found], [f.size or 0 for f in found], [not f.is_file for f in found]
                kinds = pa.string(), pa.int64(), pa.bool_()
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "size_bytes", "is_folder"])

    return run


def list_files(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(path, size_bytes) of all files at and below the folders; each subfolder of a given one is listed by a task of its own."""
    tasks = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    roots = spark.createDataFrame([(f,) for f in folders], "path string").repartition(max(1, min(len(folders), tasks)))
    first = roots.mapInArrow(_listed(recursive=False), _LISTED)
    below = first.where("is_folder").select("path").repartition(tasks).mapInArrow(_listed(recursive=True), _LISTED)
    return first.unionByName(below).where("NOT is_folder").select("path", "size_bytes")


def parquet_contents(path: str) -> tuple[int | None, int]:
    """Rows and columns (a nested one counts once) from a file's footer."""
    from pyarrow import parquet

    files, place, _ = _place(path)
    with files.open_input_file(place) as file:
        found = parquet.ParquetFile(file)
        return found.metadata.num_rows, len(found.schema_arrow.names)


def first_cells(path: str) -> list[str]:
    """Cells of a CSV file's first line; none of an empty file."""
    files, place, _ = _place(path)
    head = b""
    with files.open_input_file(place) as file:
        while b"\n" not in head and (piece := file.read(HEADER_BYTES)):
            head += piece
    return next(csv.reader([head.split(b"\n")[0].decode("utf-8-sig", "replace")]), [])


def csv_contents(path: str) -> tuple[int | None, int]:
    """Columns from a file's first line; rows are counted elsewhere."""
    return None, len(first_cells(path))


_READ = {"parquet": parquet_contents, "csv": csv_contents}


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple] = []
        for path, kind in zip(batch.column("path").to_pylist(), batch.column("format").to_pylist(), strict=True):
            try:
                found.append((*_READ[kind](path), None))
            except Exception as e:  # whatever a reader says of a broken file is what the inventory reports
                found.append((None, None, f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}"))
        rows, columns, errors = zip(*found, strict=True) if found else ((), (), ())
        arrays = [*batch.select(["path", "size_bytes", "format"]).columns, pa.array(rows, pa.int64()), pa.array(columns, pa.int32())]
        names = ["path", "size_bytes", "format", "footer_rows", "n_columns", "error"]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(errors, pa.string())], names=names)


def _csv_rows(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Rows by file: its lines without the first and without blank ones."""
    reader = spark.read.schema("first string").option("header", True).option("recursiveFileLookup", True)
    lines = reader.option("pathGlobFilter", "*.csv").csv(list(folders))
    return lines.groupBy(plain_path(F.col("_metadata.file_path")).alias("path")).agg(F.count(F.lit(1)).alias("csv_rows"))


def file_inventory(spark: SparkSession, folders: Sequence[str], formats: Sequence[str] = FORMATS) -> DataFrame:
    """A row per file: path, directory, file, format, size_bytes, size_mb, size_gb, n_rows, n_columns, error.

    A file without rows has 0; one that cannot be read has NULL rows and columns and its error. Hidden files (names that
    begin with ``_`` or ``.``) are left out, and folders without matching files give no rows.
    """
    folders = [resolved(spark, f) for f in folders]
    tasks = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    kind = F.regexp_extract("path", f"\\.({'|'.join(formats)})$", 1)
    wanted = list_files(spark, folders).withColumn("format", kind).where("format <> ''")
    files = wanted.repartition(tasks).mapInArrow(_read_contents, _CONTENTS)
    rows = F.col("footer_rows")
    if "csv" in formats:
        files = files.join(_csv_rows(spark, folders), "path", "left")
        counted = F.when(F.isnull("error"), F.coalesce("csv_rows", F.lit(0).cast("bigint")))
        rows = F.when(F.col("format") == "csv", counted).otherwise(rows)
    size = F.col("size_bytes")
    return files.select(
        "path",
        F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1).alias("directory"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        "format",
        "size_bytes",
        in_mb(size).alias("size_mb"),
        in_gb(size).alias("size_gb"),
        rows.alias("n_rows"),
        "n_columns",
        "error",
    )


def grouped_inventory(files: DataFrame) -> DataFrame:
    """Files of a directory that share a base name, the name before the first ``.`` and ``-``, as one table.

    Its format is Parquet only if all its files are; rows and sizes are summed, and ``n_unreadable`` counts the files left out.
    """
    base = F.regexp_extract("file", "^([^.-]*)", 1)
    return files.groupBy("directory", base.alias("base_name")).agg(
        F.when(F.bool_and(F.col("format") == "parquet"), "parquet").otherwise("csv").alias("format"),
        F.sum("size_bytes").alias("size_bytes"),
        in_gb(F.sum("size_bytes")).alias("size_gb"),
        F.sum("n_rows").alias("n_rows"),
        F.max("n_columns").alias("n_columns"),
        F.count(F.lit(1)).alias("n_files"),
        F.count("error").alias("n_unreadable"),
    )
