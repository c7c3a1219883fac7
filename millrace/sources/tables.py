"""Parquet, CSV and JSON tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millrace.session import derived_session, staged


def read_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns is not None else df


def read_parallel(spark: SparkSession, path: str, tasks: int) -> DataFrame:
    """Parquet scan asked to run as at least ``tasks`` tasks, without a shuffle.

    How a scan is split is a setting of the session it belongs to, so the scan gets a session of its own, with the same
    settings otherwise; the given one and its other scans stay as they are. Small files are split as well. Row groups are the
    smallest unit; ``repartition`` after the scan is the way to go beyond them.
    """
    changes = {"spark.sql.files.minPartitionNum": str(tasks), "spark.sql.files.openCostInBytes": "1"}
    return derived_session(spark, changes).read.parquet(path)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give the schema: without it every file is read twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_categories(spark: SparkSession, template: str, categories: Sequence[str]) -> dict[str, DataFrame]:
    """One frame per category from a path template."""
    return {c: spark.read.parquet(template.format(c)) for c in categories}


def rows(spark: SparkSession, records: Sequence[dict], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(records), schema)


def numbers(spark: SparkSession, n: int, tasks: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, tasks) if tasks else spark.range(n)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None,
                  partition_by: Sequence[str] = (), target_bytes: int | None = None) -> None:
    """``mode='append'`` adds to what is there; ``files`` sets the number of output files, ``target_bytes`` their size.

    For a target size the rows are written once as they come, which tells their size as Parquet, and then dealt evenly over as many
    files as that needs, whatever keys they have. Rows of very unlike sizes make files of unlike sizes.
    """
    if target_bytes is not None:
        df = staged(df, "sized")
        files = max(1, round(bytes_below(df.sparkSession, df.inputFiles()) / target_bytes))
    out = df.repartition(files) if files else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def bytes_below(spark: SparkSession, files: Sequence[str]) -> int:
    """Bytes of all files in the folders of the given ones."""
    total = 0
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(lines: DataFrame, key: str, path: str, folders: bool = True) -> None:
    """Write text fragments of many documents, each document's lines in order.

    Range partitioning by the sort columns lets a document of any size span several tasks. With ``folders`` each document has
    a folder of its own. Otherwise the files, Parquet by name, hold (key, line) with documents one after the other, which is the
    form for many documents: the number of files then does not depend on them.
    """
    order = [key, "section", "sort_key", F.col("line").startswith(","), "line"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "line")
    if folders:
        ordered.write.mode("overwrite").partitionBy(key).text(path)
    else:
        ordered.write.mode("overwrite").parquet(path)


def write_ordered(lines: DataFrame, order: Sequence[str], path: str, line: str = "line") -> None:
    """Write one document's text fragments so that the files of ``path``, by name, hold them in order, NULLs first."""
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(line).write.mode("overwrite").text(path)
