"""Telemetry arriving as files, routed to one folder per operation and input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

IDLE = "idle"
ROUTE = ("operation", "input_file")


def sample_stream(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet",
    name_glob: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_format)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def busy_samples(samples: DataFrame) -> DataFrame:
    """Samples taken while an operation ran, with path-safe route keys."""
    clean = {c: F.replace(F.col(c), F.lit(" "), F.lit("_")) for c in ROUTE}
    return samples.where(F.coalesce(F.col("operation"), F.lit(IDLE)) != IDLE).withColumns(clean)


def route_to_files(samples: DataFrame, out: str, checkpoint: str, folders: Sequence[str] = ROUTE) -> StreamingQuery:
    """Append every available sample below ``out/operation=…/input_file=…`` and stop.

    Progress, and state if the stream has any, live in the checkpoint, so a restart neither loses nor
    repeats samples.
    """
    return (
        samples.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(*folders)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
