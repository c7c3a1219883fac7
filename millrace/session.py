"""Session defaults and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
SPREAD_ROWS = 1 << 20  # rows of a partition that are dealt for training, at most
_staged: list[str] = []
_shipped: set[str] = set()


def session(app: str = "millrace", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the defaults above; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session, wherever it was started from; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def derived_session(spark: SparkSession, changes: dict[str, str]) -> SparkSession:
    """A session of the same application with the settings of ``spark`` and some ``changes``; ``spark`` keeps its own."""
    derived = spark.newSession()
    for key, value in {**spark.conf.getAll, **changes}.items():
        if derived.conf.isModifiable(key) and derived.conf.get(key, None) != value:
            derived.conf.set(key, value)
    return derived


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A machine-local folder is only acceptable when driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    fallback = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    Used where recomputation after a lost executor could give other rows (random samples)
    and where one small intermediate feeds several jobs.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def staged(df: DataFrame, purpose: str, tasks: int | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    For results that are costly to make and read by several later passes. With ``tasks`` they are read by as many at least, with
    ``settings`` in a session that has them.
    """
    path = work_dir(df.sparkSession, purpose)
    _staged.append(path)
    df.write.parquet(path)
    spark = df.sparkSession
    if tasks:
        settings = {"spark.sql.files.minPartitionNum": str(tasks), "spark.sql.files.openCostInBytes": "1", **(settings or {})}
    if settings:
        spark = derived_session(spark, settings)
    return spark.read.parquet(path)


def training_table(df: DataFrame, purpose: str) -> DataFrame:
    """Rows dealt by ``spread`` as a written table, which is read in as many parts: a fit keeps what a task reads, decoded."""
    parts = spread_parts(df)
    return staged(df.repartition(parts), purpose, parts)


def staged_so_far() -> int:
    """How many staged tables there are, as a mark for ``drop_staged``."""
    return len(_staged)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one; frames that read it cannot be read any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_staged(spark: SparkSession, start: int = 0, end: int | None = None) -> None:
    """Delete staged tables, all or those between two marks; frames that were built on them cannot be read any more."""
    for i in range(start, len(_staged) if end is None else end):
        if _staged[i]:
            delete_path(spark, _staged[i])
            _staged[i] = ""  # marks stay where they are


def spread_parts(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, math.ceil(df.count() / SPREAD_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """As many partitions as the session sets for shuffles, or more, so that each has ``SPREAD_ROWS`` at most, for iterative training.

    A file with a single row group is one task however large the cluster. Every input is dealt alike, so
    starts and samples of a fit depend on the setting and not on how the files were cut.
    """
    return df.repartition(spread_parts(df))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """So many rows of a written table in a partition, whatever the session sets and however the files were cut."""
    return df.repartition(max(1, math.ceil(df.count() / rows)))


@contextmanager
def persisted(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame in memory, spilling to disk, for the length of a block."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
