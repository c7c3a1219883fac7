"""Run numbers of monitored operations, kept in the state of a stream.

A monitor sees one operation at a time. Whenever the routed key (operation and input file) differs from the one
before, that key begins its next run; being idle in between begins none. State is kept by monitor: the current
key as one value and a map from key to its runs so far, of which only the keys that change are read and written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructType

from millrace.streaming.ingest import ROUTE

UNKNOWN_INPUT = "unknown"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state by map needs; the session's own choice returns afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_numbers(keys: np.ndarray, current: str | None, so_far: dict[str, int]) -> np.ndarray:
    """Run of each sample, given the key before the first one and how many runs each key had; both have no NULLs but ``current``.

    ``so_far`` is brought up to date.
    """
    before = np.concatenate([np.array([current], object), keys[:-1]])
    begins = pd.Series(keys != before)
    names = pd.Series(keys)
    numbers = begins.groupby(names, sort=False).cumsum() + names.map(lambda k: so_far.get(k, 0))
    so_far.update(numbers.groupby(names, sort=False).last().astype(int).to_dict())
    return numbers.to_numpy(np.int32)


class _Runs(StatefulProcessor):
    def __init__(self, columns: Sequence[str], order: Sequence[str]) -> None:
        self.columns, self.order = list(columns), list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "key string")
        self.runs = handle.getMapState("runs", "key string", "n int")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows), ignore_index=True)
        samples.columns = self.columns  # names of computed columns are not handed on
        samples = samples.sort_values([*self.order, *ROUTE], kind="stable", na_position="first", ignore_index=True)
        keys = (samples[ROUTE[0]] + "__" + samples[ROUTE[1]]).to_numpy(object)
        current = self.current.get()[0] if self.current.exists() else None
        met = pd.unique(keys)
        before = {k: self.runs.getValue((k,))[0] for k in met if self.runs.containsKey((k,))}
        after = dict(before)
        samples["run"] = run_numbers(keys, current, after)
        for k in met:
            if after[k] != before.get(k, 0):
                self.runs.updateValue((k,), (after[k],))
        self.current.update((keys[-1],))
        yield samples

    def close(self) -> None:
        pass


def number_runs(samples: DataFrame, monitor: str, order: Sequence[str]) -> DataFrame:
    """Busy samples with their ``run``, counted for each monitor and key from 1 over the whole life of the stream.

    Within a trigger the samples of a monitor are taken by ``order``, whose columns must tell them apart; triggers are taken
    as they come, so a sample that arrives late is numbered when it arrives. NULL monitors are one monitor, NULL operations are
    idle (``busy_samples`` leaves those out) and a NULL input file is ``unknown``. A task holds one monitor's samples of one
    trigger, which the stream's ``files_per_trigger`` bounds.
    """
    known = samples.withColumn(ROUTE[1], F.coalesce(ROUTE[1], F.lit(UNKNOWN_INPUT)))
    schema = StructType([*known.schema.fields]).add("run", IntegerType())
    return known.groupBy(monitor).transformWithStateInPandas(_Runs(known.columns, order), schema, "Append", "None")
