"""Small helpers for the operators that run over pandas batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: bytes of rows that go to a Python worker at once
BATCH_BYTES = 8 << 20


def objects(values: list) -> pd.Series:
    """A plain object column, whatever string type pandas would infer."""
    return pd.Series(values, dtype=object)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends rows to Python by bytes and not by number alone, so long texts don't pile up.

    A smaller setting of the session stays.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def without(df: DataFrame, *taken: str) -> list[str]:
    """The columns of ``df`` but those that a result's own columns replace, in any case of letters."""
    gone = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in gone]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker, which goes on to other tasks, gives its memory back."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
