"""Rows on their way to Python: dealt out to all cores, in batches of bounded size, freed as soon as they are done with."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: bytes of a batch between Spark and Python, whatever the length of its texts
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: characters of text after which trees of them are collected
SWEEP = 2 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by ``keys``, four tasks a core.

    For tables of short rows that take Python long: a few MB of them are read by one or two tasks, however many they are.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def small_batches() -> None:
    """Have the session cut batches at ``BATCH_BYTES`` (a longer row is a batch of its own) unless it cuts them smaller:
    10,000 long texts would otherwise be held several times over by each side."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        now = str(spark.conf.get(_BATCH, None) or "")
        if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run, small: bool = True):
    """``run`` for ``mapInArrow``, giving freed memory back at its end: idle workers stay, and what they hold counts.

    ``small`` asks for small batches.
    """
    if small:
        small_batches()

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def swept(texts: Iterable[str | None]) -> Iterator[str | None]:
    """``texts``, one after the other; what was made of them and left is collected every ``SWEEP`` characters.

    An element and its children hold each other, so a page's tree stays until the garbage collector takes it, which may
    be some large trees later. Callers keep no tree beyond its text's turn.
    """
    since = 0
    for text in texts:
        yield text
        since += len(text or "")
        if since >= SWEEP:
            gc.collect()
            since = 0
