"""Incremental runs: items streamed as pages arrive, keys remembered between batches and between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from gleanery.columns import FIRST, KEPT, ORDER, PAGE_URL
from gleanery.operators.filters import string_form
from gleanery.plans.blueprint import Blueprint
from gleanery.plans.run import all_pages
from gleanery.operators import sink
from gleanery.scratch import write_shared


def seen_keys(spark: SparkSession, path: str) -> DataFrame:
    """``(key)`` of earlier runs; none where there is no state yet."""
    try:
        return spark.read.schema("key string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "key string")
        raise


def remember(items: DataFrame, key: str, path: str) -> None:
    """Append the items' non-blank keys to the state."""
    items.select(string_form(items, key).alias("key")).where("key <> ''").distinct().write.mode("append").parquet(path)


def resume(spark: SparkSession, bp: Blueprint, source: DataFrame, state: str, **more) -> DataFrame:
    """A run that skips the keys of earlier runs and then adds its own. The result is written before the state is."""
    from gleanery.plans.run import run

    got, _ = write_shared(run(spark, bp, source, seen=seen_keys(spark, state), **more), "resumed")
    if bp.dedup_key in got.columns:
        remember(got, bp.dedup_key, state)
    return got


def stream_items(
    pages: DataFrame, bp: Blueprint, emit: Callable[[DataFrame, int], None], checkpoint: str, state: str, available_now: bool = True
) -> StreamingQuery:
    """Items of a stream of ``pages(url, html)``, handed to ``emit(items, batch_id)`` batch by batch.

    Each batch is judged in order against the keys kept in ``state``, so the first of equal items wins within
    and across batches. A batch that is repeated after a failure is judged against the keys of the batches
    before it only, and so gives the same items again.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        key = bp.dedup_key if bp.dedup else None
        old = spark.read.schema("key string, batch bigint").option("recursiveFileLookup", True).parquet(state) if _exists(spark, state) else spark.createDataFrame([], "key string, batch bigint")
        items = all_pages(bp, df)
        judged = sink.judged(items, key, bp.rules if bp.filter else (), old.where(F.col("batch") < number), ORDER)
        judged, _ = write_shared(judged, "batch")
        if key is not None:
            keys = judged.where(F.col(FIRST)).select(string_form(judged, key).alias("key"), F.lit(number).cast("bigint").alias("batch")).where("key <> ''")
            keys.write.mode("overwrite").parquet(f"{state}/n{number}")
        emit(judged.where(F.col(KEPT)).drop(FIRST, KEPT, PAGE_URL, *ORDER), number)

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums of events by time window and kind, late rows allowed for; works on streams and tables."""
    at = F.col(time).cast("timestamp")
    df = events.withColumn(time, at)
    df = df.withWatermark(time, late) if df.isStreaming else df
    got = df.groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")

