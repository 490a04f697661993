"""Helpers shared by the training-data operators: Arrow chunking, flat text buffers, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.batches import tidied  # noqa: F401 - the operators take it from here
from gleanery.scratch import drop_shared, write_shared

CHUNK_BYTES = 1 << 19


def lengths(col: pa.Array) -> np.ndarray:
    """Byte length of every value, 0 for null."""
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, count) runs of whole values holding about ``max_bytes``; a longer value stands alone."""
    ends = np.cumsum(lengths(col))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield start, stop - start
        start = stop


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until it clashes with no column of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a BIGINT, b BIGINT)`` as ``(node, root)``, root the least node.

    Large-star / small-star rounds; each round is written to the shared folder, so a lost executor
    costs one round at most. Isolated nodes don't appear. Null ends are ignored.
    """
    spark = edges.sparkSession
    e = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e, path = write_shared(e, "edges")
    if e.isEmpty():
        return spark.createDataFrame([], "node BIGINT, root BIGINT")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after, new_path = write_shared(small, "edges")
        drop_shared(spark, path)
        e, path = after, new_path
        heads = e.select(F.col("u").alias("v")).distinct()
        if e.count() == e.select("u").distinct().count() and e.join(heads, "v", "left_semi").isEmpty():
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    """The Spark schema of ``ddl`` and its Arrow twin for ``mapInArrow`` output."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T._parse_datatype_string(ddl)
    return spark_schema, to_arrow_schema(spark_schema)
