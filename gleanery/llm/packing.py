"""Packing of documents into training sequences: first-fit decreasing in randomised groups.

Lengths are bytes of UTF-8 plus one separator. Documents longer than a bin are cut into full bins and
a rest. A hash spreads the pieces over groups of about ``group_size``; each group is packed on its own
by first-fit decreasing, the first bin that fits being found in a tournament tree of free capacities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_schema
from gleanery.scratch import write_shared

CAPACITY = 8192
GROUP_SIZE = 4096
SEED = 17


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of every length, taken in the given order; each goes to the first bin with room.

    ``tree[1]`` is the largest free capacity of all bins, node *i* has children 2i and 2i+1, and the
    leaves are the bins in order; a bin not yet opened is free in full.
    """
    size = 1
    while size < len(lengths):
        size *= 2
    tree = [capacity] * (2 * size)
    bins, offsets = [], []
    for need in lengths:
        i = 1
        while i < size:
            i *= 2
            if tree[i] < need:
                i += 1
        bins.append(i - size)
        offsets.append(capacity - tree[i])
        tree[i] -= need
        i //= 2
        while i:
            left, right = tree[2 * i], tree[2 * i + 1]
            best = left if left >= right else right
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2
    return bins, offsets


def pack(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_size: int = GROUP_SIZE, seed: int = SEED
) -> DataFrame:
    """Where every row of ``docs`` goes: ``(bin, doc_id, piece, start, length, offset)``.

    ``bin`` is unique over all groups; the piece fills ``length`` places from ``offset`` in it, the last
    of them the separator in a document's last piece; ``start`` is its first byte in the text. Null and
    empty texts are one piece of length 1, the separator. Within a group pieces are ordered by (length
    descending, id with nulls last, hash of the text, piece). Repeated rows and null ids are packed
    each on its own. Other columns are ignored; an empty table gives no rows.
    """
    if capacity < 2:
        raise ValueError("capacity must hold a byte and a separator")
    spark = docs.sparkSession
    t = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(t).alias("h"), F.coalesce(F.octet_length(t), F.lit(0)).cast("bigint").alias("n"))
    rows, _ = write_shared(rows.withColumn("n", F.col("n") + 1), "packing")
    total = rows.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    groups = max(1, -(-total // group_size))
    last = F.floor((F.col("n") - 1) / capacity)
    pieces = rows.select("doc_id", "h", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = pieces.select(
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h", "piece"), F.lit(groups)).alias("grp"), "doc_id", "h", "piece",
        (F.col("piece") * capacity).alias("start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("length"),
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    schema, out = arrow_schema(f"bin bigint, doc_id {id_type}, piece bigint, start bigint, length bigint, offset bigint")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("h", "ascending"), ("piece", "ascending")])
        bins, offsets = first_fit(table.column("length").to_pylist(), capacity)
        base = table.column("grp")[0].as_py() << 32 if len(bins) else 0
        cols = [pa.array(np.array(bins, np.int64) + base), *(table.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(offsets, pa.int64())]
        return pa.Table.from_arrays(cols, schema=out)

    return pieces.groupBy("grp").applyInArrow(one, schema)
