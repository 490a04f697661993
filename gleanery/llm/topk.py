"""Exact top-k search by tiled matrix products.

Vectors of equal length are laid out in blocks, one row a block. Every pair of a query block and a
shard block is one tile: a matrix product, of which only the k best of each query are kept. The lists of
a query block are merged in a tree of bounded fan-in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_schema
from gleanery.scratch import write_shared

K = 10
BLOCK = 4096
FAN_IN = 16
#: similarities are compared at this many decimals
PLACES = 6
_SLICE = 512


def unit(data, dim: int, kind: str) -> np.ndarray:
    """The vectors of a block as rows of length 1, in float64."""
    x = np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def number_kind(vectors: DataFrame, vector: str) -> str:
    return "f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "f8"


def _numbers(vectors: DataFrame, vector: str) -> Column:
    return F.col(f"`{vector}`").cast("array<float>" if number_kind(vectors, vector) == "f4" else "array<double>")


def sound(vectors: DataFrame, id_col: str, vector: str) -> Column:
    """Whether a row has an id and a vector with a direction; never null."""
    v = _numbers(vectors, vector)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(f"`{id_col}`").cast("bigint").isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id BIGINT, v)`` of the rows that are ``sound``."""
    return vectors.where(sound(vectors, id_col, vector)).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), _numbers(vectors, vector).alias("v"))


def blocks(vectors: DataFrame, id_col: str, vector: str, block: int = BLOCK) -> DataFrame:
    """Usable vectors as ``(block BIGINT, dim INT, ids ARRAY<BIGINT>, data BINARY)``, in 32-bit floats if they came as these.

    Left out are null ids and vectors that are null, empty, of no length, or hold a null or a number
    that isn't finite.
    """
    kind = number_kind(vectors, vector)
    good = usable(vectors, id_col, vector)
    schema, out = arrow_schema("dim int, ids array<bigint>, data binary")

    def lay(batches):
        held: dict[int, list] = {}

        def send(dim, force=False):
            parts = held.get(dim, [])
            while parts and (sum(len(p[0]) for p in parts) >= block or force):
                ids, x = (np.concatenate(c) for c in zip(*parts))
                parts = [(ids[block:], x[block:])] if len(ids) > block else []
                rows = pa.array([ids[:block]], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), rows, pa.array([x[:block].astype(kind).tobytes()], pa.binary())], schema=out)
            held[dim] = parts

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            size = lists.value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                held.setdefault(dim, []).append((ids[rows], x))
                yield from send(dim)
        for dim in list(held):
            yield from send(dim, force=True)

    return good.mapInArrow(lay, schema).select(F.monotonically_increasing_id().alias("block"), "dim", "ids", "data")


def _best(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, id) of the k best of every row by (rounded score descending, id), without the row's own id."""
    if np.isin(own, ids).any():
        score = np.where(own[:, None] == ids[None, :], -np.inf, score)
    wide = min(k, score.shape[1])
    # the k best, and all that could round up to the last of them
    edge = np.partition(score, score.shape[1] - wide, axis=1)[:, score.shape[1] - wide]
    row, col = np.nonzero(score >= (edge - 2 * 10.0**-PLACES)[:, None])
    value, other = np.round(score[row, col], PLACES) + 0.0, ids[col]
    keep = other != own[row]
    return _first(row[keep], value[keep], other[keep], k)


def _first(row, value, other, k):
    order = np.lexsort((other, -value, row))
    row, value, other = row[order], value[order], other[order]
    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
    rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    return row[rank < k], value[rank < k], other[rank < k]


def search(queries: DataFrame, corpus: DataFrame | None = None, id_col: str = "vec_id", vector: str = "embedding", k: int = K, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, neighbor_id, similarity)``: the ``k`` most cosine-similar vectors of every query.

    ``corpus`` is ``queries`` itself by default; a vector with the query's own id is never its neighbour.
    Similarities are rounded to 6 places and ties go to the lower id; rank starts at 1. A query finds
    only vectors of its own dimension and may find fewer than ``k``. Null ids and vectors that have no
    direction (see ``blocks``) neither ask nor answer. Repeated ids are separate vectors: a repeated query
    gets one list for each row, a repeated neighbour may be listed twice. Other columns are ignored.
    """
    mine, _ = write_shared(blocks(queries, id_col, vector, block), "topk-queries")
    theirs = mine if corpus is None else write_shared(blocks(corpus, id_col, vector, block), "topk-corpus")[0]
    schema, out = arrow_schema("q bigint, qpos int, qid bigint, part bigint, score double, id bigint")

    kind_a, kind_b = number_kind(queries, vector), number_kind(queries if corpus is None else corpus, vector)

    def tile(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q, part, dim = (batch.column(i)[row].as_py() for i in (0, 1, 2))
                qids, ids = (batch.column(i)[row].values.to_numpy() for i in (3, 5))
                a = unit(batch.column(4)[row].as_buffer(), dim, kind_a)
                b = unit(batch.column(6)[row].as_buffer(), dim, kind_b)
                for at in range(0, len(qids), _SLICE):
                    some = qids[at : at + _SLICE]
                    r, value, other = _best(a[at : at + _SLICE] @ b.T, ids, some, k)
                    yield emit(np.full(len(r), q), r + at, some[r], np.full(len(r), part), value, other)

    def emit(q, pos, qid, part, value, other):
        cols = [pa.array(q), pa.array(pos.astype(np.int32)), pa.array(qid), pa.array(part), pa.array(value), pa.array(other)]
        return pa.RecordBatch.from_arrays(cols, schema=out)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        q, pos, qid, part, value, other = (table.column(i).to_numpy() for i in range(6))
        owner = np.zeros(int(pos.max()) + 1, np.int64)
        owner[pos] = qid
        pos, value, other = _first(pos, value, other, k)
        to = np.full(len(pos), key[1].as_py(), np.int64)
        return pa.Table.from_batches([emit(np.full(len(pos), q[0]), pos, owner[pos], to, value, other)])

    # one query block and up to four shard blocks a task
    many = max(1, theirs.count())
    left = mine.repartition(max(1, mine.count()), "block").select("block", "dim", "ids", "data")
    right = theirs.repartition(-(-many // 4), "block").select(
        F.pmod(F.xxhash64("block"), F.lit(many)).alias("part"), F.col("dim").alias("d"), F.col("ids").alias("ids2"), F.col("data").alias("data2")
    )
    # written as a range, so that it isn't shuffled by the one dimension that all vectors share
    pairs = left.join(right, (F.col("dim") - F.col("d")).between(0, 0))
    lists = pairs.select("block", "part", "dim", "ids", "data", "ids2", "data2").mapInArrow(tile, schema)
    while True:
        many = -(-many // FAN_IN)
        lists = lists.groupBy("q", F.pmod("part", F.lit(many)).alias("to")).applyInArrow(merge, schema)
        if many == 1:
            break
    rank = F.row_number().over(Window.partitionBy("q", "qpos").orderBy(F.col("score").desc(), "id"))
    return lists.select(F.col("qid").alias("query_id"), rank.alias("rank"), F.col("id").alias("neighbor_id"), F.col("score").alias("similarity"))
