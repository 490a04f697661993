"""LM scoring by context-tree weighting over binary-decomposed bytes.

Every byte is eight binary decisions, most significant bit first. Decision *j* (one of 255 bit
prefixes) has its own context tree whose nodes are the last 0..``depth`` bytes of the document,
newest first; bytes before the start count as 0. A node with counts (n0, n1) has the
Krichevsky-Trofimov block probability Pe, and

    Pw(s) = Pe(s)                                at full depth,
    Pw(s) = (Pe(s) + prod_c Pw(cs)) / 2          above it.

Pe depends on counts alone, so the trees are made from one distributed count of (depth+1)-grams
instead of a pass in text order, and equal what a sequential coder would reach after the same text.
A byte is then priced by the posterior mixture of the KT estimates on its context path, from the
root to full depth.

Documents are priced by text they were not counted in: a hash of the text puts each in one of two
folds, and each fold is priced by the counts of the other. Equal texts share a fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_schema, flat, runs, slices, tidied
from gleanery.scratch import drop_shared, write_shared

DEPTH = 4
#: bytes of text in a block of documents, which gets the prices of its own grams
BLOCK_BYTES = 16 << 20
#: gram occurrences held by a worker before they are merged
BUFFER = 1 << 21
_LOG_HALF = float(np.log(0.5))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln(gamma(x)) for x > 0: eight recurrence steps, then Stirling's series."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    # far beyond 1e30 the product would overflow, but counts stay below 2**63
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(float), n1.astype(float)
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - np.log(np.pi)


def _position_grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Gram of every byte: bytes newest context first, then the byte itself, as one number."""
    n = len(data)
    key = data.astype(np.uint64)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    since = np.arange(n) - start
    for back in range(1, depth + 1):
        prev = np.zeros(n, np.uint64)
        if n > back:
            prev[back:] = np.where(since[back:] >= back, data[:-back], 0)
        key |= prev << np.uint64(8 * (depth + 1 - back))
    return key


def _pieces(col: pa.Array, depth: int, size: int = 1 << 20):
    """(first document, documents, grams, document of each gram) of ~1 MB runs; a longer text is cut with overlap."""
    for start, count in slices(col, size):
        data, offsets = flat(col.slice(start, count))
        if len(data) <= size or count > 1:
            grams = _position_grams(data, offsets, depth)
            yield start, count, grams, np.repeat(np.arange(count, dtype=np.uint64), np.diff(offsets))
            continue
        for at in range(0, len(data), size):
            lead = min(at, depth)
            part = data[at - lead : at + size]
            grams = _position_grams(part, np.array([0, len(part)]), depth)[lead:]
            yield start, 1, grams, np.zeros(len(grams), np.uint64)


def _merge(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = runs(keys)
    if not len(begin):
        return (keys, *counts)
    return (keys[begin], *(np.add.reduceat(c[order], begin) for c in counts))


def gram_counts(docs: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """``(gram BIGINT, n0 BIGINT, n1 BIGINT)``: occurrences of every (depth+1)-gram in either fold."""
    if not 2 <= depth <= 4:
        raise ValueError("depth must be 2, 3 or 4: the gram and a document number share 64 bits")
    df = docs.select(F.col(f"`{text}`").alias("t")).where("t <> ''").select("t", _fold("t").alias("fold"))
    schema, out = arrow_schema("gram bigint, n0 bigint, n1 bigint")

    def count(batches):
        kept: list[tuple[np.ndarray, ...]] = []
        held = 0

        def merged():
            return _merge(*(np.concatenate(x) for x in zip(*kept)))

        for batch in batches:
            fold = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            for start, docs_in, grams, doc in _pieces(batch.column(0), depth):
                keys = np.sort(grams << np.uint64(1) | fold[start : start + docs_in][doc.astype(np.int64)])
                begin = runs(keys)
                times = np.diff(np.append(begin, len(keys)))
                gram, one = keys[begin] >> np.uint64(1), (keys[begin] & np.uint64(1)).astype(bool)
                kept.append((gram, np.where(one, 0, times), np.where(one, times, 0)))
                held += len(gram)
                if held > BUFFER:
                    kept = [merged()]
                    held = len(kept[0][0])
                    if held > BUFFER // 2:
                        yield from send(kept[0])
                        kept, held = [], 0
        if kept:
            yield from send(merged())

    def send(table):
        for i in range(0, len(table[0]), 1 << 17):
            cols = [pa.array(x[i : i + (1 << 17)].astype(np.int64)) for x in table]
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return df.mapInArrow(tidied(count), schema).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _fold(text: str):
    return F.xxhash64(text).bitwiseAND(1).cast("int")


class _Level:
    """Nodes of one depth for one fold's counts: sorted keys (context << 8 | bit prefix) and their values."""

    def __init__(self, keys, n0, n1, below):
        self.keys, self.n0, self.n1 = keys, n0, n1
        pe = log_kt(n0, n1)
        self.pw = pe if below is None else np.logaddexp(_LOG_HALF + pe, _LOG_HALF + below)
        # share of the node's own estimate in its mixture
        self.own = np.ones(len(keys)) if below is None else np.exp(np.minimum(_LOG_HALF + pe - self.pw, 0.0))


def _up(key: np.ndarray) -> np.ndarray:
    """The parent's key: the oldest context byte dropped, the bit prefix kept."""
    return (key >> np.uint64(16)) << np.uint64(8) | (key & np.uint64(255))


def _levels(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[_Level]:
    """Levels ``depth`` down to ``top`` of the nodes above the grams; zero counts make nodes as well."""
    ctx, sym = gram >> np.uint64(8), gram & np.uint64(255)
    keys, zeros, ones = [], [], []
    for bit in range(8):
        keys.append(ctx << np.uint64(8) | np.uint64(1 << bit) | (sym >> np.uint64(8 - bit)))
        is_one = (sym >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        zeros.append(np.where(is_one, 0, n))
        ones.append(np.where(is_one, n, 0))
    key, n0, n1 = _merge(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
    found = [_Level(key, n0, n1, None)]
    for _ in range(depth, top, -1):
        last = found[-1]
        key, n0, n1, below = _merge(_up(last.keys), last.n0, last.n1, last.pw)
        found.append(_Level(key, n0, n1, below))
    return found


def _mix(levels: list[_Level], gram: np.ndarray, depth: int, head) -> np.ndarray:
    """Bits of every gram's last byte. ``head(keys at the top level, ones, mixture)`` adds the depths above."""
    ctx, sym = gram >> np.uint64(8), gram & np.uint64(255)
    total = np.zeros(len(gram))
    for bit in range(8):
        key = ctx << np.uint64(8) | np.uint64(1 << bit) | (sym >> np.uint64(8 - bit))
        one = (sym >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
        p = None
        for level in levels:
            at = np.searchsorted(level.keys, key)
            hits = np.where(one, level.n1[at], level.n0[at])
            kt = (hits + 0.5) / (level.n0[at] + level.n1[at] + 1.0)
            p = kt if p is None else level.own[at] * kt + (1 - level.own[at]) * p
            key = _up(key)
        total -= np.log2(head(key, one, p))
    return total


#: depths 2 and more are built where their two newest bytes are; 1 and 0 are small and joined after
_TOP = 2


def _partitions(grams: DataFrame, depth: int) -> DataFrame:
    return grams.repartition(F.shiftright("gram", 8 * (depth + 1 - _TOP)))


def _table(batches):
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got).combine_chunks()
    return t.column(0).to_numpy().astype(np.uint64), t.column(1).to_numpy(), t.column(2).to_numpy()


def _head(grams: DataFrame, depth: int) -> list[dict]:
    """For the counts of either fold, the arrays of the depth 1 and depth 0 nodes (at most 65536 x 255 in all)."""
    schema, out = arrow_schema("fold int, key bigint, n0 bigint, n1 bigint, below double")

    def upper(batches):
        table = _table(batches)
        if table is None:
            return
        for fold in (0, 1):
            top = _levels(table[0], table[1 + fold], depth, _TOP)[-1]
            key, n0, n1, below = _merge(_up(top.keys), top.n0, top.n1, top.pw)
            cols = [np.full(len(key), fold, np.int32), key.astype(np.int64), n0, n1, below]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=out)

    nodes = _partitions(grams, depth).mapInArrow(tidied(upper), schema)
    nodes = nodes.groupBy("fold", "key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()
    heads = []
    for fold in (0, 1):
        part = nodes.filter(pc.equal(nodes.column("fold"), fold))
        key, n0, n1, below = (part.column(c).to_numpy() for c in ("key", "n0", "n1", "below"))
        order = np.argsort(key)
        one = _Level(key[order].astype(np.uint64), n0[order], n1[order], below[order])
        key, n0, n1, below = _merge(_up(one.keys), one.n0, one.n1, one.pw)
        root = _Level(key, n0, n1, below)
        heads.append({"one": (one.keys, one.n0, one.n1, one.own), "root": (root.keys, root.n0, root.n1, root.own), "log_pw": float(root.pw.sum())})
    return heads


def _finish(head: dict):
    def over(key, one, p):
        for keys, n0, n1, own in (head["one"], head["root"]):
            at = np.searchsorted(keys, key)
            hits = np.where(one, n1[at], n0[at])
            p = own[at] * (hits + 0.5) / (n0[at] + n1[at] + 1.0) + (1 - own[at]) * p
            key = _up(key)
        return p

    return over


def prices(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(gram, bits0, bits1)``: the gram's last byte in bits for documents of fold 0 and of fold 1."""
    heads = grams.sparkSession.sparkContext.broadcast(_head(grams, depth))
    schema, out = arrow_schema("gram bigint, bits0 float, bits1 float")

    def price(batches):
        table = _table(batches)
        if table is None:
            return
        bits = [
            _mix(_levels(table[0], table[1 + other], depth, _TOP), table[0], depth, _finish(heads.value[other]))
            for other in (1, 0)
        ]
        cols = [pa.array(table[0].astype(np.int64)), *(pa.array(b.astype(np.float32)) for b in bits)]
        yield pa.RecordBatch.from_arrays(cols, schema=out)

    return _partitions(grams, depth).mapInArrow(tidied(price), schema)


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, n_bytes, bits, bits_per_byte)``.

    A null or empty text has 0 bytes, 0 bits and a null ``bits_per_byte``. Null ids, repeated rows and
    ids are kept as they are: one result row per input row. Texts of any length are read whole. When
    one fold has no text its counts are all 0 and the other fold's bytes cost 8 bits. Other columns are
    ignored.

    The documents are shuffled once into blocks of about ``BLOCK_BYTES``, a longer text being a block by itself, and
    each block gets the prices of its own distinct grams. Nothing that grows with the table is broadcast.
    """
    spark = docs.sparkSession
    grams, gram_path = write_shared(gram_counts(docs, text, depth), "ctw-grams")
    table, _ = write_shared(prices(grams, depth), "ctw-prices")
    size = grams.agg(F.sum(F.col("n0") + F.col("n1")).alias("bytes")).first()
    drop_shared(spark, gram_path)
    t = F.col(f"`{text}`")
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), t.alias("t"))
    base = base.select("doc_id", F.when(F.col("t").isNotNull(), _fold("t")).otherwise(0).alias("fold"), "t")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema, out = arrow_schema(f"doc_id {id_type}, n_bytes bigint, bits double")

    def scored(ids: pa.Array, fold: pa.Array, texts: pa.Array, keys: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        lengths = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        cost = _cost(texts, fold.to_numpy(zero_copy_only=False).astype(np.int64), keys, bits, depth)
        return pa.RecordBatch.from_arrays([ids, lengths, pa.array(cost)], schema=out)

    total = _by_blocks(base, table, max(1, -(-(size["bytes"] or 0) // BLOCK_BYTES)), depth, scored, schema, out)
    return total.select(
        "doc_id", "n_bytes", F.round("bits", 3).alias("bits"), F.when(F.col("n_bytes") > 0, F.round(F.col("bits") / F.col("n_bytes"), 6)).alias("bits_per_byte")
    )


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(grams ascending, bits of either fold) of a price table."""
    table = table.sort_by("gram")
    return table.column("gram").to_numpy().astype(np.uint64), np.stack([table.column(c).to_numpy() for c in ("bits0", "bits1")])


def _cost(texts: pa.Array, fold: np.ndarray, keys: np.ndarray, bits: np.ndarray, depth: int) -> np.ndarray:
    """Bits of every text, by the prices of its fold."""
    total, low = np.zeros(len(texts)), np.uint64((1 << 24) - 1)
    for start, count, grams, doc in _pieces(texts, depth):
        if not len(grams) or not len(keys):
            continue
        both = np.sort(grams << np.uint64(24) | doc)
        begin = runs(both)
        times = np.diff(np.append(begin, len(both)))
        gram, at = both[begin] >> np.uint64(24), (both[begin] & low).astype(np.int64)
        where = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        price = np.where(keys[where] == gram, bits[fold[start + at], where], 0.0)
        total[start : start + count] += np.bincount(at, weights=price * times, minlength=count)
    return total


def _by_blocks(base: DataFrame, table: DataFrame, blocks: int, depth: int, scored, schema, out: pa.Schema) -> DataFrame:
    """The documents in hashed blocks, beside the prices of each block's distinct grams."""
    blocked = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "t"), F.lit(blocks)))
    need_schema, need_out = arrow_schema("block bigint, gram bigint")

    def whole(column: pa.ChunkedArray) -> pa.Array:
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)

    def distinct(part: pa.Table) -> pa.Table:
        kept, held = [np.zeros(0, np.uint64)], 0
        for _, _, grams, _ in _pieces(whole(part.column("t")), depth):
            kept.append(np.unique(grams))
            held += len(kept[-1])
            if held > BUFFER:
                kept, held = [np.unique(np.concatenate(kept))], 0
        found = np.unique(np.concatenate(kept))
        key = part.column("block")[0].as_py()
        return pa.Table.from_arrays([pa.array(np.full(len(found), key)), pa.array(found.astype(np.int64))], schema=need_out)

    need = blocked.groupBy("block").applyInArrow(distinct, need_schema).join(table.hint("merge"), "gram")

    def score(part: pa.Table, priced: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.Table.from_batches([], schema=out)
        keys, bits = _arrays(priced)
        parts = part.select(["doc_id", "fold", "t"]).to_batches()
        return pa.Table.from_batches([scored(*b.columns, keys, bits) for b in parts if b.num_rows], schema=out)

    return blocked.groupBy("block").cogroup(need.groupBy("block")).applyInArrow(score, schema)
