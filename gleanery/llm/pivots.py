"""Embedding near-duplicates through a pivot-permutation index.

Equal vectors are one class from the start. A class is described by its ``prefix`` nearest pivots in order,
pivots being vectors of the table picked by a hash, none of them near another. The more pivots, the less
stable the nearest ones are; beyond ``DENSE`` pivots the prefix grows by one with each doubling. The inverted
file lists, for each pivot, the vectors that have it in their description. Two vectors are candidates when they
share ``shared`` pivots at least, or one fewer with the same one nearest to both, and a link when the cosine of
the vectors themselves then reaches ``threshold``.

Only the rarest ``prefix - shared + 2`` pivots of a description are listed: two descriptions that share
``shared - 1`` pivots must have one of these in common, so the shorter lists lose nothing. A link is counted by
the rarest pivot that both list. A list gives how many links each of its vectors has, and a spanning forest of
them, so what it emits grows with its length; a long one is cut into tiles, each pair of tiles a group of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_schema, components, mix64, runs
from gleanery.llm.topk import blocks, number_kind, sound, unit, usable
from gleanery.scratch import drop_shared, write_shared

THRESHOLD = 0.95
PREFIX = 8
SHARED = 4
DENSE = 600
#: pivots: this many times the square root of the number of vectors
DENSITY = 6.0
#: pivots at least and at most; beyond the latter lists grow with the table
PIVOTS = (64, 200_000)
PLACES = 6
#: longest list, or part of one, that a group compares
TILE = 16384
_SLICE = 1024
#: pivots are folded into so many columns to bound the shared ones from above before they are counted
_FOLD = 512


def _grown(prefix: int, pivots: int) -> int:
    """Pivots in a description where there are ``pivots`` in all."""
    return prefix + math.ceil(max(0.0, math.log2(max(1, pivots) / DENSE)))


def _described(laid: DataFrame, kind: str, pivots: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """``(id, dim, v BINARY, near ARRAY<INT>)``: every vector with its nearest pivots, nearest first."""
    shared = laid.sparkSession.sparkContext.broadcast(pivots)
    schema, out = arrow_schema("id bigint, dim int, v binary, near array<int>")

    def describe(batches):
        p = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(1)[row].as_py()
                ids = batch.column(2)[row].values.to_numpy()
                raw = batch.column(3)[row].as_buffer()
                mine = p.get(dim)
                width = np.dtype(kind).itemsize * dim
                for at in range(0, len(ids), _SLICE):
                    part = raw[at * width : min(len(ids), at + _SLICE) * width]
                    x = unit(part, dim, kind).astype(np.float32)
                    score = x @ mine.T
                    k = min(_grown(prefix, score.shape[1]), score.shape[1])
                    top = np.argpartition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k :]
                    order = np.lexsort((top, -np.take_along_axis(score, top, 1)))
                    top = np.take_along_axis(top, order, 1).astype(np.int32)
                    n = len(top)
                    near = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(top.ravel()))
                    v = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, part]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + n]), pa.array(np.full(n, dim, np.int32)), v, near], schema=out)

    return laid.mapInArrow(describe, schema)


def _pick(laid: DataFrame, kind: str, density: float, most: float) -> dict[int, np.ndarray]:
    """Pivots of every dimension, unit length: its distinct vectors of the least hashes.

    Each block gives the vectors whose hash is below the share that is wanted of their dimension, and
    the least ``PIVOTS[0]`` of its own besides: a dimension of a few vectors or of many copies has pivots too.
    Of two with a cosine of ``most`` the one of the lesser hash stays.
    """
    schema, out = arrow_schema("dim int, h bigint, v binary")
    counts = dict(laid.groupBy("dim").agg(F.sum(F.size("ids"))).collect())
    wanted = {dim: min(PIVOTS[1], max(PIVOTS[0], density * math.sqrt(n))) for dim, n in counts.items()}

    def some(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(1)[row].as_py()
                data = batch.column(3)[row].as_buffer()
                width = np.dtype(kind).itemsize * dim
                raw = np.frombuffer(data, np.uint8).reshape(-1, width)
                # twice the share: equal vectors have equal hashes and count once
                h, first = np.unique(_hash(raw), return_index=True)
                keep = h < min(1.0, 2 * wanted[dim] / counts[dim]) * 2.0**63
                keep[: PIVOTS[0]] = True
                rows = [r.tobytes() for r in raw[first[keep]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), pa.array(h[keep].astype(np.int64)), pa.array(rows, pa.binary())], schema=out)

    got = laid.mapInArrow(some, schema).groupBy("dim", "v").agg(F.min("h").alias("h"))
    got = got.withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy("h", "v")))
    limit = F.element_at(F.create_map(*[F.lit(x) for dim, n in wanted.items() for x in (dim, int(n))]), F.col("dim"))
    got = got.where(F.col("nth") <= limit).toArrow()
    pivots = {}
    for dim in set(got.column("dim").to_pylist()):
        rows = got.filter(pc.equal(got.column("dim"), dim)).sort_by([("h", "ascending"), ("v", "ascending")])
        pivots[dim] = _apart(unit(b"".join(rows.column("v").to_pylist()), dim, kind).astype(np.float32), most)
    return pivots


def _apart(x: np.ndarray, most: float) -> np.ndarray:
    """The rows that have no cosine of ``most`` with an earlier row kept: many copies of one text make one pivot, not many."""
    kept = x[:0]
    for at in range(0, len(x), _SLICE):
        part = x[at : at + _SLICE]
        part = part[~(part @ kept.T >= most).any(axis=1)] if len(kept) else part
        near = np.triu(part @ part.T >= most, 1)
        stays = np.ones(len(part), bool)
        for i in np.flatnonzero(near.any(axis=1)):
            if stays[i]:
                stays[near[i]] = False
        kept = np.concatenate((kept, part[stays]))
    return kept


def _hash(raw: np.ndarray) -> np.ndarray:
    """63-bit hash of every row of bytes."""
    pad = -raw.shape[1] % 8
    words = np.ascontiguousarray(np.pad(raw, ((0, 0), (0, pad)))).view(np.uint64)
    h = np.full(len(raw), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        h = mix64(h ^ words[:, i])
    return h >> np.uint64(1)


def _counted(ids: np.ndarray, ranked: np.ndarray, first: np.ndarray, side: np.ndarray, x: np.ndarray, pivot: int, lists: int, need: int, threshold: float):
    """(ids, links counted here of each; ends of a spanning forest of these links) of one list or pair of tiles.

    ``side`` is 0 throughout for a tile with itself, else 0 or 1, and only pairs of different sides are compared.
    """
    n = len(ids)
    _, local = np.unique(ranked, return_inverse=True)
    hot = np.zeros((n, min(_FOLD, int(local.max()) + 1)), np.float32)
    local = local.reshape(ranked.shape) % hot.shape[1]
    for i in range(ranked.shape[1]):
        hot[np.arange(n), local[:, i]] += 1
    both = bool(side.any())
    order = np.argsort(side, kind="stable")
    split = int((side == 0).sum()) if both else n
    ids, ranked, first, x, hot = ids[order], ranked[order], first[order], x[order], hot[order]
    links, root, a, b = np.zeros(n, np.int64), np.arange(n), [], []
    width = max(1, min(256, (1 << 22) // max(1, n)))
    for at in range(0, split, width):
        stop = min(split, at + width)
        right = split if both else at
        i, j = np.nonzero(hot[at:stop] @ hot[right:].T >= need - 1)
        i, j = i + at, j + right
        keep = j > i
        i, j = i[keep], j[keep]
        found = []
        for cut in range(0, len(i), 1 << 16):
            p, q = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
            shared = sum((ranked[p, k, None] == ranked[q]).any(axis=1).astype(np.int8) for k in range(ranked.shape[1]))
            ok = (shared >= need) | (shared == need - 1) & (shared > 0) & (first[p] == first[q])
            p, q = p[ok], q[ok]
            # the rarest pivot that both list decides which list counts the link
            listed = np.stack([(ranked[p, k, None] == ranked[q, :lists]).any(axis=1) for k in range(lists)], axis=1)
            mine = listed.any(axis=1) & (ranked[p, np.argmax(listed, axis=1)] == pivot)
            p, q = p[mine], q[mine]
            good = np.round(np.einsum("ij,ij->i", x[p], x[q]), PLACES) >= threshold
            found.append((p[good], q[good]))
        p, q = (np.concatenate(z) for z in zip(*found)) if found else (i, j)
        links += np.bincount(p, minlength=n) + np.bincount(q, minlength=n)
        begins = runs(p)
        for one, others in zip(p[begins].tolist(), np.split(q, begins[1:]) if len(begins) else []):
            roots, where = np.unique(root[others], return_index=True)
            new = roots != root[one]
            if new.any():
                a.append(np.full(new.sum(), ids[one]))
                b.append(ids[others[where[new]]])
                root[np.isin(root, roots[new])] = root[one]
    none = np.zeros(0, np.int64)
    return ids, links, np.concatenate(a) if a else none, np.concatenate(b) if b else none


def _links(laid: DataFrame, kind: str, threshold: float, prefix: int, shared: int, density: float, tile: int) -> tuple[DataFrame, list[str]]:
    """``(a, b, n)``: rows without ``b`` add ``n`` links to node ``a``, the others are links of a spanning forest."""
    spark = laid.sparkSession
    pivots = _pick(laid, kind, density, threshold)
    prefixes = {dim: _grown(prefix, len(p)) for dim, p in pivots.items()}
    rows, rows_path = write_shared(_described(laid, kind, pivots, prefix), "pivot-descriptions")
    listed = rows.select("dim", F.explode("near").alias("pivot")).groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"))
    sizes: dict[int, list] = {}
    for dim, pivot, n in zip(*listed.toArrow().to_pydict().values()):
        sizes.setdefault(dim, []).append((n, pivot))
    rarity = {d: np.array([p for _, p in sorted(r)], np.int64) for d, r in sizes.items()}
    # for every pivot, by its place in the order of rarity: into how many tiles its list is cut
    cuts = {d: np.array([-(-n // tile) for n, _ in sorted(r)], np.int64) for d, r in sizes.items()}
    known = spark.sparkContext.broadcast(({d: _inverse(order) for d, order in rarity.items()}, cuts))
    schema, out = arrow_schema("pivot int, dim int, tiles bigint, id bigint, v binary, first int, side int, ranked array<int>")

    def post(batches):
        ranks, cuts = known.value
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                near = part.column(3)
                width = len(near[0])
                by_place = ranks[dim][near.flatten().to_numpy().reshape(-1, width)].astype(np.int32)
                ranked = np.sort(by_place, axis=1)
                lists = _listed(width, prefixes[dim], shared)
                rest = np.repeat(np.arange(len(ranked)), lists)
                pivot = ranked[:, :lists].ravel()
                # a row of tile t of k meets every tile once: k rows for a list of k tiles
                k = cuts[dim][pivot]
                which = np.repeat(np.arange(len(pivot)), k)
                other = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
                rest, pivot, k = rest[which], pivot[which], k[which]
                own = (mix64(part.column(0).to_numpy().astype(np.uint64) + np.uint64(1))[rest] % k.astype(np.uint64)).astype(np.int64)
                tiles = np.minimum(own, other) << 32 | np.maximum(own, other)
                side = (own > other).astype(np.int32)
                step = 1 << 14
                for at in range(0, len(rest), step):
                    some = slice(at, at + step)
                    full = ranked[rest[some]]
                    grams = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * width), pa.array(full.ravel()))
                    ids, dim_col, v = (part.column(i).take(pa.array(rest[some])) for i in (0, 1, 2))
                    cols = [pa.array(pivot[some]), dim_col, pa.array(tiles[some]), ids, v, pa.array(by_place[rest[some], 0]), pa.array(side[some]), grams]
                    yield pa.RecordBatch.from_arrays(cols, schema=out)

    schema2, out2 = arrow_schema("a bigint, b bigint, n bigint")

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pivot, dim = table.column("pivot")[0].as_py(), table.column("dim")[0].as_py()
        ids, first, side = (table.column(c).to_numpy() for c in ("id", "first", "side"))
        ranked = table.column("ranked").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        need = shared if ranked.shape[1] == prefixes[dim] else 1
        x = unit(b"".join(table.column("v").to_pylist()), dim, kind)
        ids, links, a, b = _counted(ids, ranked, first, side, x, pivot, _listed(ranked.shape[1], prefixes[dim], shared), need, threshold)
        some = links > 0
        cols = [np.concatenate((ids[some], a)), pa.array(np.concatenate((np.zeros(some.sum(), np.int64), b)), mask=np.arange(some.sum() + len(a)) < some.sum()), np.concatenate((links[some], np.zeros(len(a), np.int64)))]
        return pa.Table.from_arrays([pa.array(c) for c in cols], schema=out2)

    found, path = write_shared(rows.mapInArrow(post, schema).groupBy("dim", "pivot", "tiles").applyInArrow(verify, schema2), "pivot-links")
    drop_shared(spark, rows_path)
    return found, [path]


def _listed(width: int, prefix: int, shared: int) -> int:
    """How many pivots of a description of ``width`` are listed: all where there are fewer than asked for."""
    return max(1, min(width, prefix - shared + 2)) if width == prefix else width


def near_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, prefix: int = PREFIX,
    shared: int = SHARED, density: float = DENSITY, block: int = 4096, tile: int = TILE,
) -> DataFrame:
    """Every row of ``vectors`` as ``(vec_id, class_id, n_copies, n_links)``.

    ``n_copies`` counts the other rows of the same vector, ``n_links`` the other different vectors that were found
    with a cosine, rounded to 6 places, of ``threshold`` at least. Rows of the same or of linked vectors, directly or
    over others, are a class, named by its least id. All vectors are searched against all of their dimension.
    A row with a null id, or whose vector has no direction (null, empty, zero, with nulls or numbers that aren't
    finite), is a class of its own, with its id, no copies and no links. Rows with one id are separate rows. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = number_kind(vectors, vector)
    rows = usable(vectors, id_col, vector).select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("v"))
    classes, class_path = write_shared(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "vector-classes")
    none = F.lit(0).cast("bigint")
    own = F.col(f"`{id_col}`").cast("bigint")
    bare = vectors.where(~sound(vectors, id_col, vector))
    bare = bare.select(own.alias("vec_id"), own.alias("class_id"), none.alias("n_copies"), none.alias("n_links"))
    if classes.isEmpty():
        return bare
    laid, laid_path = write_shared(blocks(classes, "node", "v", block), "pivot-blocks")
    found, paths = _links(laid, kind, threshold, prefix, shared, density, tile)
    drop_shared(spark, laid_path)
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n_links"))
    linked = components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("node", "h1", "h2", "least", "rows").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(heads, "root").join(counts, F.col("node") == F.col("a"), "left")
    named, _ = write_shared(named.select("h1", "h2", "class_id", (F.col("rows") - 1).alias("n_copies"), F.coalesce("n_links", none).alias("n_links")), "vector-groups")
    for path in (class_path, *paths):
        drop_shared(spark, path)
    return rows.select("id", "h1", "h2").join(named, ["h1", "h2"]).select(F.col("id").alias("vec_id"), "class_id", "n_copies", "n_links").unionByName(bare)


def _inverse(order: np.ndarray) -> np.ndarray:
    rank = np.zeros(int(order.max()) + 1, np.int32)
    rank[order] = np.arange(len(order))
    return rank
