"""SimHash near-duplicates by covering locality-sensitive hashing, and by bands of min-hashes.

Two 64-bit SimHashes are made of every text: one of its words, each weighted by how far its length
exceeds two characters (short words are the common ones), and one of its word pairs. Two documents
are near-duplicates when the first differ in at most ``radius`` bits and the second in at most
``confirm`` bits.

Candidates come from covering LSH: bit *i* gets a vector m(i) of ``radius + 1`` bits, and table *v*
(every non-zero vector of as many bits) keeps exactly the bits with odd <m(i), v>. The at most
``radius`` differing bits span at most ``radius`` dimensions, so some *v* is orthogonal to all of
them: each pair within the radius agrees in one of the ``2**(radius+1) - 1`` tables, with certainty.
Tables 2k and 2k + 1 have a quarter of the bits in common; rows are shuffled by these, so one row serves both.

64 bits are too few for copies that share 70-90 % of their word pairs. Two documents are near-duplicates
as well when the min-hashes of their sets of word pairs say so: ``BANDS`` bands of ``ROWS`` min-hashes give the
candidates (at a Jaccard index of 0.7, 99.6 % share a band), and one bit of each of ``SKETCH`` min-hashes confirms
them, ``AGREE`` of which must agree. A share of (1 + J) / 2 does, so that J of 0.625 is where half are taken.

Within a bucket every pair is compared, but only a spanning forest of the matches is emitted, since
groups are connected components: a bucket of k copies yields k - 1 edges, not k * k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_schema, components, flat, free_name, mix64, runs, slices, tidied
from gleanery.scratch import drop_shared, write_shared

RADIUS = 6
CONFIRM = 18
MIN_WORDS = 8
CAP = 4
BANDS = 20
ROWS = 4
SKETCH = 256
AGREE = 208
#: word pairs hashed at a time
_PAIRS = 1 << 16
_FACTORS = np.random.default_rng(20240301).integers(0, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)

_M = 0x9E3779B97F4A7C15 | 1
_INV = pow(_M, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: 8 bits spread over the 8 byte lanes of a word, lane b holding bit b
_SPREAD = np.array([sum(((x >> b) & 1) << (8 * b) for b in range(8)) for x in range(256)], np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][:n]


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, length in characters, document index) of every word of lower-cased texts.

    A word is a run of ASCII letters and digits and of any non-ASCII characters.
    """
    data, offsets = flat(pc.utf8_lower(col))
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = inside[cuts]
    ends = cuts[cuts > 0] - 1
    last[ends] = inside[ends]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_M, n))))
    h = mix64((total[stop] - total[start]) * _powers(_INV, n)[start])
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return h, chars[stop] - chars[start], np.searchsorted(offsets, start, "right") - 1


def _words_in_cuts(one: pa.Array, size: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words`` of a single text, a long one in cuts of about ``size`` bytes between words."""
    data, _ = flat(one)
    if len(data) <= size:
        return words(one)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    gaps = np.flatnonzero(~_WORD[lower])
    at, found = 0, []
    while at < len(data):
        cut = np.searchsorted(gaps, at + size)
        stop = int(gaps[cut]) if cut < len(gaps) else len(data)
        found.append(words(pa.array([data[at:stop].tobytes().decode()]))[:2])
        at = stop
    h, length = (np.concatenate(x) for x in zip(*found))
    return h, length, np.zeros(len(h), np.int64)


def simhash(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Bitwise weighted majority of the hashes of each document; ``doc`` ascends. Ties give 0 bits."""
    out = np.zeros(docs, np.uint64)
    w = weight.astype(np.int64)
    keep = w > 0
    h, w, doc = h[keep], w[keep], doc[keep]
    if not len(h):
        return out
    # lanes are bytes, so runs are cut where their weight could pass 255
    w = np.minimum(w, 15)
    pos = np.arange(len(doc))
    begins = runs(doc)
    rank = pos - np.repeat(begins, np.diff(np.append(begins, len(doc))))
    block = runs(doc * np.int64(1 << 32) + rank // 17)
    owner = doc[block]
    totals = np.add.reduceat(w, block)
    outer = runs(owner)
    half = np.add.reduceat(totals, outer)
    for byte in range(8):
        lanes = _SPREAD[(h >> np.uint64(8 * byte)).astype(np.uint8)] * w.astype(np.uint64)
        part = np.add.reduceat(lanes, block).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(part, outer, axis=0)
        bits = np.packbits(2 * ones > half[:, None], axis=1, bitorder="little")[:, 0]
        out[owner[outer]] |= bits.astype(np.uint64) << np.uint64(8 * byte)
    return out


def min_hashes(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """The least of each of ``SKETCH`` hashes of the documents' values, (docs, SKETCH); ``doc`` ascends."""
    out = np.full((SKETCH, docs), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), _PAIRS):
        part, owner = h[at : at + _PAIRS], doc[at : at + _PAIRS]
        begins = runs(owner)
        owner = owner[begins]
        for i, factor in enumerate(_FACTORS):
            out[i, owner] = np.minimum(out[i, owner], np.minimum.reduceat(part * factor, begins))
    return out.T


def sketches(least: np.ndarray) -> np.ndarray:
    """Band keys and, after them, the sketch's words of every row of ``min_hashes``."""
    value = mix64(least ^ _FACTORS)
    keys = np.zeros((len(least), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix64(keys * np.uint64(0x9FB21C651E98DF25) ^ value[:, i : BANDS * ROWS : ROWS])
    bits = np.packbits((value & np.uint64(1)).astype(bool), axis=1, bitorder="little")
    return np.concatenate((keys, np.ascontiguousarray(bits).view(np.uint64)), axis=1)


def signatures(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word SimHash, word-pair SimHash, word count) of every text of the array."""
    return described(col)[:3]


def described(col: pa.Array, sketched: bool = False) -> tuple[np.ndarray, ...]:
    """``signatures`` and, if ``sketched``, the ``sketches`` of the texts' word pairs."""
    n = len(col)
    marks = np.zeros((n if sketched else 0, BANDS + SKETCH // 64), np.uint64)
    h1, h2, count = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for start, size in slices(col):
        h, length, doc = words(col.slice(start, size)) if size > 1 else _words_in_cuts(col.slice(start, 1))
        num = np.bincount(doc, minlength=size)
        weight = np.clip(length - 2, 0, CAP)
        # a document of short words only is described by all of them
        rich = np.bincount(doc, weights=weight, minlength=size) > 0
        weight = np.where(rich[doc], weight, 1)
        h1[start : start + size] = simhash(h, weight, doc, size)
        if len(h):
            same = np.concatenate((doc[1:] == doc[:-1], [False]))
            pair = mix64(h * np.uint64(0x9FB21C651E98DF25) ^ np.roll(h, -1))
            single = num[doc] == 1
            pair = np.where(single, h, pair)
            h2[start : start + size] = simhash(pair, (same | single).astype(np.int64), doc, size)
            if sketched:
                marks[start : start + size] = sketches(min_hashes(pair[same | single], doc[same | single], size))
        count[start : start + size] = num
    return h1, h2, count, marks


def masks(radius: int) -> np.ndarray:
    """The covering's ``2**(radius+1) - 1`` bit masks of 64 bits."""
    width = radius + 1
    rng = np.random.default_rng(20240229)
    rounds = -(-64 // ((1 << width) - 1))
    m = np.concatenate([rng.permutation(np.arange(1, 1 << width)) for _ in range(rounds)])[:64]
    odd = np.array([[bin(int(v) & int(x)).count("1") & 1 for x in m] for v in range(1, 1 << width)], np.uint64)
    return (odd << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def node_of(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """One number for a pair of signatures, the vertex of the near-duplicate graph."""
    return mix64(h1 ^ mix64(h2 + np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _near(a1, a2, b1, b2, short, radius: int, confirm: int) -> np.ndarray:
    d1 = np.bitwise_count(a1 ^ b1)
    d2 = np.bitwise_count(a2 ^ b2)
    return np.where(short, (d1 == 0) & (d2 == 0), (d1 <= radius) & (d2 <= confirm))


def _alike(a, b) -> np.ndarray:
    """Whether sketches, words first, agree in ``AGREE`` bits."""
    return sum(np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(a, b)) <= SKETCH - AGREE


def _forest(left: np.ndarray, near) -> list[tuple[int, np.ndarray]]:
    """(seed, members) of the components of one bucket, whose positions are ``left``."""
    found = []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        frontier, members = np.array([seed]), []
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, (1 << 20) // len(left))
            for i in range(0, len(frontier), step):
                ask = left[~hit]
                if not len(ask):
                    break
                hit[np.flatnonzero(~hit)[near(frontier[i : i + step, None], ask).any(axis=0)]] = True
            frontier, left = left[hit], left[~hit]
            members.append(frontier)
        if members and sum(map(len, members)):
            found.append((seed, np.concatenate(members)))
    return found


def bucket_edges(key, node, near) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges of the pairs that share a key and of which ``near(positions, positions)`` holds; keys needn't be sorted."""
    order = np.argsort(key, kind="stable")
    begin = runs(key[order])
    size = np.diff(np.append(begin, len(order)))
    two = begin[size == 2]
    i, j = order[two], order[two + 1]
    ok = near(i, j)
    a, b = [node[i[ok]]], [node[j[ok]]]
    for s, n in zip(begin[size > 2], size[size > 2]):
        for seed, members in _forest(order[s : s + n], near):
            a.append(np.full(len(members), node[seed]))
            b.append(node[members])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.minimum(a, b), np.maximum(a, b)
    keep = np.lexsort((b, a))
    a, b = a[keep], b[keep]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def sign(docs: DataFrame, text: str, keep: list) -> DataFrame:
    """Columns ``keep`` beside ``h1 h2 words node marks`` of each row; a null text has no words."""
    df = docs.select(*keep, F.col(f"`{text}`").alias("_text"))
    schema, out = arrow_schema(
        df.drop("_text").schema.simpleString()[7:-1] + ",h1:bigint,h2:bigint,words:bigint,node:bigint,marks:binary"
    )

    def run(batches):
        for batch in batches:
            h1, h2, n, marks = described(batch.column(batch.num_columns - 1), True)
            extra = [pa.array(x.view(np.int64)) for x in (h1, h2, n, node_of(h1, h2))]
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(marks.shape[1] * 8), len(n), [None, pa.py_buffer(marks)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra, raw.cast(pa.binary())], schema=out)

    return df.mapInArrow(tidied(run), schema)


def near_edges(signed: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM, min_words: int = MIN_WORDS) -> DataFrame:
    """Edges ``(a, b)`` between ``node`` values whose signatures or sketches match, a spanning forest of each bucket."""
    distinct = signed.where("words > 0").groupBy("node").agg(F.min("h1").alias("h1"), F.min("h2").alias("h2"), (F.min("words") < min_words).alias("few"))
    covering = masks(radius)
    # tables 1 and 1, 2 and 3, 4 and 5, ..: the bits that either keeps
    left, right = covering[[0, *range(1, len(covering), 2)]], covering[[0, *range(2, len(covering), 2)]]
    common = F.array(*[F.lit(int(m)) for m in (left & right).view(np.int64)])
    # one number for the tables and the flag: a shuffled row is three numbers
    rows = distinct.select(
        F.explode(F.sequence(F.lit(0), F.lit(len(left) - 1))).alias("t"), "few", "h1", "h2"
    ).select((F.col("t") * 2 + F.col("few").cast("int")).alias("tf"), "h1", "h2")
    table = F.shiftright("tf", 1)
    rows = rows.repartition(table, F.col("h1").bitwiseAND(F.element_at(common, table + 1)))
    schema, out = arrow_schema("a bigint, b bigint")

    def match(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        tf = t.column(0).to_numpy()
        h1, h2 = (t.column(i).to_numpy().view(np.uint64) for i in (1, 2))
        few, of, nodes = (tf & 1).astype(bool), tf >> 1, node_of(h1, h2)
        near = lambda i, j: _near(h1[i], h2[i], h1[j], h2[j], few[i] | few[j], radius, confirm)
        for kept in (left, right):
            key = mix64((h1 & kept[of]) ^ mix64(of.astype(np.uint64) + np.uint64(1)))
            yield from _edge_batches(*bucket_edges(key, nodes, near), out)

    return rows.mapInArrow(tidied(match), schema).unionByName(sketch_edges(signed, min_words))


def _edge_batches(a: np.ndarray, b: np.ndarray, out: pa.Schema):
    for i in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (a, b)], schema=out)


def sketch_edges(signed: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Edges ``(a, b)`` between ``node`` values of ``min_words`` words and more that share a band and whose sketches agree."""
    distinct = signed.where(F.col("words") >= max(1, min_words)).groupBy("node").agg(F.min("marks").alias("marks"))
    words = [f"s{i}" for i in range(SKETCH // 64)]
    schema, out = arrow_schema("key bigint, node bigint, " + ", ".join(f"{w} bigint" for w in words))

    def spread(batches):
        for batch in batches:
            n = batch.num_rows
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(n, BANDS + len(words))
            cols = [marks[:, :BANDS].ravel(), *(np.repeat(x, BANDS) for x in (batch.column(0).to_numpy(), *marks[:, BANDS:].T))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=out)

    schema2, out2 = arrow_schema("a bigint, b bigint")

    def match(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        key, node = (t.column(i).to_numpy() for i in (0, 1))
        sketch = [c.to_numpy().view(np.uint64) for c in t.columns[2:]]
        near = lambda i, j: _alike([x[i] for x in sketch], [x[j] for x in sketch])
        yield from _edge_batches(*bucket_edges(key, node, near), out2)

    return distinct.mapInArrow(tidied(spread), schema).repartition("key").mapInArrow(tidied(match), schema2)


#: bitmaps of 4 KB that are broadcast at a time
BITMAPS = 16384


def _placed(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows that can be told apart by (hash of the file's path, position in it); what isn't a Parquet scan is written first."""
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at.getField("row_index"))
    except (AnalysisException, AttributeError):
        docs, _ = write_shared(docs, "simhash-rows")
        at = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(at.getField("file_path")), at.getField("row_index")


def _linked(docs: DataFrame, id_col: str, text: str, radius: int, confirm: int, min_words: int, file: Column, pos: Column) -> tuple[DataFrame, str]:
    """``doc_id row file pos words root`` of every row, written in the shared folder; wordless rows have no root."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    keep = [F.col(f"`{id_col}`").alias("doc_id"), row.alias("row"), file.alias("file"), pos.alias("pos")]
    signed, path = write_shared(sign(docs, text, keep), "simhash")
    edges, edge_path = write_shared(near_edges(signed, radius, confirm, min_words), "simhash-edges")
    linked = components(edges)
    flagged = signed.join(linked, "node", "left").select(
        "doc_id", "row", "file", "pos", "words", F.when(F.col("words") > 0, F.coalesce("root", "node")).alias("root")
    )
    flagged, flagged_path = write_shared(flagged, "simhash-roots")
    for p in (path, edge_path):
        drop_shared(docs.sparkSession, p)
    return flagged, flagged_path


def groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, confirm: int = CONFIRM, min_words: int = MIN_WORDS
) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, group_id, group_size, kept)``.

    ``group_id`` is the least id in the row's group; ``kept`` marks one row of each group, the least
    by (id with nulls last, hash of the row, place). Rows without any word (null, empty, punctuation only)
    are each a group of their own and are kept, their ``group_id`` being their own id. Texts of fewer
    than ``min_words`` words match only those with equal signatures. ``radius`` and ``confirm`` are of the SimHashes;
    pairs of like min-hashes match besides. Repeated rows are one group. Texts are read whole.
    Other columns, whatever their names, only break ties. An empty table gives an empty result.
    """
    docs, file, pos = _placed(docs)
    flagged, _ = _linked(docs, id_col, text, radius, confirm, min_words, file, pos)
    real, bare = flagged.where("words > 0"), flagged.where("words = 0")
    head = real.groupBy("root").agg(F.min(_order()).alias("head"), F.count(F.lit(1)).alias("group_size"))
    is_head = (F.col("file") == F.col("head.file")) & (F.col("pos") == F.col("head.pos"))
    out = real.join(head, "root").select("doc_id", F.col("head.doc_id").alias("group_id"), "group_size", is_head.alias("kept"))
    alone = bare.select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def _order():
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "file", "pos")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, confirm: int = CONFIRM, min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with one row of every near-duplicate group (see ``groups`` for which), columns unchanged.

    Rows without any word (null, empty, punctuation only) all stay. Rows equal in every column count as copies.
    Columns of any name pass through; an empty table stays empty.

    The texts aren't shuffled. What goes is marked in bitmaps of 32,768 rows of a file each, and the files are read
    again beside the bitmaps of at most about ``BITMAPS`` of these at a time (64 MB), which are broadcast.
    """
    docs, file, pos = _placed(docs)
    flagged, path = _linked(docs, id_col, text, radius, confirm, min_words, file, pos)
    real = flagged.where("words > 0")
    head = real.groupBy("root").agg(F.min(_order()).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = real.join(head, "root").where("file <> head.file OR pos <> head.pos")
    place = F.col("pos") + 1
    marks = gone.groupBy("file", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    marks, _ = write_shared(marks, "simhash-marks")
    drop_shared(docs.sparkSession, path)
    parts = max(1, -(-marks.count() // BITMAPS))
    names = [free_name(docs, n) for n in ("_file", "_bucket", "_bits", "_at")]
    marks = marks.select(F.col("file").alias(names[0]), F.col("bucket").alias(names[1]), F.col("bits").alias(names[2]))
    own = [F.col(f"`{c}`") for c in docs.columns]
    placed = docs.select(*own, file.alias(names[0]), F.bitmap_bucket_number(pos + 1).alias(names[1]), F.bitmap_bit_position(pos + 1).alias(names[3]))
    byte = F.substring(F.col(names[2]), F.lit(1) + (F.col(names[3]) / 8).cast("int"), F.lit(1))
    marked = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr(f"shiftleft(1, cast(`{names[3]}` % 8 as int))")) > 0
    kept = []
    for part in range(parts):
        mine, theirs = placed, marks
        if parts > 1:
            mine, theirs = (x.where(F.pmod(F.col(names[0]), F.lit(parts)) == part) for x in (placed, marks))
        kept.append(mine.join(F.broadcast(theirs), names[:2], "left").where(F.coalesce(~marked, F.lit(True))).select(*own))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out
