"""Token shards in a static range asymmetric numeral system (rANS).

Texts become token ids by a public byte-level vocabulary (``tokens``), or an array column of ids is taken as it is.
All documents share one frequency table, counted over all of them and written once. Every document ends with an end
mark. Documents are laid one after the other and cut into blocks of ``BLOCK`` ids. In a block ``LANES`` coders are
interleaved, id *i* being lane *i mod LANES*'s, each with a 64-bit state that sheds 32-bit words. All lanes of all
blocks of a batch take their steps together, as one vector.

Every ``CHECKPOINT`` ids the block records the lanes' states and the place in its words, so segments decode
independently and in parallel; each segment has a CRC-32 of its ids and the block one of its words.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_schema, flat, slices, tidied
from gleanery.scratch import write_shared

BLOCK = 65536
LANES = 64
CHECKPOINT = 16384
BITS = 16
#: the mark after every document and the one for a null in an array: no ids, so none can clash with them
END = -(1 << 62)
NULL = END + 1
#: ranks of a byte-level vocabulary, and how it cuts texts into words
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|re|ve)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: smaller ids are looked up in a dense table
_DENSE = 1 << 20
#: ids coded as one vector of steps
GROUP = 1 << 22
#: bytes of text tokenized, and ids counted, at a time
_SLICE = 1 << 20
_LOW = np.uint64(1 << 32)
_WORD = np.uint64(32)


def frequencies(counts: dict[int, int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids ascending, frequencies summing to ``2**bits``, bits): every counted id gets 1 at least.

    ``bits`` grows where there are too many ids for it. A lone id shares with a second one, never used.
    """
    ids = np.array(sorted(counts), np.int64)
    n = np.array([counts[i] for i in ids.tolist()], float)
    if not len(ids):
        ids, n = np.array([0, 1]), np.array([1.0, 1.0])
    elif len(ids) == 1:
        ids, n = np.array([ids[0], ids[0] + 1]), np.array([n[0], 0.0])
    while len(ids) * 8 > 1 << bits:
        bits += 1
    total = 1 << bits
    f = np.maximum(1, np.floor(n / n.sum() * total)).astype(np.int64)
    # what is left over or missing goes to the most frequent ids
    order = np.lexsort((ids, -n))
    while f.sum() != total:
        gap = total - f.sum()
        if gap > 0:
            f[order[0]] += gap
        else:
            give = np.minimum(f[order] - 1, (f[order] * 0.01).astype(np.int64) + 1)
            give = np.minimum(give, np.maximum(0, -gap - np.concatenate(([0], np.cumsum(give)[:-1]))))
            f[order] -= give
    return ids, f.astype(np.uint64), bits


def encode(symbols: np.ndarray, freq: np.ndarray, bits: int, lanes: int = LANES, every: int = CHECKPOINT):
    """Blocks of equal length, ``symbols`` of shape (blocks, ids) with ids a multiple of ``lanes``, as
    a list of (states, words, checkpoint states, checkpoint places); the first checkpoint is the start."""
    blocks, n = symbols.shape
    steps = n // lanes
    s = symbols.reshape(blocks, steps, lanes).transpose(1, 0, 2).reshape(steps, blocks * lanes)
    cum = np.concatenate(([np.uint64(0)], np.cumsum(freq)[:-1])).astype(np.uint64)
    limit = freq << np.uint64(64 - bits)
    shift = np.uint64(bits)
    x = np.full(blocks * lanes, _LOW, np.uint64)
    words = np.zeros((steps, blocks * lanes), np.uint32)
    shed = np.zeros((steps, blocks * lanes), bool)
    marks = []
    stride = every // lanes
    for t in range(steps - 1, -1, -1):
        row = s[t]
        f = freq[row]
        full = x >= limit[row]
        words[t] = x.astype(np.uint32)
        shed[t] = full
        x = np.where(full, x >> _WORD, x)
        q = x // f
        x = (q << shift) + (x - q * f) + cum[row]
        if t % stride == 0:
            marks.append(x.copy())
    marks = np.array(marks[::-1]).reshape(-1, blocks, lanes)
    words, shed = words.reshape(steps, blocks, lanes), shed.reshape(steps, blocks, lanes)
    per_step = shed.sum(axis=2)
    places = np.concatenate((np.zeros((1, blocks), np.int64), np.cumsum(per_step, axis=0)))[0:steps:stride]
    return [(words[:, b][shed[:, b]], marks[:, b], places[:, b]) for b in range(blocks)]


def decode(words: np.ndarray, states: np.ndarray, n: int, freq: np.ndarray, bits: int) -> np.ndarray:
    """The ``n`` ids (as indexes into the table) of a segment from its words and states at its start."""
    cum = np.concatenate(([np.uint64(0)], np.cumsum(freq)[:-1])).astype(np.uint64)
    of_slot = np.repeat(np.arange(len(freq)), freq.astype(np.int64))
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    x, at, out = states.astype(np.uint64), 0, []
    for _ in range(-(-n // len(states))):
        slot = x & mask
        sym = of_slot[slot.astype(np.int64)]
        out.append(sym)
        x = freq[sym] * (x >> shift) + slot - cum[sym]
        need = np.flatnonzero(x < _LOW)
        x[need] = x[need] << _WORD | words[at : at + len(need)].astype(np.uint64)
        at += len(need)
    return np.concatenate(out)[:n] if out else np.zeros(0, np.int64)


def _ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids with an end mark after every row, start of every row). Null rows are empty."""
    if pa.types.is_list(col.type):
        size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data = pc.fill_null(col.flatten().cast(pa.int64()), NULL).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(size)))
    else:
        data, offsets = flat(col)
    rows = len(offsets) - 1
    out = np.empty(len(data) + rows, np.int64)
    inside = np.ones(len(out), bool)
    inside[offsets[1:] + np.arange(rows)] = False
    out[inside], out[~inside] = data, END
    return out, offsets[:-1] + np.arange(rows)


_CODERS: dict[bytes, object] = {}


def _coder(ranks: bytes):
    """The tokenizer of a ranks file's bytes, made once in a worker."""
    import tiktoken

    if ranks not in _CODERS:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _CODERS[ranks] = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _CODERS[ranks]


def tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids ARRAY<INT>)`` of every row: its whole text's token ids, none for a null or empty text.

    ``vocabulary`` is a ranks file that the driver reads; its bytes, whose number doesn't depend on the table, go to
    the workers. The strings of special tokens are ordinary text. The ids' bytes put together are the text's. Null
    ids, repeated rows and ids are kept as they are; other columns are ignored.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    schema, out = arrow_schema(f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")

    def run(batches):
        coder = _coder(ranks.value)
        for batch in batches:
            for start, count in slices(batch.column(1), _SLICE):
                texts = batch.column(1).slice(start, count).to_pylist()
                ids = [np.asarray(coder.encode_ordinary(t), np.int32) if t else np.zeros(0, np.int32) for t in texts]
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, count), lists], schema=out)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(tidied(run, small=False), schema)


def token_shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``shards`` of the ``tokens`` of ``docs``, which are made once."""
    made, _ = write_shared(tokens(docs, id_col, text, vocabulary), "tokens")
    return shards(made, "doc_id", "ids")


def table(docs: DataFrame, text: str = "text", bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int] | None:
    """The shared frequency table of all rows, None if there are none: a few numbers for each id, whatever the table's size."""
    schema, out = arrow_schema("id bigint, n bigint")

    def count(batches):
        total, rare = np.zeros(_DENSE, np.int64), {}
        for batch in batches:
            for part in _runs(batch.column(0), _SLICE):
                ids, _ = _ids(part)
                low = (ids >= 0) & (ids < _DENSE)
                n = np.bincount(ids[low])
                total[: len(n)] += n
                for i, k in zip(*np.unique(ids[~low], return_counts=True)):
                    rare[int(i)] = rare.get(int(i), 0) + int(k)
        seen = np.flatnonzero(total)
        if len(seen) or rare:
            cols = [np.concatenate((seen, np.array(list(rare), np.int64))), np.concatenate((total[seen], np.array(list(rare.values()), np.int64)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=out)

    got = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(tidied(count, small=False), schema).groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return frequencies(dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())), bits) if got.num_rows else None


BLOCK_COLUMNS = (
    "stream bigint, block int, n_ids int, doc_ids array<{id}>, doc_starts array<int>, words binary, word_crc bigint, "
    "states binary, places array<int>, id_crcs array<bigint>, table_crc bigint"
)


def _packed(ids: np.ndarray, freq: np.ndarray, bits: int) -> bytes:
    return np.uint32(bits).tobytes() + np.uint32(len(ids)).tobytes() + ids.astype(np.int64).tobytes() + freq.astype(np.uint32).tobytes()


def read_table(row) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, frequencies, bits) of the table row of a shard set, checked."""
    raw = row["words"]
    if zlib.crc32(raw) != row["table_crc"]:
        raise ValueError("the table fails its checksum")
    bits, n = np.frombuffer(raw, np.uint32, 2).tolist()
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.uint64), bits


def shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS, group: int = GROUP) -> DataFrame:
    """All rows of ``docs`` as coded blocks, one row a block, and one row (stream and block -1) with the table.

    A stream is a run of rows that lie together; its blocks in order hold their ids. ``doc_ids`` are the
    documents that start in the block and ``doc_starts`` where; one that runs on fills the next blocks
    from 0. ``words`` is the code, ``states`` (a state of 8 bytes for each lane) and ``places`` (into the
    words) say where each segment of ``CHECKPOINT`` ids begins, ``id_crcs`` check its ids (as 64-bit
    numbers), ``word_crc`` the words. The table row's ``words`` are the shared table (``read_table``); every block
    names it by ``table_crc``.
    ``text`` may be a string column, whose UTF-8 bytes are the ids, or an array of integers, negative ones included;
    nulls in an array are coded as ``NULL``. Null texts are empty documents, and an empty document is its end mark
    ``END`` alone. Repeated rows and null ids are kept in place. Other columns are ignored; an empty table gives no rows.
    """
    schema, out = arrow_schema(BLOCK_COLUMNS.format(id=docs.schema[id_col].dataType.simpleString()))
    spark = docs.sparkSession
    made = table(docs, text, bits)
    if made is None:
        return spark.createDataFrame([], schema)
    ids, freq, bits = made
    packed = _packed(ids, freq, bits)
    crc = zlib.crc32(packed)
    low = (ids >= 0) & (ids < _DENSE)
    lookup = np.full(int(ids[low].max()) + 1 if low.any() else 1, -1, np.int32)
    lookup[ids[low]] = np.flatnonzero(low)
    shared = spark.sparkContext.broadcast((ids, freq, lookup))

    def run(batches):
        from pyspark import TaskContext

        ids, freq, lookup = shared.value
        stream = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for part in _runs(batch.column(1), group):
                count = len(part)
                found, starts = _ids(part)
                low = (found >= 0) & (found < len(lookup))
                sym = lookup[np.where(low, found, 0)]
                sym[~low] = np.searchsorted(ids, found[~low])
                yield from _rows(found, sym, starts, batch.column(0).slice(at, count), stream, freq, bits, crc, out)
                stream += 1
                at += count

    blocks = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(tidied(run, small=False), schema)
    head = [(-1, -1, len(ids), [], [], bytearray(packed), crc, bytearray(), [], [], crc)]
    return spark.createDataFrame(head, schema).unionByName(blocks)


def _runs(col: pa.Array, most: int):
    """Runs of whole rows that hold about ``most`` ids; a longer row stands alone."""
    size = col.value_lengths() if pa.types.is_list(col.type) else pc.binary_length(col)
    ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(col):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield col.slice(at, stop - at)
        at = stop


def _rows(found, sym, starts, doc_ids, stream, freq, bits, crc, out):
    n = len(sym)
    whole = n // BLOCK
    coded = []
    for a in range(0, whole, max(1, GROUP // BLOCK)):
        b = min(whole, a + max(1, GROUP // BLOCK))
        coded += encode(sym[a * BLOCK : b * BLOCK].reshape(b - a, BLOCK), freq, bits)
    rest = n - whole * BLOCK
    if rest:
        # filled up to whole steps with the table's first id; n_ids tells how many count
        fill = np.zeros(-rest % LANES, sym.dtype)
        coded += encode(np.concatenate((sym[whole * BLOCK :], fill))[None, :], freq, bits)
    cut = np.searchsorted(starts, np.arange(len(coded) + 1) * BLOCK)
    for i, (words, states, places) in enumerate(coded):
        mine = found[i * BLOCK : (i + 1) * BLOCK]
        crcs = [zlib.crc32(mine[c : c + CHECKPOINT].tobytes()) for c in range(0, len(mine), CHECKPOINT)]
        code = words.tobytes()
        a, b = cut[i], cut[i + 1]
        cols = [
            [stream], [i], [len(mine)], [doc_ids.slice(a, b - a).to_pylist()], [(starts[a:b] - i * BLOCK).tolist()], [code], [zlib.crc32(code)],
            [states.tobytes()], [places.tolist()], [crcs], [crc],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)


def read_segment(row, segment: int, shared: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of one segment of a block row by the ``read_table`` of its shard set, checked against its checksum."""
    ids, freq, bits = shared
    states = np.frombuffer(row["states"], np.uint64).reshape(-1, LANES)
    words = np.frombuffer(row["words"], np.uint32)
    n = min(CHECKPOINT, row["n_ids"] - segment * CHECKPOINT)
    got = ids[decode(words[row["places"][segment] :], states[segment], n, freq, bits)]
    if zlib.crc32(got.tobytes()) != row["id_crcs"][segment]:
        raise ValueError(f"segment {segment} of block {row['block']} fails its checksum")
    return got


def read_block(row, shared: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block row, checked."""
    if zlib.crc32(row["words"]) != row["word_crc"]:
        raise ValueError(f"block {row['block']} fails its checksum")
    return np.concatenate([read_segment(row, i, shared) for i in range(len(row["places"]))])


def read_documents(rows) -> list[tuple[object, np.ndarray]]:
    """(document, ids without the end mark) of all documents of a shard set's collected rows, in order."""
    shared = next((read_table(r) for r in rows if r["block"] < 0), None)
    blocks = sorted((r for r in rows if r["block"] >= 0), key=lambda r: (r["stream"], r["block"]))
    if not blocks:
        return []
    ids = np.concatenate([read_block(r, shared) for r in blocks])
    parts = np.split(ids, np.flatnonzero(ids == END) + 1)[:-1]
    return list(zip((i for r in blocks for i in r["doc_ids"]), (p[:-1] for p in parts)))
