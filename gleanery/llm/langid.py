"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text is lower-cased and every run of ASCII characters other than letters becomes one space, with a
space at both ends. Its profile is its ``top`` most frequent byte n-grams of 1 to ``longest`` bytes,
ties by gram; a space may only be a gram's first or last byte, and the single space is no gram. A
language's profile is the same over all rows labelled with it. A document's distance to a language is
the mean, over the document's profile, of how far each gram is out of place (``top`` for a gram that
the language's profile lacks), divided by ``top``: 0 is a perfect match, 1 shares nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_schema, flat, runs, slices, tidied

LONGEST = 3
TOP = 300
#: documents farther than this from every language are rejected
REJECT = 0.75
#: or farther than this where the second language is nearly as near: by less than the margin
DOUBT = 0.5
MARGIN = 0.025
UNKNOWN = "und"
_BUFFER = 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def _normal(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of normalised texts, each beginning and ending with a space."""
    data, offsets = flat(pc.utf8_lower(col))
    # a space before each text and after the last: every text then lies between two of them
    n, docs = len(data), len(offsets) - 1
    at = np.arange(n) + 1 + np.repeat(np.arange(docs), np.diff(offsets))
    buf = np.full(n + docs + 1, 32, np.uint8)
    buf[at] = np.where(_LETTER[data], data, 32)
    first = offsets[:-1] + np.arange(docs)
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != 32) | (buf[:-1] != 32)
    keep[first] = True
    pos = np.concatenate(([0], np.cumsum(keep)))
    return buf[keep], np.append(pos[first], pos[-1] - 1)


def _tally(col: pa.Array, longest: int, by_text: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) of all n-grams, for each text or (text 0) for all together; a gram's bytes are packed into one number.

    Only the longest grams are sorted: the shorter ones are their prefixes, so they lie in the same order.
    """
    buf, offsets = _normal(col)
    n = int(offsets[-1])
    key = np.zeros(n, np.uint64 if by_text else np.uint32)
    wide = np.append(buf, np.zeros(longest, np.uint8)).astype(key.dtype)
    for i in range(longest):
        key = key << key.dtype.type(8) | wide[i : i + n]
    if by_text:
        key |= np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64) << np.uint64(8 * longest), np.diff(offsets))
    key.sort()
    begin = runs(key)
    times = np.diff(np.append(begin, n))
    key = key[begin].astype(np.uint64)
    found = []
    for size in range(longest, 0, -1):
        if size < longest:
            key = key >> np.uint64(8)
            begin = runs(key)
            key, times = key[begin], np.add.reduceat(times, begin) if len(begin) else times
        byte = [(key >> np.uint64(8 * i)) & np.uint64(255) for i in range(size)]
        ok = byte[0] != 32 if size == 1 else np.ones(len(key), bool)
        for inner in byte[1:-1]:
            ok &= inner != 32
        if size == 2:
            # a text that ends in no letter has two spaces at its end
            ok &= key & np.uint64(0xFFFF) != 0x2020
        text = (key >> np.uint64(8 * size)).astype(np.int64)
        found.append((text[ok], key[ok] & np.uint64((1 << (8 * size)) - 1), times[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _counted(col: pa.Array, longest: int, by_text: bool = True, size: int = 1 << 20):
    """(first text, texts, text, gram, count) of ~1 MB runs of texts; longer texts are read in cuts."""
    for start, count in slices(col, size):
        part = col.slice(start, count)
        if count > 1 or (pc.binary_length(part[0]).as_py() or 0) <= 4 * size:
            yield (start, count, *_tally(part, longest, by_text))
            continue
        # one very long text: cuts before ASCII characters that aren't letters, which no gram crosses
        text, at, found = part[0].as_py(), 0, []
        while at < len(text):
            stop = at + size
            while stop < len(text) and not text[stop] < "A":
                stop += 1
            found.append(_tally(pa.array([text[at:stop]]), longest, by_text))
            at = stop
        doc, gram, times = (np.concatenate(x) for x in zip(*found))
        yield (start, 1, np.zeros(0, np.int64), gram, times) if not len(gram) else (start, 1, *_by_gram(gram, times))


def _by_gram(gram: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(gram, kind="stable")
    begin = runs(gram[order])
    return np.zeros(len(begin), np.int64), gram[order][begin], np.add.reduceat(times[order], begin)


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``(lang, gram BIGINT, rank INT)`` of every label's profile, over all labelled rows; rank starts at 0.

    Null labels and null or empty texts add nothing. Grams are counted where the texts lie, merged by
    (label, gram), and only ranked per label after that.
    """
    df = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("t")).where("lang IS NOT NULL AND t <> ''")
    schema, out = arrow_schema("lang string, gram bigint, n bigint")

    def count(batches):
        kept: dict[str, list] = {}
        held = 0

        def merged(parts):
            return _by_gram(*(np.concatenate(x) for x in zip(*parts)))[1:]

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names = coded.dictionary.to_pylist()
            label = coded.indices.to_numpy()
            for code, name in enumerate(names):
                mine = batch.column(1).filter(pa.array(label == code))
                for _, _, _, gram, n in _counted(mine, longest, by_text=False):
                    kept.setdefault(name, []).append((gram, n))
                    held += len(gram)
                if held > _BUFFER:
                    kept = {k: [merged(v)] for k, v in kept.items()}
                    held = sum(len(v[0][0]) for v in kept.values())
                    if held > _BUFFER // 2:
                        for k, v in kept.items():
                            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v[0][0])), pa.array(v[0][0].astype(np.int64)), pa.array(v[0][1])], schema=out)
                        kept, held = {}, 0
        for k, v in kept.items():
            gram, n = merged(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], schema=out)

    counts = df.mapInArrow(tidied(count), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the `top` largest of each label by a bounded aggregate, not a window over all of a label's grams
    packed = F.struct((-F.col("n")).alias("m"), _spelling(longest).alias("spelling"), F.col("gram"))
    spread = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    some = spread.groupBy("lang", "part").agg(F.slice(F.array_sort(F.collect_list(packed)), 1, top).alias("best"))
    best = some.groupBy("lang").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top).alias("best"))
    return best.select("lang", F.posexplode("best").alias("rank", "g")).select("lang", F.col("g.gram").alias("gram"), "rank")


def _spelling(longest: int):
    """Grams as hexadecimal text: the order of ties."""
    return F.lower(F.hex(F.col("gram")))


def _spelling_order(gram: np.ndarray, longest: int) -> np.ndarray:
    """Numbers in the order of the grams' bytes (a prefix comes first)."""
    shifted = gram.copy()
    for _ in range(longest - 1):
        small = shifted < np.uint64(1 << (8 * (longest - 1)))
        shifted = np.where(small, shifted << np.uint64(8), shifted)
    return shifted


def identify(
    docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    longest: int = LONGEST, top: int = TOP, reject: float = REJECT,
) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, detected, distance, runner_up, rejected)``.

    ``known`` is a ``profiles`` table; without it the rows of ``docs`` with a label make it.
    ``detected`` is the nearest language, ties by name, ``distance`` and ``runner_up`` the distances of
    the nearest and the second nearest (null if there is none), rounded to 6 places. A text without
    letters (null, empty, digits only), farther than ``reject`` from every language, or over ``DOUBT`` from all with two
    of them less than ``MARGIN`` apart (a mixture, as a rule), is ``und`` and rejected; without any profile every row is. Repeated rows and null ids give one result row each.
    Texts of any length are read whole. Other columns are ignored.
    """
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    schema, out = arrow_schema(
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, detected string, distance double, runner_up double, rejected boolean"
    )
    return df.mapInArrow(tidied(_identifier(docs, known, text, lang, longest, top, reject, out)), schema)


def _identifier(docs, known, text, lang, longest, top, reject, out):
    known = profiles(docs, text, lang, longest, top) if known is None else known
    table = known.toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    # (gram, language) -> rank, as one dense table: distinct grams x languages
    gram = table.column("gram").to_numpy().astype(np.uint64)
    vocabulary = np.unique(gram)
    ranks = np.full((len(vocabulary) + 1, len(names)), -1, np.int32)
    code = {n: i for i, n in enumerate(names)}
    ranks[np.searchsorted(vocabulary, gram), [code[n] for n in table.column("lang").to_pylist()]] = table.column("rank").to_numpy()
    model = docs.sparkSession.sparkContext.broadcast((names, vocabulary, ranks))

    def run(batches):
        names, vocabulary, ranks = model.value
        for batch in batches:
            n = batch.num_rows
            detected = np.full(n, UNKNOWN, object)
            near, second = np.full(n, np.nan), np.full(n, np.nan)
            for start, count, doc, gram, times in _counted(batch.column(batch.num_columns - 1), longest):
                if not len(doc) or not names:
                    continue
                # text and falling count in one number; a batch holds far fewer than 2**23 texts
                order = np.lexsort((_spelling_order(gram, longest), (doc << 40) - times))
                doc, gram = doc[order], gram[order]
                begin = runs(doc)
                rank = np.arange(len(doc)) - np.repeat(begin, np.diff(np.append(begin, len(doc))))
                doc, gram, rank = doc[rank < top], gram[rank < top], rank[rank < top]
                at = np.minimum(np.searchsorted(vocabulary, gram), len(vocabulary) - 1)
                at = np.where(vocabulary[at] == gram, at, len(vocabulary))
                there = ranks[at]
                out_of_place = np.where(there < 0, top, np.abs(there - rank[:, None]))
                begin = runs(doc)
                size = np.diff(np.append(begin, len(doc)))
                dist = np.add.reduceat(out_of_place, begin, axis=0) / (size[:, None] * float(top))
                who = start + doc[begin]
                best = np.argsort(dist, axis=1, kind="stable")
                near[who] = dist[np.arange(len(who)), best[:, 0]]
                if len(names) > 1:
                    second[who] = dist[np.arange(len(who)), best[:, 1]]
                detected[who] = np.array(names, object)[best[:, 0]]
            bad = ~(near <= reject) | (near > DOUBT) & (second - near < MARGIN)
            detected[bad] = UNKNOWN
            scores = [pa.array(np.floor(x * 1e6 + 0.5) / 1e6, from_pandas=True) for x in (near, second)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(detected, pa.string()), *scores, pa.array(bad)], schema=out)

    return run


def keep_identified(
    docs: DataFrame, known: DataFrame | None = None, text: str = "text", lang: str = "lang", longest: int = LONGEST, top: int = TOP, reject: float = REJECT
) -> DataFrame:
    """``docs`` without the rows ``identify`` rejects, the detected language written in ``lang`` if that is a string column.

    Columns, their order and repeated rows stay. Null and empty texts are rejected, texts are read whole, ids and
    columns of any other name pass through; an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    inner = _identifier(docs, known, text, lang, longest, top, reject, pa.schema([("t", pa.string()), ("d", pa.string()), ("a", pa.float64()), ("b", pa.float64()), ("r", pa.bool_())]))
    at = docs.columns.index(text)
    label = docs.columns.index(lang) if lang in docs.columns and docs.schema[lang].dataType.simpleString() == "string" else None
    out = to_arrow_schema(docs.schema)

    def run(batches):
        for batch in batches:
            judged = next(iter(inner(iter([_Pair(batch.column(at))]))))
            cols = list(batch.columns)
            if label is not None:
                cols[label] = judged.column(1).cast(out.field(label).type)
            yield pa.RecordBatch.from_arrays(cols, schema=out).filter(pc.invert(judged.column(4)))

    return docs.mapInArrow(tidied(run), docs.schema)


class _Pair:
    """A batch of a text column twice, the first standing in for the id."""

    def __init__(self, t: pa.Array):
        self.num_rows, self.num_columns, self.columns = len(t), 2, [t, t]

    def column(self, i: int) -> pa.Array:
        return self.columns[i]
