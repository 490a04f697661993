"""Mixing sources to target weights by Pareto order sampling.

Each source gets a whole number of places, by largest remainders of ``total * weight``. A document's
expected copies are its source's places times its share of the source's mass, a document's mass being
the whole part of the square root of its characters (1 at least, 0 without text). Whole copies are
given with certainty; the fractions p that are left are an inclusion probability each, and as many
documents as are missing are those of the least (u / (1 - u)) / (p / (1 - p)), u a uniform number
hashed from the id: Pareto order sampling, of fixed size.

The cut in each source is found without sorting it: the odds are binned, the bins counted, and only
the bin that holds the cut is ranked.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.scratch import write_shared

RATE = 1.0
SEED = "mix"
BINS = 4096


def uniform(key, seed: str = SEED):
    """A number in (0, 1) of 48 bits from the MD5 of a string column."""
    digits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + seed))), 1, 12), 16, 10).cast("bigint")
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def draw(
    docs: DataFrame, weights: Mapping[str, float] | None = None, rate: float = RATE, id_col: str = "doc_id", text: str = "text",
    source: str = "source", seed: str = SEED,
) -> DataFrame:
    """Drawn rows as ``(doc_id, source, expected, copies)`` with ``copies >= 1``.

    ``weights`` gives each source's relative weight, one that is missing having 0; by default a source
    weighs the square root of its number of documents. The result has exactly ``round(rate * rows)``
    copies over all sources with mass, null being a source of its own (weight key ``None``). A null id
    is hashed by its text instead. Documents without text have no mass and are never drawn; a source
    without mass gets no places. Equal odds are ordered by id (nulls first) and then by a hash of the
    row; rows that are equal in all that are interchangeable. An empty table gives no rows.
    """
    rows, _ = write_shared(_masses(docs, id_col, text, source), "mix")
    out = _with_copies(rows, rows, weights, rate, seed)
    return out.select("doc_id", "source", "expected", "copies")


def _masses(docs: DataFrame, id_col: str, text: str, source: str, *more) -> DataFrame:
    t = F.col(f"`{text}`")
    size = F.length(t)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), row.alias("row"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.md5(t), F.lit("")).alias("key"),
        F.when(size > 0, F.greatest(F.lit(1), F.floor(F.sqrt(size)))).otherwise(0).cast("bigint").alias("mass"), *more,
    )


def places(rows: DataFrame, weights: Mapping[str, float] | None, rate: float) -> DataFrame:
    """``(source, mass_all, places)`` of every source with mass."""
    by = rows.groupBy("source").agg(F.sum("mass").alias("mass_all"), F.count(F.lit(1)).alias("n"))
    if weights is None:
        by = by.withColumn("w", F.when(F.col("mass_all") > 0, F.sqrt(F.col("n").cast("double"))).otherwise(0.0))
    else:
        given = F.lit(0.0)
        for name, w in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(given)
        by = by.withColumn("w", F.when(F.col("mass_all") > 0, given).otherwise(0.0))
    # one row a source: the windows over all of them are small
    everything = Window.partitionBy(F.lit(1))
    by = by.withColumn("total", F.round(F.sum("n").over(everything) * F.lit(float(rate))).cast("bigint"))
    by = by.withColumn("share", F.col("total") * F.col("w") / F.sum("w").over(everything)).where("w > 0")
    by = by.withColumn("whole", F.floor("share").cast("bigint"))
    order = everything.orderBy((F.col("share") - F.col("whole")).desc(), F.col("source").asc_nulls_first())
    more = (F.row_number().over(order) <= F.col("total") - F.sum("whole").over(everything)).cast("bigint")
    return by.select("source", "mass_all", (F.col("whole") + more).alias("places"))


def _expected(rows: DataFrame, spots: DataFrame, seed: str) -> DataFrame:
    """``rows`` of sources with places, with ``expected whole p odds`` and the columns of ``spots``."""
    spots = spots.withColumnRenamed("source", "of")
    got = rows.join(spots, rows["source"].eqNullSafe(spots["of"])).drop("of").where("mass > 0")
    got = got.withColumn("expected", F.col("places").cast("double") * F.col("mass") / F.col("mass_all"))
    got = got.withColumn("whole", F.floor("expected").cast("bigint")).withColumn("p", F.col("expected") - F.col("whole"))
    u = uniform(F.col("key"), seed)
    return got.withColumn("odds", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))


def _cuts(rows: DataFrame, weights, rate: float, seed: str) -> DataFrame:
    """One row a source: ``source mass_all places cut take equal``.

    Documents whose (odds, id, row) lies below ``cut`` are drawn, and ``take`` of the ``equal`` ones at it.
    """
    spots, _ = write_shared(places(rows, weights, rate), "mix-places")
    got = _expected(rows, spots, seed)
    got = got.withColumn("bin", F.floor(F.lit(float(BINS)) * F.col("odds") / (1 + F.col("odds"))).cast("int"))
    bins = got.groupBy("source", "bin").agg(F.first("places").alias("places"), F.sum("whole").alias("whole"), F.count("odds").alias("n"))
    per = Window.partitionBy("source")
    bins = bins.withColumn("missing", F.col("places") - F.sum("whole").over(per)).where("bin IS NOT NULL")
    bins = bins.withColumn("before", F.sum("n").over(per.orderBy("bin")) - F.col("n"))
    at = bins.where("before < missing AND missing <= before + n")
    at, _ = write_shared(at.select(F.col("source").alias("of"), F.col("bin").alias("in_bin"), (F.col("missing") - F.col("before")).alias("left")), "mix-bins")
    near = got.join(at, got["source"].eqNullSafe(at["of"]) & (got["bin"] == at["in_bin"]))
    near = near.select("source", "left", F.struct("odds", "doc_id", "row").alias("key3"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("key3")))
    same = near.groupBy("source", "key3").agg(F.min("rank").alias("from"), F.max("rank").alias("to"), F.first("left").alias("left"))
    same = same.where("from <= left AND left <= to").select(
        F.col("source").alias("of"), F.col("key3").alias("cut"), (F.col("left") - F.col("from") + 1).alias("take"), (F.col("to") - F.col("from") + 1).alias("equal")
    )
    return spots.join(same, spots["source"].eqNullSafe(same["of"]), "left").drop("of")


def _with_copies(df: DataFrame, rows: DataFrame, weights, rate: float, seed: str) -> DataFrame:
    """``df``, which has the columns of ``rows``, with ``expected`` and ``copies`` of the rows drawn.

    The cuts are a small table, so ``df`` is filtered where it lies.
    """
    cuts, _ = write_shared(_cuts(rows, weights, rate, seed), "mix-cuts")
    got = _expected(df, cuts, seed)
    key3 = F.struct("odds", "doc_id", "row")
    drawn = F.col("odds").isNotNull() & F.col("cut").isNotNull()
    below = drawn & (key3 < F.col("cut"))
    at = drawn & (key3 == F.col("cut"))
    split = at & (F.col("take") < F.col("equal"))
    plain = got.withColumn("copies", F.col("whole") + (below | at).cast("bigint"))
    if cuts.where("take < equal").isEmpty():
        return plain.where("copies > 0")
    # equal rows at a cut, of which only some are drawn
    rank = F.row_number().over(Window.partitionBy("source").orderBy("odds"))
    some = got.where(split).withColumn("copies", F.col("whole") + (rank <= F.col("take")).cast("bigint"))
    return plain.where(~split).unionByName(some).where("copies > 0")


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, rate: float = RATE, id_col: str = "doc_id", text: str = "text",
    source: str = "source", seed: str = SEED,
) -> DataFrame:
    """``docs`` as drawn by ``draw``: each row as often as it has copies, columns unchanged."""
    rows, _ = write_shared(_masses(docs, id_col, text, source), "mix")
    packed = _masses(docs, id_col, text, source, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    out = _with_copies(packed, rows, weights, rate, seed)
    out = out.select("whole_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    return out.select(*[F.col("whole_row").getField(c).alias(c) for c in docs.columns])
