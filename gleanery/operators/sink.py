"""The ordered item sink: first-wins dedup, then filters, then limits, in order of arrival.

Order is three columns: source, page and item. A first occurrence that fails a filter still uses up its key; blank
keys are never duplicates; limits count kept items; items after a stop are never seen, so that their keys
stay free for the next source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.columns import FIRST, KEPT, SEEN
from gleanery.operators.filters import passes, string_form
from gleanery.plans.blueprint import Rule
from gleanery.scratch import drop_shared, write_shared

ORDER = ("source_ord", "page_ord", "item_ord")


def first_wins(df: DataFrame, key: Column, order: tuple[str, ...] = ORDER) -> Column:
    """Whether a row is the first of its key in order; rows with a blank key all are."""
    blank = F.coalesce(key, F.lit("")) == ""
    # blank rows are spread by their position: they would otherwise all be one group
    part = F.when(blank, F.concat_ws(":", F.lit("\0"), *[F.col(c) for c in order])).otherwise(key)
    return blank | (F.row_number().over(Window.partitionBy(part).orderBy(*order)) == 1)


def unseen(df: DataFrame, key: str | None, seen: DataFrame | None) -> DataFrame:
    """Rows whose key isn't in ``seen(key)``; blank keys never are."""
    if key is None or seen is None or key not in df.columns:
        return df
    old = seen.select(F.col("key").cast("string").alias(SEEN)).where(F.col(SEEN) != "").distinct()
    return df.join(old, string_form(df, key) == F.col(SEEN), "left_anti")


def judged(df: DataFrame, key: str | None, rules: tuple[Rule, ...], seen: DataFrame | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``df`` with ``columns.FIRST`` (no duplicate) and ``columns.KEPT`` (and passes the filters)."""
    df = unseen(df, key, seen)
    first = first_wins(df, string_form(df, key), order) if key is not None else F.lit(True)
    df = df.withColumn(FIRST, first)
    return df.withColumn(KEPT, F.col(FIRST) & passes(df, rules))


def _visited(df: DataFrame, limit: int, order: tuple[str, ...]) -> DataFrame:
    """Rows up to the one that fills the limit."""
    if limit <= 0:
        return df
    last = df.where(F.col(KEPT)).orderBy(*order).limit(limit).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*order)).alias("last")).first()
    if last["n"] < limit:
        return df
    end = F.struct(*[F.lit(last["last"][c]).cast(df.schema[c].dataType).alias(c) for c in order])
    return df.where(F.struct(*order) <= end)


def accept(
    df: DataFrame, key: str | None = None, rules: tuple[Rule, ...] = (), limit: int = 0, quotas: dict[int, int] | None = None,
    seen: DataFrame | None = None, observe: Callable[[DataFrame], None] | None = None, order: tuple[str, ...] = ORDER,
) -> DataFrame:
    """Kept rows in the columns of ``df``.

    ``quotas`` limits single sources; with quotas and dedup the sources are taken in turn (there are few), as
    a key that one source never reached must stay free for the next. Otherwise one window judges all rows.
    With quotas or a limit ``df`` is written first, so that its rows are made once, however often they are read.
    ``observe`` is handed the visited rows with ``columns.FIRST`` and ``columns.KEPT``.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    quotas = {s: n for s, n in (quotas or {}).items() if n > 0}
    source = order[0]
    if not quotas:
        if limit > 0:
            df = write_shared(judged(df, key, rules, seen, order), "sink-judged")[0]
            got = _visited(df, limit, order)
        else:
            got = judged(df, key, rules, seen, order)
        if observe:
            observe(got)
        return got.where(F.col(KEPT)).select(*columns)
    spark = df.sparkSession
    schema = df.schema
    df, path = write_shared(df, "sink-items", by=source)
    parts: list[DataFrame] = []
    keys, left = seen, limit
    for one in sorted(r[0] for r in df.select(source).distinct().collect()):  # a row a source
        mine = judged(df.where(F.col(source) == one), key, rules, keys, order)
        # judged once; what lies beyond a quota or the limit is left out as the rows are read
        mine, _ = write_shared(mine, "sink")
        if quotas.get(one):
            mine = _visited(mine, quotas[one], order)
        if limit > 0:
            mine = _visited(mine, left, order)
        parts.append(mine)
        if limit > 0:
            left -= mine.where(F.col(KEPT)).count()
            if left <= 0:
                break
        if key is not None:
            new = mine.where(F.col(FIRST)).select(string_form(mine, key).alias("key")).where("key <> ''")
            keys = new if keys is None else keys.select("key").unionByName(new)
    drop_shared(spark, path)
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if observe:
        observe(out)
    return out.where(F.col(KEPT)).select(*columns)
