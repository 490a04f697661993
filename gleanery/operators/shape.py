"""Output shape: excluded, renamed and flattened columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.plans.blueprint import Output


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed one after the other: each goes to the end, and over a column of that name in its place."""
    order: dict[str, Column] = {c: F.col(f"`{c}`") for c in df.columns}
    for old, new in names.items():
        if old in order:
            value = order[old]
            order[new] = value
            if old != new:
                del order[old]
            else:
                del order[new]
    return df.select(*[c.alias(n) for n, c in order.items()])


def flattened(df: DataFrame) -> DataFrame:
    """Structs as ``a_b`` columns and lists as ``a_0``, ``a_1``… up to the longest, which one pass over the lists finds.

    Columns without any member vanish. A member that is missing is null.
    """
    while True:
        nested = [f for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType))]
        if not nested:
            return df
        lists = [f.name for f in nested if isinstance(f.dataType, T.ArrayType)]
        longest = df.agg(*[F.max(F.size(F.col(f"`{n}`"))).alias(f"n{i}") for i, n in enumerate(lists)]).first() if lists else ()
        size = dict(zip(lists, longest))
        out = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.StructType):
                out += [c.getField(g.name).alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
            elif isinstance(f.dataType, T.ArrayType):
                out += [F.get(c, F.lit(i)).alias(f"{f.name}_{i}") for i in range(max(0, size[f.name] or 0))]
            else:
                out.append(c)
        df = df.select(*out)


def shaped(df: DataFrame, output: Output) -> DataFrame:
    df = df.drop(*output.exclude)
    df = renamed(df, output.rename) if output.rename else df
    return flattened(df) if output.flatten else df
