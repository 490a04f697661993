"""Item exports: JSON, JSON lines, CSV and Markdown, as distributed writers and, for small results, as text."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import squash

_HEADINGS = ("title", "name", "heading", "headline", "label")
_BODIES = ("markdown", "content", "body", "description", "text")
SUFFIX = {"csv": "csv", "json": "json", "jsonl": "jsonl", "markdown": "md"}


def json_lines(df: DataFrame) -> Column:
    """A row as one JSON object, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def cells(df: DataFrame) -> DataFrame:
    """Columns as CSV cells: nested ones as JSON, booleans as 1 and '', nulls as ''."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "1").otherwise("")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def csv_line(df: DataFrame) -> Column:
    """A row as a CSV line: a cell is quoted if it holds a comma, quote, space or line end, quotes doubled."""
    quote = lambda c: F.when(c.rlike(r'[",\s\\]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *[quote(F.col(f"`{c}`")) for c in df.columns])


def _shown(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
        text = F.array_join(F.transform(c, lambda v: squash(F.coalesce(v, F.lit("")))), ", ")
        return F.when(F.size(c) > 0, text)
    if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return F.to_json(c)
    if isinstance(f.dataType, T.BooleanType):
        return F.when(c, "true").when(~c, "false")
    return F.when(c.cast("string") != "", squash(c.cast("string")))


def markdown_section(df: DataFrame, position: Column) -> Column:
    """A row as a Markdown section: the first heading column there is, else ``Item n``; the first body column; the rest as bullets."""
    names = df.columns
    heading = next((n for n in _HEADINGS if n in names), None)
    body = next((n for n in _BODIES if n in names), None)
    numbered = F.concat(F.lit("Item "), position.cast("string"))
    flat = heading is not None and not isinstance(df.schema[heading].dataType, (T.ArrayType, T.StructType, T.VariantType, T.MapType))
    title = F.when(F.coalesce(F.col(f"`{heading}`").cast("string"), F.lit("")) != "", F.col(f"`{heading}`").cast("string")).otherwise(numbered) if flat else numbered
    lines = [F.array(F.concat(F.lit("## "), squash(title)))]
    none = F.array().cast("array<string>")
    if body is not None and isinstance(df.schema[body].dataType, T.StringType):
        text = F.btrim(F.col(f"`{body}`"), F.lit(" \t\n\r\0\x0b"))
        lines.append(F.when(F.coalesce(text, F.lit("")) != "", F.array(F.lit(""), text)).otherwise(none))
    shown = [F.concat(F.lit(f"- **{' '.join(f.name.split())}:** "), _shown(f)) for f in df.schema.fields if f.name not in (heading, body)]
    if shown:
        bullets = F.filter(F.array(*shown), lambda v: v.isNotNull())
        lines.append(F.when(F.size(bullets) > 0, F.concat(F.array(F.lit("")), bullets)).otherwise(none))
    return F.array_join(F.concat(*lines), "\n")


def union_header(df: DataFrame, present: str, order: tuple[str, ...]) -> list[str]:
    """Column names in the order in which rows first have them, from an array column of each row's names."""
    seen = df.select(F.struct(*[F.col(c) for c in order]).alias("at"), F.posexplode(present).alias("pos", "name"))
    first = seen.groupBy("name").agg(F.min(F.struct("at", "pos")).alias("first"))
    return [r["name"] for r in first.orderBy("first").select("name").collect()]  # a row a column


def text(df: DataFrame, kind: str, order: tuple[str, ...] = ()) -> str:
    """A small result as one text; ``order`` columns set the order and aren't written. Empty: ``[]`` for json, else ''."""
    shown = df.drop(*order)
    row = Window.orderBy(*order) if order else Window.orderBy(F.monotonically_increasing_id())
    if kind == "markdown":
        line = markdown_section(shown, F.row_number().over(row))
    else:
        line = json_lines(shown)
    if kind == "csv":
        import csv
        import io

        rows = cells(df.orderBy(*order).drop(*order) if order else df).collect()
        if not rows:
            return ""
        buf = io.StringIO()
        writer = csv.writer(buf, lineterminator="\n")
        writer.writerow(shown.columns)
        writer.writerows([tuple(r) for r in rows])
        return buf.getvalue()
    ordered = df.orderBy(*order) if order else df
    lines = [r[0] for r in ordered.select(line.alias("line")).collect()]
    if kind == "markdown":
        return "\n\n---\n\n".join(lines) + "\n" if lines else ""
    if kind == "jsonl":
        return "\n".join(lines)
    import json

    return json.dumps([json.loads(x) for x in lines], indent=4, ensure_ascii=False)


def write(df: DataFrame, kind: str, path: str, mode: str = "overwrite") -> None:
    """Distributed export: a folder of part files, rows in the order of ``df``. JSON is written as lines."""
    if kind == "csv":
        cells(df).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif kind == "markdown":
        df.select(markdown_section(df, F.monotonically_increasing_id() + 1).alias("value")).write.mode(mode).option("lineSep", "\n\n---\n\n").text(path)
    else:
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)


class FileStream:
    """One file, or standard output for ``-``, written as items arrive, so that the driver holds one item at a time.

    ``json`` and ``jsonl`` grow with each ``write``; ``csv``, whose header is the union of all items' columns, and ``markdown``
    are one document and written by ``close``.
    """

    def __init__(self, path: str, kind: str = "json"):
        import sys

        self.kind, self.path, self.held, self.first = kind, path, [], True
        if path != "-":
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.file = sys.stdout if path == "-" else open(path, "w", encoding="utf-8")
        if kind == "json":
            self.file.write("[\n")

    def write(self, df: DataFrame) -> None:
        """Appends the rows of ``df`` in their order; usable as the function of ``foreachBatch`` and of ``stream_items``."""
        if self.kind in ("csv", "markdown"):
            self.held.append(df)
            return
        for row in df.select(json_lines(df).alias("line")).toLocalIterator():
            if self.kind == "json":
                self.file.write(("  " if self.first else ",\n  ") + row["line"])
            else:
                self.file.write(row["line"] + "\n")
            self.first = False
        self.file.flush()

    def close(self) -> None:
        if self.held:
            whole = self.held[0]
            for more in self.held[1:]:
                whole = whole.unionByName(more, allowMissingColumns=True)
            self.file.write(text(whole, self.kind))
        if self.kind == "json":
            self.file.write("]\n" if self.first else "\n]\n")
        if self.path != "-":
            self.file.close()


def file_path(folder: str, name: str, kind: str) -> str:
    """``-`` stays standard output; a name gets the format's suffix unless it has one."""
    if name == "-":
        return name
    return os.path.join(folder, name if os.path.splitext(name)[1] else f"{name}.{SUFFIX[kind]}")


def upserted(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("link",), order: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put over those of equal key, the last of ``new`` in order winning; other columns stay.

    Keys are compared null-safe. Columns that only one side has are null on the other's own rows.
    """
    by = F.struct(*[F.col(c) for c in order]) if order else F.monotonically_increasing_id()
    columns = [c for c in new.columns if c not in order]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*columns), by).alias("_new")).select("_new.*")
    fresh = last.select(*[F.col(f"`{c}`").alias(f"_n_{c}") for c in columns], F.lit(True).alias("_is_new"))
    on = None
    for k in key:
        same = F.col(f"`{k}`").eqNullSafe(F.col(f"`_n_{k}`"))
        on = same if on is None else on & same
    both = old.join(fresh, on, "full_outer")
    names = list(dict.fromkeys([*old.columns, *columns]))

    def pick(c: str) -> Column:
        if c not in columns:
            return F.col(f"`{c}`")
        if c not in old.columns:
            return F.col(f"`_n_{c}`").alias(c)
        return F.when(F.col("_is_new"), F.col(f"`_n_{c}`")).otherwise(F.col(f"`{c}`")).alias(c)

    return both.select(*[pick(c) for c in names])
