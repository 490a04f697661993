"""Dotted JSON paths over VARIANT columns. A segment is a key; digits are a key first, then a list index."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import capture
from gleanery.functions.urls import strip


def parse(text: Column) -> Column:
    """JSON text as VARIANT, null where it isn't JSON."""
    return F.try_parse_json(text)


def _paths(path: str) -> list[str]:
    choices = []
    for s in path.split("."):
        key = "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']"
        choices.append([key, f"[{int(s)}]"] if s.isdigit() else [key])
    return ["$" + "".join(p) for p in itertools.product(*choices)]


def get(doc: Column, path: str, kind: str = "variant") -> Column:
    """What lies at the path; '' is the whole document; null where there is nothing."""
    if path == "":
        return doc if kind == "variant" else F.try_variant_get(doc, "$", kind)
    return F.coalesce(*[F.try_variant_get(doc, p, kind) for p in _paths(path)])


def text(v: Column) -> Column:
    """A scalar's stripped string, a list's or object's JSON; booleans are ``true`` and ``false``."""
    return strip(v.cast("string"))


def is_nested(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)"), F.lit(False))


def field(doc: Column, path: str, multiple: bool = False, regex: str | None = None) -> Column:
    """A field of a record as STRING, or ARRAY<STRING> for ``multiple``: scalars stripped, lists cleaned of null and ''.

    With a regex, nested values are null.
    """

    def one(v: Column) -> Column:
        s = text(v)
        if regex is None:
            return s
        return F.when(~is_nested(v), capture(s, regex))

    raw = get(doc, path)
    if not multiple:
        return one(raw)
    many = F.try_variant_get(raw, "$", "array<variant>")
    members = F.when(raw.isNull(), F.array().cast("array<variant>")).when(many.isNotNull(), many).otherwise(F.array(raw))
    return F.filter(F.transform(members, one), lambda v: F.coalesce(v, F.lit("")) != "")
