"""Coercion of scraped strings to declared types. Nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.urls import strip

TRUE_WORDS = ("1", "active", "ativo", "on", "sim", "true", "yes")
TYPES = {
    "string": "string", "int": "bigint", "float": "double", "bool": "boolean",
    "string[]": "array<string>", "int[]": "array<bigint>", "float[]": "array<double>",
}


def to_string(c: Column, is_array: bool = False) -> Column:
    """Stripped; a list's members that aren't '' or '0' joined by spaces."""
    if is_array:
        return F.array_join(F.filter(c, lambda v: v.isNotNull() & ~v.isin("", "0")), " ")
    return strip(c.cast("string"))


def _prefix(digits: Column, exp: str, kind: str) -> Column:
    return F.coalesce(F.expr("NULL").cast(kind), F.regexp_extract(digits, exp, 0).try_cast(kind), F.lit(0).cast(kind))


def to_int(c: Column) -> Column:
    """The number at the start of what is left of digits and minus signs, 0 without one."""
    left = F.regexp_replace(c.cast("string"), r"[^0-9\-]", "")
    return F.when(c.isNotNull(), _prefix(left, r"^-?[0-9]+", "bigint"))


def to_float(c: Column) -> Column:
    """A decimal number written with point or comma: a comma before one or two last digits is the decimal one."""
    left = F.regexp_replace(c.cast("string"), r"[^0-9,.\-]", "")
    comma = F.replace(F.replace(left, F.lit(".")), F.lit(","), F.lit("."))
    plain = F.when(left.rlike(r",[0-9]{1,2}$"), comma).otherwise(F.replace(left, F.lit(",")))
    return F.when(c.isNotNull(), _prefix(plain, r"^-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)", "double"))


def to_bool(c: Column) -> Column:
    return F.lower(strip(c.cast("string"))).isin(*TRUE_WORDS)


_SCALAR = {"string": to_string, "int": to_int, "float": to_float, "bool": to_bool}


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _number(c: Column, kind: str) -> Column:
    """A column of numbers as another type of number, or whether it is 1: its text, which may have an exponent, doesn't count."""
    if kind == "int":
        return F.when(c.isNotNull(), F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint")))
    return c.cast("double") if kind == "float" else c == 1


def coerce(c: Column, kind: str, is_array: bool = False, now: str = "string") -> Column:
    """``c`` as the declared type; an unknown type leaves it as it is. ``is_array``: whether it is a list, ``now``: its type.

    A number becomes an integer by leaving its fraction out.
    """
    if kind in ("int", "float", "bool") and now.split("(")[0] in _NUMBERS:
        return _number(c, kind)
    if kind.endswith("[]"):
        one = _SCALAR.get(kind[:-2])
        inner = now[6:-1] if now.startswith("array<") else now
        if kind[:-2] in ("int", "float", "bool") and inner.split("(")[0] in _NUMBERS:
            one = lambda v: _number(v, kind[:-2])
        if one is None:
            return c
        items = c if is_array else F.when(c.isNotNull(), F.array(c))
        return F.transform(items, lambda v: one(v))
    if kind not in _SCALAR:
        return c
    if is_array and kind != "string":
        # a list has the string form "Array", so no digits and no true word
        empty = {"int": F.lit(0).cast("bigint"), "float": F.lit(0.0), "bool": F.lit(False)}[kind]
        return F.when(c.isNotNull(), empty)
    return to_string(c, is_array) if kind == "string" else _SCALAR[kind](c)
