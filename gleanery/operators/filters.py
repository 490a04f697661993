"""Conjunctive filters on items. A filter sees a column's string form: null is '', a list its members joined by spaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import pattern
from gleanery.plans.blueprint import Rule

_NUMBER = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def string_form(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    kind, c = df.schema[name].dataType.simpleString(), F.col(f"`{name}`")
    if kind == "array<string>":
        text = F.array_join(F.filter(c, lambda v: v.isNotNull()), " ")
    elif kind.startswith("array"):
        text = F.lit("")
    elif kind == "boolean":
        text = F.when(c, "1").otherwise("")
    elif kind in ("double", "float"):
        text = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    elif kind == "variant":
        text = F.coalesce(c.cast("string"), F.lit(""))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def condition(df: DataFrame, rule: Rule) -> Column:
    """Whether a row passes the rule; an unknown operator passes all, an invalid pattern none."""
    s, v = string_form(df, rule.field), rule.value
    want = F.lit(v or "")
    if rule.operator == "not_empty":
        return s != ""
    if rule.operator == "empty":
        return s == ""
    if rule.operator == "contains":
        return s.contains(want) if v is not None else F.lit(False)
    if rule.operator == "not_contains":
        return ~s.contains(want) if v is not None else F.lit(True)
    if rule.operator == "equals":
        return s == want
    if rule.operator == "not_equals":
        return s != want
    if rule.operator == "matches":
        exp = pattern(v) if v is not None else None
        return s.rlike(exp) if exp is not None else F.lit(False)
    if rule.operator in ("gt", "lt"):
        if v is None:
            return F.lit(False)
        import re

        m = re.match(r"\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?", v)
        bound = F.lit(float(m[0]) if m else 0.0)
        number = F.when(s.rlike(_NUMBER), F.btrim(s, F.lit(" \t\n\r\x0b\x0c")).try_cast("double"))
        return F.coalesce(number > bound if rule.operator == "gt" else number < bound, F.lit(False))
    return F.lit(True)


def passes(df: DataFrame, rules: tuple[Rule, ...]) -> Column:
    return reduce(lambda a, b: a & b, (condition(df, r) for r in rules), F.lit(True))
