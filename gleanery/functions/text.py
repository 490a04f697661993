"""Text functions: whitespace, regular expressions given as literals, names, visible text."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
_PLAIN = "aaaaaeeeeiiiiooooouuuucn"
_DELIMITED = re.compile(r"\A\s*([^\w\s\\])(.*)([^\w\s\\])([a-zA-Z]*)\s*\Z", re.S)
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def squash(c: Column) -> Column:
    """Every run of whitespace as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def squash_py(text: str) -> str:
    return " ".join(text.split())


@lru_cache(maxsize=1024)
def pattern(literal: str) -> str | None:
    """A regular expression literal with delimiters and flags, as an expression with inline flags.

    None if it isn't a valid one. The flags i, m, s, x and u are known.
    """
    m = _DELIMITED.match(literal)
    if not m or m[3] != _PAIRS.get(m[1], m[1]) or set(m[4]) - set("imsxuUD"):
        return None
    body = m[2] if m[1] in _PAIRS or m[1] in r"\.^$*+?|" else m[2].replace("\\" + m[1], m[1])
    flags = "".join(f for f in m[4] if f in "imsx")
    try:
        re.compile(body)
    except re.error:
        return None
    return (f"(?{flags})" if flags else "") + body


def capture(c: Column, literal: str) -> Column:
    """Group 1 of the first match, or the match if there is no group; null without a match; '' and null stay.

    A literal that isn't valid matches nothing.
    """
    exp = pattern(literal)
    if exp is None:
        return F.when(c == "", c)
    group = 1 if re.compile(exp).groups else 0
    found = F.regexp_extract(c, exp, group)
    return F.when(c == "", c).when(c.rlike(exp), found)


def capture_py(text: str | None, literal: str) -> str | None:
    if not text:
        return text
    exp = pattern(literal)
    m = re.search(exp, text) if exp is not None else None
    if m is None:
        return None
    return (m[1] or "") if m.re.groups else m[0]


def field_name(label: Column) -> Column:
    """A label as a lower-case name of letters, digits and underscores; ``field`` if nothing is left."""
    low = F.regexp_replace(F.lower(F.btrim(label, F.lit(" \t\n\r\0\x0b"))), "[ªº°]", "")
    name = F.btrim(F.regexp_replace(F.translate(low, _ACCENTED, _PLAIN), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(name == "", F.lit("field")).otherwise(name)


def field_name_py(label: str) -> str:
    low = re.sub("[ªº°]", "", label.strip().lower()).translate(str.maketrans(_ACCENTED, _PLAIN))
    return re.sub("[^a-z0-9]+", "_", low).strip("_") or "field"


def snake(name: Column) -> Column:
    """``camelCase`` as ``camel_case``."""
    split = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.btrim(F.regexp_replace(split, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def shorten(c: Column, most: int) -> Column:
    """The first ``most`` characters, the last of them an ellipsis where the text is longer."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def visible_length(html: Column) -> Column:
    """Bytes of text outside scripts, styles, templates and tags, whitespace squashed."""
    bare = F.regexp_replace(html, r"(?is)<(noscript|script|style|template)(?=[\s/>])[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    return F.octet_length(squash(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


def parse_pairs(c: Column, pair: str, value: str) -> Column:
    """``a=1; b=2`` and the like as a map; later keys win."""
    parts = F.filter(F.transform(F.split(c, pair), lambda p: F.btrim(p)), lambda p: p != "")
    entries = F.transform(parts, lambda p: F.struct(F.btrim(F.split(p, value, 2)[0]).alias("k"), F.btrim(F.coalesce(F.get(F.split(p, value, 2), F.lit(1)), F.lit(""))).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)
