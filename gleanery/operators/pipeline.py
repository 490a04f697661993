"""Item pipeline: named steps from DataFrame to DataFrame. ``columns.PAGE_URL`` is the page that an item came from."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.columns import INNER, PAGE_URL
from gleanery.functions.coerce import coerce
from gleanery.functions.text import squash
from gleanery.functions.urls import absolute

Step = Callable[[DataFrame], DataFrame]
_URLS = frozenset("all_images detail_image gallery_images href image images link src url".split())


def _change(df: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    return df.select(*[changes[c].alias(c) if c in changes else F.col(f"`{c}`") for c in df.columns])


def trim(df: DataFrame) -> DataFrame:
    """Whitespace squashed in every string column; lists are left alone."""
    return _change(df, {n: squash(F.col(f"`{n}`")) for n, t in df.dtypes if t == "string" and n not in INNER})


def absolute_urls(df: DataFrame, image_prefix: str | None = None) -> DataFrame:
    """URL columns resolved against the page; a ``link`` is taken from the site's root. What can't be resolved stays."""

    def whole(c: Column, name: str) -> Column:
        v = c
        if name == "link":
            v = F.when(~v.rlike("(?i)^https?://") & ~v.startswith("/"), F.concat(F.lit("/"), v)).otherwise(v)
        if image_prefix is not None:
            bare = ~v.rlike("(?i)^https?://") & ~v.startswith("/") & v.rlike(r"(?i)\.(?:gif|jpe?g|png|svg|webp)$")
            v = F.when(bare, F.concat(F.lit("/" + image_prefix.strip("/") + "/"), v)).otherwise(v)
        return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(F.coalesce(absolute(F.col(PAGE_URL), v), v))

    changes = {}
    for n, t in df.dtypes:
        if n in _URLS and t == "string":
            changes[n] = whole(F.col(f"`{n}`"), n)
        elif n in _URLS and t == "array<string>":
            changes[n] = F.transform(F.col(f"`{n}`"), lambda v: whole(v, n))  # noqa: B023 - called at once
    return _change(df, changes)


def coerced(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Columns of ``schema`` as their declared types; columns that aren't there are passed over."""
    kinds = dict(df.dtypes)
    return _change(df, {n: coerce(F.col(f"`{n}`"), t, kinds[n].startswith("array"), kinds[n]) for n, t in schema.items() if n in kinds})


def build(names: tuple[str, ...], schema: Mapping[str, str], image_prefix: str | None = None, registry: Mapping[str, Step] | None = None) -> list[Step]:
    """The steps of a run: the named ones, unknown names left out, or trim and absolute URLs; coercion last if there is a schema.

    A step that is named gets no settings, so ``absolute_url`` by name has no image prefix.
    """
    known: dict[str, Step] = {"trim": trim, "absolute_url": absolute_urls, "schema_coercion": lambda df: coerced(df, schema), **(registry or {})}
    steps = [known[n] for n in names if n in known] if names else [trim, lambda df: absolute_urls(df, image_prefix)]
    return steps + ([lambda df: coerced(df, schema)] if schema else [])


def apply(df: DataFrame, steps: list[Step]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
