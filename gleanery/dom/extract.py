"""Reading a page's items and links from its tree, and the Arrow stage that does so for a table of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from gleanery.batches import give_back, small_batches, swept, tidied
from gleanery.columns import HTML, ITEM, PAGE_URL
from gleanery.dom import css, xpath
from gleanery.dom.labels import label_map, normal
from gleanery.dom.markdown import Markdown
from gleanery.dom.tree import Node, parse
from gleanery.functions.text import capture_py
from gleanery.functions.urls import absolute_py
from gleanery.plans.blueprint import Field


def find(node: Node, field: Field) -> list:
    if not field.css:
        return [node]
    return xpath.select(node, field.css) if field.type == "xpath" else css.select(node, field.css)


def read(node: Node | str, field: Field, page_url: str | None) -> str | None:
    """One value of a matched node: Markdown, an attribute, or its text."""
    if isinstance(node, str):
        return capture_py(" ".join(node.split()), field.regex) if field.regex is not None else " ".join(node.split())
    if field.type == "markdown":
        return Markdown(page_url).render(node) or None
    raw = node.attrs.get(field.attribute.lower()) if field.attribute is not None else node.text()
    raw = raw.strip() if raw is not None else None
    return capture_py(raw, field.regex) if field.regex is not None else raw


def value(node: Node, field: Field, page_url: str | None, labels: Callable[[], dict[str, str]]) -> str | None | list[str]:
    """A field's value below an item's node; null, or no members, where nothing matches or the selector can't be read."""
    if field.label:
        raw = labels().get(normal(field.label))
        got = capture_py(raw.strip(), field.regex) if raw is not None and field.regex is not None else raw
        return ([got] if got else []) if field.multiple else got
    try:
        found = find(node, field)
    except css.SelectorError:
        found = []
    if field.multiple:
        return [v for v in (read(n, field, page_url) for n in found) if v]
    return read(found[0], field, page_url) if found else None


def items(root: Node, selector: str) -> list[Node]:
    """Item nodes in document order; none if the selector can't be read."""
    try:
        return css.select(root, selector)
    except css.SelectorError:
        try:
            return [n for n in xpath.select(root, selector) if isinstance(n, Node)] if selector.startswith(("/", ".", "(")) else []
        except css.SelectorError:
            return []


def record(node: Node, fields: tuple[Field, ...], page_url: str | None) -> list:
    cache: list[dict[str, str]] = []

    def labels() -> dict[str, str]:
        if not cache:
            cache.append(label_map(node))
        return cache[0]

    return [value(node, f, page_url, labels) for f in fields]


def _distinct(fields: tuple[Field, ...]) -> tuple[Field, ...]:
    """Fields by name; the later definition counts, in the place of the first."""
    return tuple({f.name: f for f in fields}.values())


def extract(pages: DataFrame, fields: tuple[Field, ...], selector: str | None, keep: tuple[str, ...] = (), url: str = "url", html: str = "html") -> DataFrame:
    """``keep``, the page's address, the item's place in it and the fields of every item of every page, each page parsed once.

    ``selector`` None takes the whole page as one item. Null HTML has no items. Items of no field have their
    order alone.
    """
    fields = _distinct(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    df = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url}`").alias(PAGE_URL), F.col(f"`{html}`").alias(HTML))
    kinds = [T.StructField(f.name, T.ArrayType(T.StringType()) if f.multiple else T.StringType()) for f in fields]
    schema = T.StructType([*df.drop(HTML).schema.fields, T.StructField(ITEM, T.LongType()), *kinds])
    out = to_arrow_schema(schema)

    def records(text: str | None, page: str | None) -> list[list]:
        if text is None:
            return []
        root = parse(text)
        return [record(node, fields, page) for node in ([root] if selector is None else items(root, selector))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, values = [], [], [[] for _ in fields]
            texts = batch.column(HTML)
            for i, (page, text) in enumerate(zip(batch.column(PAGE_URL).to_pylist(), swept(t.as_py() for t in texts))):
                for at, row in enumerate(records(text, page)):
                    rows.append(i)
                    places.append(at)
                    for column, v in zip(values, row):
                        column.append(v)
            kept = batch.drop_columns([HTML]).take(pa.array(rows, pa.int64()))
            columns = [pa.array(v, out.field(f.name).type) for v, f in zip(values, fields)]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(places, pa.int64()), *columns], schema=out)

    return df.mapInArrow(tidied(run), schema)


def _texts(function: Callable[[str | None, str], list[str] | str | None], kind: str):
    """A function of (url, html) as an Arrow-batched column function."""

    small_batches()

    @pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            for url, html in batches:
                yield pd.Series([None if h is None else function(u, h) for u, h in zip(url, swept(html))], dtype=object)
        finally:
            give_back()

    return run


def links(selector: str = "a", attribute: str = "href"):
    """Column function (url, html) → the distinct absolute links of the matches, in order; ``#`` and blank ones left out."""

    def read_links(url: str | None, html: str) -> list[str]:
        found = [n.get(attribute).strip() for n in items(parse(html), selector)]
        return list(dict.fromkeys(u for u in (absolute_py(url, v) for v in found if v not in ("", "#")) if u))

    return _texts(read_links, "array<string>")


def next_link(selector: str):
    """Column function (url, html) → the absolute link of the first match, null without one."""

    def read_next(url: str | None, html: str) -> str | None:
        found = items(parse(html), selector)
        return absolute_py(url, found[0].get("href")) if found else None

    return _texts(read_next, "string")


def token(selector: str, attribute: str | None = None):
    """Column function (url, html) → attribute or text of the first match, null if blank."""

    def read_token(url: str | None, html: str) -> str | None:
        found = items(parse(html), selector)
        return (found[0].get(attribute) if attribute else found[0].text()).strip() or None if found else None

    return _texts(read_token, "string")


def markdown(chrome: bool = False):
    """Column function (url, html) → Markdown, links resolved against the URL."""
    from gleanery.dom.markdown import to_markdown

    return _texts(lambda url, html: to_markdown(html, url, chrome), "string")


def select_all(selector: str, attribute: str | None = None, inner: bool = False):
    """Column function (url, html) → text, attribute or HTML of all matches: inspection of pages."""

    def read_all(url: str | None, html: str) -> list[str]:
        found = items(parse(html), selector)
        return [n.html() if inner else n.get(attribute) if attribute else n.text() for n in found]

    return _texts(read_all, "array<string>")


def label_values():
    """Column function (url, html) → array of ``label``/``value`` pairs of the page."""
    from gleanery.dom.labels import pairs

    return _texts(lambda url, html: [{"label": a, "value": b} for a, b in pairs(parse(html))], "array<struct<label:string,value:string>>")


__all__ = ["extract", "items", "label_values", "links", "markdown", "next_link", "record", "select_all", "token", "value"]
