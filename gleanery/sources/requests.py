"""Requests of an API blueprint, built on the driver: one for each source and page number."""

from __future__ import annotations

import json
from urllib.parse import parse_qsl, quote, quote_plus, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.plans.blueprint import Api, InfiniteScroll, Source

_OFFSETS = ("from", "offset", "skip", "start")


def source_endpoint(api: Api, suffix: str) -> str:
    suffix = suffix.strip()
    if not suffix:
        return api.endpoint
    if "{search}" in api.endpoint:
        return api.endpoint.replace("{search}", suffix.strip("/"))
    path, mark, query = api.endpoint.partition("?")
    return f"{path.rstrip('/')}/{suffix.lstrip('/')}{mark}{query}"


def encode_body(method: str, body: dict, kind: str) -> str | None:
    """None for GET; form or JSON text for others."""
    if method.upper() == "GET":
        return None
    if kind == "form":
        return urlencode(body, quote_via=quote_plus)
    return json.dumps(body, ensure_ascii=False, separators=(",", ":")) if body else "{}"


def request(api: Api, page: int, endpoint: str | None = None) -> dict:
    """``{method, url, query, body}`` of one page: the endpoint's own query, then the API's, then paging, later ones winning."""
    url, _, own = (endpoint if endpoint is not None else api.endpoint).partition("?")
    query = {**dict(parse_qsl(own, keep_blank_values=True)), **{k: v for k, v in api.query.items()}}
    body = dict(api.body)
    if "{page}" in url or "{page_size}" in url:
        url = url.replace("{page}", str(page)).replace("{page_size}", str(api.page_size))
    elif api.page_param is not None and api.page_in_body:
        body[api.page_param] = page
        if api.page_size_param is not None:
            body[api.page_size_param] = api.page_size
        for key, v in (("start", page * api.page_size), ("length", api.page_size)):
            if key in body:
                body[key] = v
    elif api.page_param is not None:
        query[api.page_param] = page * api.page_size if api.page_param.lower() in _OFFSETS else page
        if api.page_size_param is not None:
            query[api.page_size_param] = api.page_size
    return {"method": api.method, "url": url, "query": query, "body": encode_body(api.method, body, api.body_format)}


def scroll_request(scroll: InfiniteScroll, i: int, token: str | None = None) -> dict:
    params = {**scroll.extra_params, scroll.param: scroll.value(i), **({scroll.token_param: token} if token else {})}
    text = urlencode(params) if scroll.body_format == "form" or scroll.method == "GET" else json.dumps(params, ensure_ascii=False, separators=(",", ":"))
    return {"method": scroll.method, "url": scroll.endpoint, "query": params if scroll.method == "GET" else {}, "body": None if scroll.method == "GET" else text}


def plan(api: Api, sources: tuple[Source, ...], pages: int) -> list[dict]:
    """Requests of the first ``pages`` pages of every source."""
    endpoints = [source_endpoint(api, s.suffix) for s in sources] or [api.endpoint]
    paged = api.page_param is not None or "{page" in api.endpoint
    return [
        {"source_ord": s, "page_ord": p, **request(api, api.start_page + p, e)} for s, e in enumerate(endpoints) for p in range(pages if paged else 1)
    ]


def filled(template: str, columns: dict[str, Column]) -> Column:
    """A URL template's ``{name}`` filled with percent-encoded columns; null where a name is unknown or null."""
    import re

    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        c = columns.get(m[1])
        parts.append(F.lit(None).cast("string") if c is None else F.replace(F.replace(F.url_encode(c.cast("string")), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))
        at = m.end()
    whole = F.concat(*parts, F.lit(template[at:]))
    return F.when((whole != "") & ~F.contains(whole, F.lit("{")), F.replace(whole, F.lit("%7E"), F.lit("~")))


def filled_py(template: str, item: dict) -> str:
    import re

    return re.sub(r"\{(\w+)\}", lambda m: quote(str(item[m[1]]), safe="") if item.get(m[1]) is not None else m[0], template)
