"""Blueprints: the declarative query, as immutable dataclasses with a JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from gleanery.columns import MARK

FIELD_TYPES = ("css", "xpath", "json", "markdown")


def _int(v: Any, default: int = 0, least: int | None = 0) -> int:
    try:
        n = int(v if v is not None else default)
    except (TypeError, ValueError):
        n = default
    return n if least is None else max(least, n)


@dataclass(frozen=True)
class Field:
    """One output column: a CSS or XPath selector, a JSON path, or a label to look up."""

    name: str
    css: str = ""
    attribute: str | None = None
    regex: str | None = None
    multiple: bool = False
    label: str | None = None
    type: str = "css"

    @classmethod
    def of(cls, d: dict) -> Field:
        kind = str(d.get("type") or "css")
        return cls(
            str(d.get("name") or ""), str(d.get("css") or d.get("path") or ""), d.get("attribute"), d.get("regex"), bool(d.get("multiple")), d.get("label"),
            kind if kind in FIELD_TYPES else "css",
        )

    def to_dict(self) -> dict:
        return {"name": self.name, "css": self.css, "attribute": self.attribute, "regex": self.regex, "multiple": self.multiple, "label": self.label, "type": self.type}


@dataclass(frozen=True)
class Source:
    """One of several starting points, with constant columns for its items and its own quota."""

    suffix: str = ""
    tags: dict[str, Any] = field(default_factory=dict)
    limit: int = 0

    @classmethod
    def of(cls, d: str | dict) -> Source:
        if isinstance(d, str):
            return cls(d)
        tags = {k: v for k, v in d.items() if k not in ("url_sufix", "url", "limit") and isinstance(v, (str, int, float, bool))}
        return cls(str(d.get("url_sufix", d.get("url", "")) or ""), tags, _int(d.get("limit")))

    def to_dict(self) -> str | dict:
        if not self.tags and not self.limit:
            return self.suffix
        return {"url_sufix": self.suffix, **({"limit": self.limit} if self.limit else {}), **self.tags}


@dataclass(frozen=True)
class Pagination:
    strategy: str = "none"
    css: str = ""

    @classmethod
    def of(cls, d: dict | None) -> Pagination:
        d = d or {}
        name = str(d.get("strategy") or "none")
        name = "infinite_scroll" if name == "load_more" else name
        if name not in ("none", "link_list", "next_link", "infinite_scroll"):
            raise ValueError(f"unknown pagination strategy {name!r}")
        return cls(name, str(d.get("css") or ""))

    def to_dict(self) -> dict:
        return {"strategy": self.strategy, "css": self.css}


@dataclass(frozen=True)
class InfiniteScroll:
    endpoint: str = ""
    method: str = "POST"
    body_format: str = "form"
    param: str = "page"
    param_mode: str = "offset"
    page_size: int = 20
    start: int = 20
    extra_params: dict = field(default_factory=dict)
    headers: dict = field(default_factory=dict)
    token_css: str | None = None
    token_attribute: str | None = None
    token_param: str = "_token"
    item_selector: str | None = None
    stop_when_empty: bool = True

    @classmethod
    def of(cls, d: dict | None) -> InfiniteScroll | None:
        if not d:
            return None
        return cls(
            str(d.get("endpoint") or ""), str(d.get("method") or "POST").upper(), "json" if d.get("body_format") == "json" else "form",
            str(d.get("param") or "page"), "page" if d.get("param_mode") == "page" else "offset", _int(d.get("page_size"), 20, 1), _int(d.get("start"), 20),
            dict(d.get("extra_params") or {}), dict(d.get("headers") or {}), d.get("token_css"), d.get("token_attribute"),
            str(d.get("token_param") or "_token"), d.get("item_selector"), bool(d.get("stop_when_empty", True)),
        )

    def to_dict(self) -> dict:
        return dict(self.__dict__)

    def value(self, i: int) -> int:
        """The paging parameter of request ``i``."""
        return self.start + i if self.param_mode == "page" else self.start + i * self.page_size


@dataclass(frozen=True)
class ApiDetail:
    enabled: bool = False
    endpoint: str = ""
    method: str = "GET"
    body: dict = field(default_factory=dict)
    body_format: str = "json"
    query: dict = field(default_factory=dict)
    headers: dict = field(default_factory=dict)
    items_path: str = ""

    @classmethod
    def of(cls, d: dict | None) -> ApiDetail:
        d = d or {}
        return cls(
            bool(d.get("enabled", bool(d.get("endpoint")))), str(d.get("endpoint") or ""), str(d.get("method") or "GET").upper(), dict(d.get("body") or {}),
            str(d.get("body_format") or "json"), dict(d.get("query") or {}), dict(d.get("headers") or {}), str(d.get("items_path") or ""),
        )

    def to_dict(self) -> dict:
        return dict(self.__dict__)


@dataclass(frozen=True)
class Api:
    endpoint: str = ""
    method: str = "GET"
    headers: dict = field(default_factory=dict)
    body: dict = field(default_factory=dict)
    body_format: str = "json"
    query: dict = field(default_factory=dict)
    items_path: str = ""
    total_path: str | None = None
    page_param: str | None = None
    page_size_param: str | None = None
    page_size: int = 100
    start_page: int = 0
    page_in_body: bool = False
    detail: ApiDetail = field(default_factory=ApiDetail)

    @classmethod
    def of(cls, d: dict | None) -> Api | None:
        if not d:
            return None
        return cls(
            str(d.get("endpoint") or ""), str(d.get("method") or "GET").upper(), dict(d.get("headers") or {}), dict(d.get("body") or {}),
            str(d.get("body_format") or "json"), dict(d.get("query") or {}), str(d.get("items_path") or ""), d.get("total_path"), d.get("page_param"),
            d.get("page_size_param"), _int(d.get("page_size"), 100), _int(d.get("start_page")), bool(d.get("page_in_body")), ApiDetail.of(d.get("detail")),
        )

    def to_dict(self) -> dict:
        return {**self.__dict__, "detail": self.detail.to_dict()}


@dataclass(frozen=True)
class Rule:
    """A filter on one column."""

    field: str
    operator: str = "not_empty"
    value: str | None = None

    @classmethod
    def of(cls, d: dict) -> Rule:
        v = d.get("value")
        return cls(str(d.get("field") or ""), str(d.get("operator") or "not_empty"), None if v is None else str(v))

    def to_dict(self) -> dict:
        return {"field": self.field, "operator": self.operator, "value": self.value}


@dataclass(frozen=True)
class Output:
    format: str = "json"
    stream: bool = False
    flatten: bool = False
    exclude: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, d: dict | None) -> Output:
        d = d or {}
        kind = str(d.get("format") or "json")
        drop, names = d.get("exclude_fields"), d.get("rename_fields")
        return cls(
            kind if kind in ("csv", "json", "jsonl", "markdown") else "json", bool(d.get("stream")), bool(d.get("flatten")),
            tuple(drop) if isinstance(drop, (list, tuple)) else (), dict(names) if isinstance(names, dict) else {},
        )

    def to_dict(self) -> dict:
        return {"format": self.format, "stream": self.stream, "flatten": self.flatten, "exclude_fields": list(self.exclude), "rename_fields": dict(self.rename)}


@dataclass(frozen=True)
class Http:
    timeout: int = 60
    retry_count: int = 3
    retry_delay_ms: int = 1000
    delay_ms: int = 0
    verify_tls: bool = True
    render_js: bool = False
    transport: str | None = None
    headers: dict = field(default_factory=dict)
    cookies: dict = field(default_factory=dict)
    proxies: tuple[str, ...] = ()

    @classmethod
    def of(cls, d: dict | None) -> Http:
        d = d or {}
        return cls(
            _int(d.get("timeout"), 60), _int(d.get("retry_count"), 3), _int(d.get("retry_delay_ms"), 1000), _int(d.get("delay_ms")), bool(d.get("verify_tls", True)),
            bool(d.get("render_js")), d.get("transport"), dict(d.get("headers") or {}), dict(d.get("cookies") or {}), tuple(d.get("proxies") or ()),
        )

    def to_dict(self) -> dict:
        return {**self.__dict__, "proxies": list(self.proxies)}


@dataclass(frozen=True)
class Blueprint:
    """A whole query. ``Blueprint.of`` reads the JSON form, older key names included."""

    url: str = ""
    mode: str = "html"
    item_selector: str = ""
    fields: tuple[Field, ...] = ()
    detail_fields: tuple[Field, ...] = ()
    scrape_detail: bool = False
    detail_link_field: str | None = None
    pagination: Pagination = field(default_factory=Pagination)
    infinite_scroll: InfiniteScroll | None = None
    api: Api | None = None
    sources: tuple[Source, ...] = ()
    max_pages: int = 0
    max_items: int = 0
    delay_between_pages_ms: int = 0
    delay_between_items_ms: int = 0
    http: Http = field(default_factory=Http)
    output: Output = field(default_factory=Output)
    dedup: bool = False
    dedup_key: str = "link"
    filter: bool = False
    rules: tuple[Rule, ...] = ()
    cache: bool = False
    cache_ttl: int = 3600
    throttle: bool = False
    throttle_concurrency: float = 1.0
    throttle_max_ms: int = 30000
    pipeline: tuple[str, ...] = ()
    item_schema: dict[str, str] = field(default_factory=dict)
    primary_image: bool = False
    gallery_images: bool = False
    all_images: bool = False
    image_path_prefix: str | None = None
    resumable: bool = False

    @classmethod
    def of(cls, d: dict) -> Blueprint:
        crawl, filters, cache, throttle, dedup = (d.get(k) or {} for k in ("crawl_config", "result_filters", "cache", "auto_throttle", "dedup"))
        rules = filters.get("rules", filters.get("filters", [])) if isinstance(filters, dict) else []
        return cls(
            url=str(d.get("url") or ""), mode="api" if d.get("mode") == "api" else "html", item_selector=str(d.get("item_selector") or ""),
            fields=tuple(Field.of(f) for f in d.get("fields") or []), detail_fields=tuple(Field.of(f) for f in d.get("detail_fields") or []),
            scrape_detail=bool(d.get("scrape_detail")), detail_link_field=d.get("detail_link_field"), pagination=Pagination.of(d.get("pagination")),
            infinite_scroll=InfiniteScroll.of(d.get("infinite_scroll") or d.get("load_more")), api=Api.of(d.get("api")),
            sources=tuple(Source.of(s) for s in d.get("search_filters") or d.get("filters") or d.get("start_urls") or []), max_pages=_int(d.get("max_pages")),
            max_items=_int(crawl.get("max_items")), delay_between_pages_ms=_int(crawl.get("delay_between_pages_ms")),
            delay_between_items_ms=_int(crawl.get("delay_between_items_ms")), http=Http.of(d.get("http_config")), output=Output.of(d.get("output_config") or d.get("output")),
            dedup=bool(dedup.get("enabled")), dedup_key=str(dedup.get("key_field") or "link"), filter=bool(filters.get("enabled")), rules=tuple(Rule.of(r) for r in rules),
            cache=bool(cache.get("enabled")), cache_ttl=_int(cache.get("ttl"), 3600), throttle=bool(throttle.get("enabled")),
            throttle_concurrency=max(0.1, float(throttle.get("target_concurrency", throttle.get("concurrency", 1.0)))), throttle_max_ms=_int(throttle.get("max_delay_ms"), 30000),
            pipeline=tuple(d.get("pipeline_names") or ()), item_schema=dict(d.get("item_schema") or {}), primary_image=bool(d.get("get_primary_image", d.get("save_images"))),
            gallery_images=bool(d.get("get_gallery_images")), all_images=bool(d.get("get_all_images")), image_path_prefix=d.get("image_path_prefix"),
            resumable=bool(d.get("resumable")),
        )

    @classmethod
    def load(cls, text: str) -> Blueprint:
        got = json.loads(text)
        if not isinstance(got, dict):
            raise ValueError("a blueprint is a JSON object")
        return cls.of(got)

    def to_dict(self) -> dict:
        return {
            "url": self.url, "mode": self.mode, "item_selector": self.item_selector, "fields": [f.to_dict() for f in self.fields],
            "detail_fields": [f.to_dict() for f in self.detail_fields], "scrape_detail": self.scrape_detail, "detail_link_field": self.detail_link_field,
            "pagination": self.pagination.to_dict(), "infinite_scroll": self.infinite_scroll.to_dict() if self.infinite_scroll else None,
            "api": self.api.to_dict() if self.api else None, "search_filters": [s.to_dict() for s in self.sources], "max_pages": self.max_pages,
            "crawl_config": {"max_items": self.max_items, "delay_between_pages_ms": self.delay_between_pages_ms, "delay_between_items_ms": self.delay_between_items_ms},
            "http_config": self.http.to_dict(), "output_config": self.output.to_dict(), "dedup": {"enabled": self.dedup, "key_field": self.dedup_key},
            "result_filters": {"enabled": self.filter, "rules": [r.to_dict() for r in self.rules]}, "cache": {"enabled": self.cache, "ttl": self.cache_ttl},
            "auto_throttle": {"enabled": self.throttle, "target_concurrency": self.throttle_concurrency, "max_delay_ms": self.throttle_max_ms},
            "pipeline_names": list(self.pipeline), "item_schema": dict(self.item_schema), "get_primary_image": self.primary_image,
            "get_gallery_images": self.gallery_images, "get_all_images": self.all_images, "image_path_prefix": self.image_path_prefix, "resumable": self.resumable,
        }

    def dump(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    def but(self, **changes: Any) -> Blueprint:
        """A copy with some parts changed: the fluent way to build one."""
        return replace(self, **changes)

    def select(self, name: str, css: str = "", **more: Any) -> Blueprint:
        """A copy with one more field; one without a name or anything to read is left out."""
        extra = Field(name, css, **more)
        usable = extra.name and (extra.css or extra.label or extra.type in ("json", "markdown"))
        return replace(self, fields=(*self.fields, extra)) if usable else self

    def where(self, column: str, operator: str = "not_empty", value: Any = None) -> Blueprint:
        return replace(self, filter=True, rules=(*self.rules, Rule(column, operator, None if value is None else str(value))))

    def validate(self, registry: tuple[str, ...] = ("absolute_url", "schema_coercion", "trim")) -> tuple[list[str], list[str]]:
        """(errors, warnings)."""
        from urllib.parse import urlsplit

        from gleanery.functions.coerce import TYPES

        bad: list[str] = []
        odd: list[str] = []
        parts = urlsplit(self.url) if self.url else None
        if parts is None:
            bad.append("url is missing")
        elif not (parts.scheme and parts.netloc):
            bad.append(f"url {self.url!r} is no valid URL")
        if self.mode == "html":
            if not self.item_selector:
                bad.append("item_selector is needed in html mode")
            if not self.fields:
                odd.append("without fields all items are empty")
        elif not (self.api and self.api.endpoint):
            bad.append("api.endpoint is needed in api mode")
        names: set[str] = set()
        for i, f in enumerate(self.fields):
            if not f.name:
                bad.append(f"fields[{i}] has no name")
            elif f.name in names:
                odd.append(f"field {f.name!r} is defined twice; the later one counts")
            names.add(f.name)
            if f.name.startswith(MARK):
                bad.append(f"field {f.name!r} begins with {MARK!r}, which the engine keeps for itself")
            if f.type and f.type not in FIELD_TYPES:
                bad.append(f"field {f.name!r} has the unknown type {f.type!r}")
            if not f.css and not f.label and f.type not in ("json", "markdown"):
                odd.append(f"field {f.name!r} has no selector")
        bad += [f"detail_fields[{i}] has no name" for i, f in enumerate(self.detail_fields) if not f.name]
        if self.scrape_detail and self.detail_link_field is None:
            bad.append("scrape_detail needs detail_link_field")
        elif self.scrape_detail and names and self.detail_link_field not in names:
            odd.append(f"detail_link_field {self.detail_link_field!r} is no field: details can't be followed")
        if self.dedup and self.mode != "api" and self.dedup_key not in names | {f.name for f in self.detail_fields}:
            odd.append(f"dedup.key_field {self.dedup_key!r} is no field")
        if self.pagination.strategy == "infinite_scroll" and self.infinite_scroll is None:
            bad.append("infinite_scroll pagination needs its settings")
        if self.pagination.strategy in ("next_link", "link_list") and not self.pagination.css:
            odd.append(f"{self.pagination.strategy} pagination without css reads one page only")
        bad += [f"item_schema: {k!r} has unknown type {t!r}" for k, t in self.item_schema.items() if t not in TYPES]
        odd += [f"pipeline step {n!r} is unknown and left out" for n in self.pipeline if n not in registry]
        if self.http.render_js and self.http.transport != "browser":
            odd.append("render_js needs the browser transport")
        return bad, odd
