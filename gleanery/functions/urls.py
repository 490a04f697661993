"""URL functions, as Spark columns and, for the DOM stage, as Python.

Relative links are resolved by plain rules, not by RFC 3986: empty segments and trailing slashes go,
``..`` is folded, and a link of a query alone replaces the file name of its base.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = " \t\n\r\0\x0b"
_ABSOLUTE = r"(?i)^https?://"
_SCHEME = r"(?i)^[a-z][-+.0-9a-z]*://"
_BASE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)"
_BASE_PY = re.compile(_BASE)
#: parameters that say which page a request asked for
PAGING = ("page", "pagina", "offset", "start", "from")
#: build files of site generators and web manifests: lists of records that are no data
_BUILD_FILE = r"(?i)/(?:page-data|_next/data)/|/app-data\.json(?:\?|$)|manifest\.(?:webmanifest|json)(?:\?|$)"


def strip(c: Column) -> Column:
    """Both ends without space, tab, newline, carriage return, NUL and vertical tab."""
    return F.btrim(c, F.lit(_SPACE))


def normalize(url: Column) -> Column:
    """Stripped, ``https:`` before ``//`` and ``https://`` where there is no scheme; '' and null stay."""
    u = strip(url)
    return F.when(u == "", u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(~u.rlike(_SCHEME), F.concat(F.lit("https://"), u)).otherwise(u)


def host(url: Column) -> Column:
    """Host of the normalized URL, ``site`` if there is none."""
    found = F.regexp_extract(normalize(url), _BASE, 2)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit("site")).otherwise(found)


def fetchable(url: Column) -> Column:
    """Whether the scheme is http or https; false for null."""
    return F.coalesce(strip(url).rlike(r"(?i)^https?:"), F.lit(False))


def _fold(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    return F.concat(F.lit("/"), F.array_join(F.when(F.array_contains(parts, ".."), folded).otherwise(parts), "/"))


def absolute(base: Column, link: Column) -> Column:
    """``link`` seen from ``base``; null if the link is null or blank, or if neither is a web address."""
    link = strip(link)
    base = F.coalesce(base, F.lit(""))
    root = F.when(base.rlike(_BASE), base).otherwise(normalize(base))
    scheme, server, port, path = (F.regexp_extract(root, _BASE, i) for i in (1, 2, 3, 4))
    origin = F.concat(scheme, F.lit("://"), server, F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    folder = F.regexp_extract(F.when(path == "", F.lit("/")).otherwise(path), r"^(.*/)", 1)
    return (
        F.when(link.isNull() | (link == ""), F.lit(None).cast("string"))
        .when(link.rlike(_ABSOLUTE), link)
        .when(~root.rlike(_BASE), F.when(fetchable(link), link))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, _fold(link)))
        .otherwise(F.concat(origin, _fold(F.concat(folder, link))))
    )


def without_page_params(url: Column, names: tuple[str, ...] = PAGING) -> Column:
    """The URL without its paging parameters."""
    pattern = "(?i)([?&])(?:" + "|".join(names) + ")=[^&#]*"
    cut = F.regexp_replace(url, pattern, "$1")
    cut = F.regexp_replace(F.regexp_replace(cut, "&{2,}", "&"), r"\?&", "?")
    return F.regexp_replace(cut, "[?&]+(#|$)", "$1")


def discardable(url: Column) -> Column:
    """Whether an address is no data endpoint though it may return records: a build file or a manifest."""
    return F.coalesce(url.rlike(_BUILD_FILE), F.lit(False))


def source_url(base: Column, suffix: Column) -> Column:
    """Address of an HTML source: its suffix put on the base as a query or as a path."""
    s = strip(F.coalesce(suffix, F.lit("")))
    query = s.startswith("?") | s.startswith("&") | base.endswith("?") | base.endswith("&") | (s.contains("=") & ~s.contains("/"))
    bare = F.rtrim(base, F.lit("?&"))
    joined = F.concat(bare, F.when(bare.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.ltrim(s, F.lit("?&")))
    path = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(s, F.lit("/")))
    return F.when(s == "", base).when(s.rlike(_ABSOLUTE), normalize(s)).when(query, joined).otherwise(path)


def endpoint_url(endpoint: Column, suffix: Column) -> Column:
    """Address of an API source: the suffix in place of ``{search}``, or as a path before the query."""
    s = strip(F.coalesce(suffix, F.lit("")))
    path, query = F.regexp_extract(endpoint, r"^([^?]*)", 1), F.regexp_extract(endpoint, r"^[^?]*(\?.*)?$", 1)
    longer = F.concat(F.rtrim(path, F.lit("/")), F.lit("/"), F.ltrim(s, F.lit("/")), query)
    return F.when(s == "", endpoint).when(endpoint.contains("{search}"), F.replace(endpoint, F.lit("{search}"), F.btrim(s, F.lit("/")))).otherwise(longer)


# the same in Python, for links inside a tree


def discardable_py(url: str) -> bool:
    return re.search(_BUILD_FILE, url) is not None


def without_page_params_py(url: str) -> str:
    cut = re.sub(rf"(?i)([?&])(?:{'|'.join(PAGING)})=[^&#]*", r"\1", url)
    cut = re.sub(r"\?&", "?", re.sub("&{2,}", "&", cut))
    return re.sub("[?&]+(#|$)", r"\1", cut)


def paging_py(endpoint: str) -> dict:
    """How an endpoint pages, as settings of an API: by numbers at the end of its path, by offset where its query has a
    limit, else by ``page`` and ``size``."""
    m = re.fullmatch(r"(.*)/(\d+)/(\d+)/?", endpoint)
    if m:
        return {"endpoint": m[1] + "/{page}/{page_size}", "start_page": int(m[2]), "page_size": int(m[3])}
    query = dict(parse_qsl(urlsplit(endpoint).query))
    m = re.match(r"\d+", query.get("limit", ""))
    if m and int(m[0]) > 0 and "page" not in query:
        return {"endpoint": endpoint, "page_param": "offset", "page_size": int(m[0])}
    return {"endpoint": endpoint, "page_param": "page", "page_size_param": "size", "page_size": 100}


def normalize_py(url: str) -> str:
    url = url.strip(_SPACE)
    if not url:
        return url
    if url.startswith("//"):
        return "https:" + url
    return url if re.match(_SCHEME, url) else "https://" + url


def host_py(url: str) -> str:
    m = _BASE_PY.match(normalize_py(url))
    return m[2] if m else "site"


def fetchable_py(url: str) -> bool:
    return bool(re.match(r"(?i)https?:", url.strip(_SPACE)))


def absolute_py(base: str | None, link: str | None) -> str | None:
    link = (link or "").strip(_SPACE)
    if not link:
        return None
    if re.match(_ABSOLUTE, link):
        return link
    m = _BASE_PY.match(base or "") or _BASE_PY.match(normalize_py(base or ""))
    if not m:
        return link if fetchable_py(link) else None
    scheme, server, port, path = m.groups()
    if link.startswith("//"):
        return f"{scheme}:{link}"
    if not link.startswith("/"):
        path = path or "/"
        link = path[: path.rfind("/") + 1] + link
    kept: list[str] = []
    for part in link.split("/"):
        if part == "..":
            del kept[-1:]
        elif part not in ("", "."):
            kept.append(part)
    return f"{scheme}://{server}{':' + port if port else ''}/{'/'.join(kept)}"


__all__ = [
    "PAGING", "absolute", "absolute_py", "discardable", "discardable_py", "endpoint_url", "fetchable", "fetchable_py", "host", "host_py", "normalize", "normalize_py", "paging_py", "source_url", "strip",
    "without_page_params", "without_page_params_py",
]
