"""Proposing a blueprint from sample pages or responses, by scoring repeated structure.

Pages are judged one by one in the DOM stage; a corpus is summed up by votes (see ``infer``).
"""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gleanery.dom import css
from gleanery.dom.extract import _texts, record
from gleanery.dom.labels import pairs
from gleanery.dom.tree import Node, parse
from gleanery.functions.heuristics import image_score_py, link_score_py
from gleanery.functions.text import field_name_py
from gleanery.plans.blueprint import Api, Blueprint, Field, Pagination
from gleanery.plans.presets import GENERIC, Preset

_PLAIN = frozenset(
    """absolute block box-content fixed flex flex-col flex-row grid group h-auto h-full hidden inline items-center
    justify-center justify-start overflow-hidden relative static sticky w-auto w-full""".split()
)
_TELLING = ("card", "item", "listing", "offer", "product", "result", "spot-")
_CLEAN = re.compile(r"(?!\d)[\w-]+\Z", re.ASCII)
_CHROME_TAGS = ("aside", "footer", "header", "nav")
_CHROME_ROLES = ("banner", "complementary", "contentinfo", "navigation")
#: earlier ones win
_MAIN = "main|[role=main]|#main|#content|#primary|.main-content|.content-main|.page-content".split("|")
_LISTS = "ul.pagination|.pagination|.paginacao|.paginator|.paging|nav .page-numbers".split("|")
_NEXT = "a[rel=next]|a.next|li.next a|.next > a|.pager .next a|.pagination .next a".split("|")
_MORE = "#btn_carregarMais|[id*=carregarMais]|[id*=carregar-mais]|button.load-more|a.load-more|.load-more|[data-load-more]|button[id*=loadMore]".split("|")
_LAZY = "data-src data-original data-lazy-src".split()
_BACKGROUND = r"""#background-image\s*:\s*url\(["']?([^"')]+)["']?\)#i"""
_STARS = re.compile(r"\b\d+(?:\.\d+)?\s*(?:stars?|out\s+of\s+[0-9]|/\s*(?:10|5))\b", re.I)
_RATED = "data-average data-rate data-rating data-score data-stars".split()
CORE = GENERIC.core


def signature(n: Node) -> str:
    return ".".join([n.tag, *n.classes])


def stable_css(n: Node) -> str:
    """A selector for an element: its tag with a hand-made id, else with its clean classes."""
    own = n.get("id").strip()
    if own and _CLEAN.match(own) and not re.search(r"\d{2,}", own):
        return f"{n.tag}#{own}"
    return ".".join([n.tag, *(c for c in n.classes if _CLEAN.match(c))])


def _in_chrome(n: Node | None) -> bool:
    while n is not None:
        if n.tag in _CHROME_TAGS or n.get("role").lower() in _CHROME_ROLES:
            return True
        n = n.parent
    return False


def _weight(n: Node) -> int:
    return 10 * len(n.find("a")) + min(len(n.text().encode()), 500)


def main_content(root: Node) -> Node | None:
    """The page's main region: the heaviest match of the first telling selector with a weight of 20, else the heaviest block of 40."""

    def heaviest(nodes: list[Node], least: int) -> Node | None:
        best = max((n for n in nodes if not _in_chrome(n)), key=_weight, default=None)
        return best if best is not None and _weight(best) >= least else None

    for selector in _MAIN:
        found = heaviest(css.select(root, selector), 20)
        if found is not None:
            return found
    return heaviest(root.find("article", "div", "section"), 40)


# fields of one sample item


def _anchor(sample: Node) -> Node | None:
    anchors = sample.find("a")
    best = max(anchors, key=lambda a: link_score_py(a.get("href").strip()), default=None)
    if best is not None and link_score_py(best.get("href").strip()) >= -50:
        return best
    return next((a for a in anchors if a.get("href").strip()), None)


def _best_attribute(n: Node, names: list[str]) -> str | None:
    usable = [a for a in names if n.get(a).strip() and not n.get(a).strip().startswith("data:")]
    return max(usable, key=lambda a: image_score_py(n.get(a).strip()), default=None)


def _picture_score(n: Node) -> int:
    urls = [n.get(a).strip() for a in ["src", *_LAZY, "data-bg"] if n.get(a).strip() and not n.get(a).strip().startswith("data:")]
    score = max(map(image_score_py, urls), default=0)
    size = [int(m[0]) if (m := re.match(r"\d+", n.get(a).strip())) else 0 for a in ("width", "height")]
    score += 150 if max(size) >= 150 else -50 if any(0 < s < 50 for s in size) else 0
    name = n.get("class").lower()
    score -= 50 * any(w in name for w in ("badge", "icon", "logo", "mini", "small-img", "tiny", "xs"))
    return score + 30 * (len(n.get("alt").strip().encode()) > 20)


def _link(s: Node) -> Field | None:
    a = _anchor(s)
    return Field("link", stable_css(a), "href") if a is not None else None


def _title(s: Node) -> Field | None:
    for tag in ("h1", "h2", "h3", "h4", "h5"):
        for h in s.find(tag):
            if h.text():
                return Field("title", stable_css(h))
    for img in s.find("img"):
        if len(img.get("alt").strip().encode()) > 3:
            return Field("title", stable_css(img), "alt")
    dull = re.compile("btn-|button|cart|compare|favorit|icon-|javascript:|share|social|wishlist", re.I)
    for a in s.find("a"):
        if a.text() and not dull.search(a.get("href") + " " + a.get("class")):
            return Field("title", stable_css(a))
    return None


def _image(s: Node) -> Field | None:
    found: list[tuple[int, Node, str]] = []
    for img in s.find("img"):
        a = _best_attribute(img, ["src", *_LAZY])
        if a:
            found.append((_picture_score(img), img, a))
    for link in s.find("a"):
        a = _best_attribute(link, ["data-bg", *_LAZY, "data-model-picture", "data-product-picture"])
        if a:
            name = link.get("class").lower()
            found.append((image_score_py(link.get(a).strip()) + 80 * bool("card-image" in name or re.search(r"\blazyload\b", name)), link, a))
    for n in s.walk():
        m = re.search(_BACKGROUND[1:-2], n.get("style"), re.I)
        if m and m[1].strip() and not m[1].strip().startswith("data:"):
            found.append((image_score_py(m[1].strip()), n, "style"))
    best = max(found, key=lambda f: f[0], default=None)
    return Field("image", stable_css(best[1]), best[2], _BACKGROUND if best[2] == "style" else None) if best else None


def _price(s: Node, literals: tuple[str, ...] = GENERIC.prices) -> Field | None:
    from gleanery.functions.text import pattern

    known = [(p, re.compile(pattern(p))) for p in literals if pattern(p)]
    match = lambda n: next((p for p, exp in known if exp.search(n.content().strip())), None)
    for n in s.walk():
        p = match(n)
        if p and not any(match(c) for c in n.walk()):
            return Field("price", stable_css(n), None, p)
    return None


def _rating(s: Node, hints: tuple[str, ...] = GENERIC.ratings) -> Field | None:
    number = r"/\d+(?:\.\d+)?/"
    for n in s.walk():
        for a in _RATED:
            if re.fullmatch(r"[+-]?\d+(?:\.\d+)?", n.get(a).strip()):
                return Field("rating", stable_css(n), a, number)
        if _STARS.search(n.get("aria-label")):
            return Field("rating", stable_css(n), "aria-label", number)
        text = n.content().strip()
        if any(h in n.get("class").lower() for h in hints):
            for a in _RATED:
                if n.get(a).strip():
                    return Field("rating", stable_css(n), a, number)
            if re.search(r"\d", text):
                return Field("rating", stable_css(n), None, number)
        if _STARS.search(text) and not any(_STARS.search(c.content().strip()) for c in n.walk()):
            return Field("rating", stable_css(n), None, number)
    return None


def _address(s: Node) -> Field | None:
    for n in s.find("address"):
        if n.text():
            return Field("address", stable_css(n))
    for tag in ("p", "span", "div", "h2", "h3", "h4"):
        for n in s.find(tag):
            if n.text() and re.search("address|direccion|endereco|localizacao|location", n.get("class").lower()):
                return Field("address", stable_css(n))
    return None


def _description(s: Node) -> Field | None:
    long = [p for p in s.find("p") if len(p.text()) >= 60 and " " in p.text()]
    best = max(long, key=lambda p: len(p.text()), default=None)
    return Field("description", stable_css(best)) if best is not None else None


def _gallery(s: Node) -> Field | None:
    groups: dict[tuple[str, str], int] = {}
    for img in s.find("img"):
        a = _best_attribute(img, ["src", "data-bg", *_LAZY])
        if a and image_score_py(img.get(a).strip()) >= -50:
            groups[stable_css(img), a] = groups.get((stable_css(img), a), 0) + 1
    best = max(groups, key=groups.__getitem__, default=None)
    return Field("images", best[0], best[1], None, True) if best and groups[best] >= 2 else None



def labelled(s: Node, most: int = 40) -> list[Field]:
    """A field for each label of the item."""
    return list({field_name_py(a): Field(field_name_py(a), label=a) for a, _ in reversed(pairs(s))}.values())[::-1][:most]


def fields(sample: Node, gallery: bool = False, labels: bool = False, using: Preset = GENERIC) -> list[Field]:
    """Fields found in a sample; a later finder of the same name wins, labels never do."""
    every = [_link(sample), _title(sample), _image(sample), _price(sample, using.prices), _rating(sample, using.ratings), _address(sample), _description(sample)]
    found: dict[str, Field] = {}
    for f in [*every, *([_gallery(sample)] if gallery else [])]:
        if f is not None:
            found[f.name] = f
    for f in labelled(sample) if labels else []:
        found.setdefault(f.name, f)
    return list(found.values())


# lists


def _groups(n: Node) -> list[list[Node]]:
    by: dict[str, list[Node]] = {}
    for c in n.elements:
        by.setdefault(signature(c), []).append(c)
    return [g for g in by.values() if len(g) >= 3]


def list_score(group: list[Node]) -> int:
    """Of siblings of one signature: links, images and inner elements; generic classes cost, telling ones earn."""
    n = len(group)
    linked = sum(bool(i.find("a")) for i in group)
    pictured = sum(bool(i.find("img")) for i in group)
    if linked < max(2, n // 2):
        return 0
    deep = int(min(40, sum(sum(1 for _ in i.walk()) for i in group) / n))
    names = [c.lower() for c in group[0].classes]
    factor = 1.0 if any(c not in _PLAIN for c in names) else 0.05
    factor *= 4.0 if any(t in c for c in names for t in _TELLING) else 1.0
    factor *= 3.0 if "data-product-id" in group[0].attrs or "data-sku" in group[0].attrs else 1.0
    return int(linked * (10 + pictured * 5) * (1 + deep) * factor)


def _specific(sample: Node) -> int:
    names = [c.lower() for c in sample.classes if c.lower() not in _PLAIN]
    score = sum(10 + 50 * any(t in c for t in _TELLING) for c in names)
    return score + 100 * ("data-product-id" in sample.attrs or "data-sku" in sample.attrs)


def item_selector(container: Node, group: list[Node]) -> str:
    """Selector of a group's items: clean classes, else a data attribute or an id prefix that all share, else the child's tag."""
    first = group[0]
    clean = [c for c in first.classes if _CLEAN.match(c)]
    if clean:
        return ".".join([first.tag, *clean])
    shared = sorted(set.intersection(*({a for a in i.attrs if a.startswith("data-") and _CLEAN.match(a)} for i in group)))
    if shared:
        return f"{first.tag}[{next((a for a in shared if a.endswith('-id')), shared[0])}]"
    ids = [i.get("id").strip() for i in group]
    if all(ids):
        import os

        prefix = os.path.commonprefix(ids)
        cut = re.match(r"(.*?[-_])", prefix)
        prefix = cut[1] if cut else prefix
        if re.fullmatch(r"(?=[A-Za-z])[\w-]+[_-]", prefix, re.ASCII):
            return f'{first.tag}[id^="{prefix}"]'
    return f"{stable_css(container)} > {first.tag}"


def spread(total: int, most: int) -> list[int]:
    """Evenly spread positions, both ends among them."""
    if total <= most:
        return list(range(total))
    return sorted({int(i * (total - 1) / max(1, most - 1) + 0.5) for i in range(most)})


def check_list(root: Node, selector: str, sample: Node, using: Preset = GENERIC) -> tuple[bool, float]:
    """(valid, share of sampled items with enough core fields). Links must differ enough where there are three or more."""
    core, least, rate, unique = using.core, using.least, using.rate, using.unique
    found = fields(sample, using=using)
    if sum(f.name in core for f in found) < least:
        return False, 0.0
    try:
        nodes = css.select(root, selector)
    except css.SelectorError:
        return False, 0.0
    if not nodes:
        return False, 0.0
    rows = [dict(zip([f.name for f in found], record(nodes[i], tuple(found), None))) for i in spread(len(nodes), min(len(nodes), 15))]
    good = sum(sum(bool(isinstance(r.get(c), str) and r[c].strip()) for c in core) >= least for r in rows) / len(rows)
    links = [r["link"].strip() for r in rows if isinstance(r.get("link"), str) and r["link"].strip()]
    distinct = len(set(links)) / len(links) if len(links) >= 3 else 1.0
    return good >= rate and distinct >= unique, good


def find_list(root: Node, using: Preset = GENERIC) -> tuple[str, Node] | None:
    """(item selector, sample item) of the page's list: the best valid candidate, else the best-scored one."""
    scope = main_content(root) or root
    found: list[tuple[int, Node, list[Node]]] = []
    for n in [scope, *scope.walk()]:
        found += [(list_score(g), n, g) for g in _groups(n) if list_score(g) > 0]
    found.sort(key=lambda f: -f[0])
    best: tuple[float, int, str, Node] | None = None
    for _, container, group in found:
        variants = [group]
        inner: dict[str, list[Node]] = {}
        for i in group:
            if len(i.elements) == 1:
                inner.setdefault(signature(i.elements[0]), []).append(i.elements[0])
        nested = max(inner.values(), key=len, default=[])
        if len(nested) >= 3:
            variants.append(nested)
        for g in variants:
            selector = item_selector(container, g)
            valid, good = check_list(root, selector, g[0], using)
            if valid and (best is None or (good, _specific(g[0])) > best[:2]):
                best = (good, _specific(g[0]), selector, g[0])
    if best:
        return best[2], best[3]
    return (item_selector(found[0][1], found[0][2]), found[0][2][0]) if found else None


def find_pagination(root: Node) -> Pagination:
    for c in _LISTS:
        nodes = css.select(root, c)
        if any(n.find("a") for n in nodes):
            return Pagination("link_list", f"{c} a")
    for strategy, selectors in (("next_link", _NEXT), ("infinite_scroll", _MORE)):
        for c in selectors:
            if css.select(root, c):
                return Pagination(strategy, c)
    return Pagination()


def from_page(url: str, html: str, single: bool = False, using: Preset = GENERIC, labels: bool = True, main: bool = True) -> Blueprint:
    """A blueprint for one page: its list, or the whole body as one item where there is none or ``single``.

    ``using`` are the vocabularies, ``labels`` asks for labelled fields, ``main`` keeps a single page to its main content.
    """
    root = parse(html)
    found = None if single else find_list(root, using)
    more = {"item_schema": dict(using.schema), "image_path_prefix": using.image_prefix}
    if found is None:
        body = next(n for n in root.elements if n.tag == "body")
        some = [f for f in fields(main and main_content(root) or body, True, labels, using) if f.name != "link"]
        content = Field("content", "main" if main and root.find("main") else "body", type="markdown")
        return Blueprint(url=url, item_selector="body", fields=(*some, content), **more)
    selector, sample = found
    got = fields(sample, True, labels, using)
    key = "link" if any(f.name == "link" for f in got) else got[0].name if got else "link"
    return Blueprint(url=url, item_selector=selector, fields=tuple(got), pagination=find_pagination(root), dedup=bool(got), dedup_key=key, **more)


def with_details(bp: Blueprint, html: str, using: Preset = GENERIC, labels: bool = True) -> Blueprint:
    """The blueprint with the fields of a sample detail page that its items don't have, read by way of their link."""
    if not any(f.name == "link" for f in bp.fields):
        return bp
    root = parse(html)
    body = next(n for n in root.elements if n.tag == "body")
    own = {f.name for f in bp.fields}
    found = tuple(f for f in fields(main_content(root) or body, True, labels, using) if f.name not in own)
    return bp.but(scrape_detail=bool(found), detail_link_field="link" if found else bp.detail_link_field, detail_fields=found)


def infer(pages: DataFrame, single: bool = False) -> DataFrame:
    """``(host, blueprint, votes, pages)``: for each host the blueprint that most of its pages propose, ties by text.

    Addresses don't count for the vote; the least address of the winning pages becomes the blueprint's.
    """
    from gleanery.functions.urls import host

    propose = _texts(lambda url, html: from_page("", html, single).dump(), "string")
    votes = pages.where("html IS NOT NULL").select(host(F.col("url")).alias("host"), "url", propose("url", "html").alias("blueprint"))
    per = votes.groupBy("host", "blueprint").agg(F.count(F.lit(1)).alias("votes"), F.min("url").alias("url"))
    best = F.min(F.struct((-F.col("votes")).alias("less"), "blueprint", "url")).alias("b")
    top = per.groupBy("host").agg(best, F.sum("votes").alias("pages"))
    filled = F.regexp_replace(F.col("b.blueprint"), F.lit('"url": ""'), F.concat(F.lit('"url": '), F.to_json(F.array(F.col("b.url"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("b.url")))) - 2)))
    return top.select("host", filled.alias("blueprint"), (-F.col("b.less")).alias("votes"), "pages")


# JSON


def record_list(doc: Any) -> dict | None:
    """``{path, count, sample}`` of the list of records in a JSON document: the likeliest path, then the richer, the longer, the shallower."""
    best: tuple | None = None

    def category(path: str) -> int:
        parts = path.split(".")
        if any(re.fullmatch(r"aggregations?|breadcrumbs?|buckets?|facets?|filters?|_?links|meta|refinements?", p, re.I) for p in parts):
            return 0
        likely = r"(?:ads?|content|data|deals?|docs|elements|entries|hits|items?|listings?|nodes|products?|records?|results?|rows)$"
        return 2 if not path or re.search(likely, parts[-1], re.I) else 1

    def walk(node: Any, path: str) -> None:
        nonlocal best
        if isinstance(node, list) and node and 2 * sum(isinstance(e, dict) for e in node) >= len(node):
            if any(isinstance(e, dict) for e in node):
                sample = node[0]
                rich = len(sample) >= 3 if isinstance(sample, (dict, list)) else False
                mine = (category(path), rich, len(node), -path.count("."))
                if best is None or mine > best[0]:
                    best = (mine, path, sample)
                return
        for key, v in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
            if isinstance(v, (dict, list)):
                walk(v, f"{path}.{key}" if path else str(key))

    walk(doc, "")
    return {"path": best[1], "count": best[0][2], "sample": best[2]} if best else None


def api_fields(sample: dict, images: tuple[str, ...] = GENERIC.images, links: tuple[str, ...] = GENERIC.links) -> list[Field]:
    """Fields of a record's scalars and lists; the first that looks like an image or a link is given under that name too."""
    out: list[Field] = []
    names: set[str] = set()
    has = {"image": False, "link": False}
    for key, v in sample.items():
        if not key or isinstance(v, dict):
            continue
        name = re.sub("[^a-z0-9_]+", "_", re.sub(r"(?<!^)[A-Z]", r"_\g<0>", key).lower())
        if name in names:
            continue
        names.add(name)
        many = isinstance(v, list)
        out.append(Field(name, key, multiple=many, type="json"))
        if not has["image"] and any(h in key.lower() for h in images):
            out.append(Field("gallery_images" if many else "image", key, multiple=many, type="json"))
            has["image"] = True
        if not has["link"] and not many and any(h in key.lower() for h in links):
            out.append(Field("link", key, type="json"))
            has["link"] = True
    return out


def from_response(url: str, body: str, items_path: str | None = None, method: str = "GET", using: Preset = GENERIC) -> Blueprint | None:
    """A blueprint for a JSON endpoint, paged as its address says; None if the response has no list of records.

    ``items_path`` is where the list is, if that is known.
    """
    import json

    from gleanery.functions.urls import paging_py, without_page_params_py

    try:
        doc = json.loads(body)
    except ValueError:
        return None
    if items_path is not None:
        for part in filter(None, items_path.split(".")):
            doc = doc.get(part) if isinstance(doc, dict) else doc[int(part)] if isinstance(doc, list) and part.isdigit() and int(part) < len(doc) else None
        found = {"path": items_path, "count": len(doc), "sample": doc[0]} if isinstance(doc, list) and doc else None
    else:
        found = record_list(doc)
    if not found or not isinstance(found["sample"], dict) or not found["sample"]:
        return None
    got = api_fields(found["sample"], using.images, using.links)
    names = [f.name for f in got]
    key = next((k for k in ("id", "uuid", "link") if k in names), None)
    api = Api(items_path=found["path"], method=method, **paging_py(without_page_params_py(url)))
    return Blueprint(url=url, mode="api", api=api, fields=tuple(got), dedup=key is not None, dedup_key=key or "link", item_schema=dict(using.schema), image_path_prefix=using.image_prefix)


def judged_responses(captured: DataFrame) -> DataFrame:
    """``(url, path, n_fields, n_records)`` of the GET responses of ``captured(url, method, body)`` that hold a list of records.

    ``url`` is without paging parameters. Addresses of build files and manifests are left out.
    """
    import json

    from gleanery.functions.urls import discardable, without_page_params

    @pandas_udf("struct<path:string,n_fields:bigint,n_records:bigint>")
    def judge(body: pd.Series) -> pd.DataFrame:
        rows = []
        for b in body:
            try:
                got = record_list(json.loads(b)) if b else None
            except ValueError:
                got = None
            rows.append((got["path"], len(got["sample"]) if isinstance(got["sample"], (dict, list)) else 0, got["count"]) if got else (None, None, None))
        return pd.DataFrame(rows, columns=["path", "n_fields", "n_records"])

    usable = captured.where((F.upper(F.coalesce("method", F.lit("GET"))) == "GET") & F.col("url").isNotNull() & ~discardable(F.col("url")))
    got = usable.select(without_page_params(F.col("url")).alias("url"), judge("body").alias("j")).where("j.n_fields > 0")
    return got.select("url", "j.path", "j.n_fields", "j.n_records")


def best_response(captured: DataFrame) -> DataFrame:
    """The richest of the ``judged_responses``, then the longest, then by address."""
    best = F.min(F.struct((-F.col("n_fields")).alias("a"), (-F.col("n_records")).alias("b"), "url", "path")).alias("m")
    found = judged_responses(captured).agg(best).where("m IS NOT NULL")
    return found.select("m.url", "m.path", (-F.col("m.a")).alias("n_fields"), (-F.col("m.b")).alias("n_records"))


#: words of an address that likely lists things
HINTS = "(?i)" + "|".join(GENERIC.endpoints)
#: how many endpoints are suggested, tried, and how many scripts are read for them
SUGGESTED, TRIED, SCRIPTS = 10, 12, 6


def hinted(urls: list[str], most: int | None = None) -> list[str]:
    """Addresses with a telling word first, otherwise in their order; the first ``most``. Ranking leaves nothing else out."""
    return sorted(urls, key=lambda u: not re.search(HINTS, u))[:most]


def discovered(url: str, html: str, captured: list[dict] | None = None) -> list[str]:
    """The endpoints of captured responses with records and those that the page names, each once, in this order."""
    import json

    from gleanery.functions.urls import discardable_py, without_page_params_py

    found = []
    for r in captured or []:
        if (r.get("method") or "GET").upper() == "GET" and not discardable_py(r["url"]):
            try:
                got = record_list(json.loads(r.get("body") or ""))
            except ValueError:
                continue
            if got and isinstance(got["sample"], (dict, list)) and got["sample"]:
                found.append(without_page_params_py(r["url"]))
    return list(dict.fromkeys([*found, *endpoints_of(url, html)]))


def to_try(url: str, html: str, captured: list[dict] | None = None) -> list[str]:
    """The endpoints to ask for data, as many as are worth the requests."""
    return discovered(url, html, captured)[:TRIED]


def scripts_to_read(url: str, html: str) -> list[str]:
    """Addresses of the page's own scripts that endpoints are looked for in: those of its host, hinted ones first."""
    from gleanery.functions.urls import absolute_py, fetchable_py, host_py

    named = [absolute_py(url, s.get("src")) for s in parse(html).find("script") if s.get("src").strip()]
    return hinted([u for u in dict.fromkeys(named) if u and fetchable_py(u) and host_py(u) == host_py(url)], SCRIPTS)


def discovered_endpoints(pages: DataFrame, captured: DataFrame | None = None, by: str = "url") -> DataFrame:
    """``(page_url, endpoint, rank)``: what ``pages(url, html)``, and ``captured(page_url, url, method, body)``, name, hinted ones first.

    Pages of one address count as one, unless ``by`` is another column that tells them apart: it then comes first in
    the result, each page has what it names itself, and what was captured goes to all pages of its address.
    """
    from gleanery.functions.heuristics import endpoints

    own = [] if by == "url" else [by]
    keys = [*own, "page_url"]
    named = pages.select(*own, F.col("url").alias("page_url"), F.posexplode(endpoints(F.col("url"), F.col("html"))).alias("at", "endpoint"))
    found = named.select(*keys, "endpoint", F.lit(1).alias("of"), F.col("at").cast("bigint").alias("at"))
    if captured is not None:
        kept = captured.select("page_url", F.struct("page_url", "url").alias("id"), "url", "method", "body")
        urls = judged_responses(kept).select("url").distinct()
        from gleanery.functions.urls import without_page_params

        seen = kept.select("page_url", without_page_params(F.col("url")).alias("endpoint"))
        seen = seen.join(urls, F.col("endpoint") == F.col("url"), "left_semi").select("page_url", "endpoint", F.lit(0).alias("of"), F.lit(0).cast("bigint").alias("at"))
        if own:
            seen = seen.join(pages.select(*own, F.col("url").alias("page_url")), "page_url").select(*keys, "endpoint", "of", "at")
        found = found.unionByName(seen)
    one = found.groupBy(*keys, "endpoint").agg(F.min(F.struct("of", "at")).alias("place"))
    order = Window.partitionBy(*keys).orderBy((~F.col("endpoint").rlike(HINTS)).cast("int"), "place", "endpoint")
    return one.select(*keys, "endpoint", F.row_number().over(order).alias("rank"))


def hosted_shop(url: str) -> Blueprint:
    """The fixed catalogue blueprint of the hosted shop platform."""
    from urllib.parse import urlsplit

    p = urlsplit(url)
    offer = "items.0.sellers.0.commertialOffer."
    json_field = lambda n, path: Field(n, path, type="json")
    listed = [("title", "productName"), ("link", "link"), ("image", "items.0.images.0.imageUrl"), ("price", offer + "Price")]
    more = [("description", "description"), ("brand", "brand"), ("reference", "productReference"), ("list_price", offer + "ListPrice"), ("available", offer + "AvailableQuantity")]
    api = Api(endpoint=f"{p.scheme or 'https'}://{p.netloc}/api/catalog_system/pub/products/search/{{search}}?_from=0&_to=49")
    return Blueprint(
        url=url, mode="api", api=api, fields=tuple(json_field(*f) for f in listed), detail_fields=tuple(json_field(*f) for f in more), dedup=True
    )


class ScriptRendered(RuntimeError):
    """A page whose content needs scripts: ``endpoints`` are addresses in it that may hold its data."""

    def __init__(self, url: str, endpoints: list[str]):
        hint = f"; its data may be at {', '.join(hinted(endpoints, SUGGESTED))}" if endpoints else ""
        super().__init__(f"{url} is rendered by scripts: fetch it with a browser{hint}")
        self.url, self.endpoints = url, endpoints


#: records or items from which a list is trusted
TRUSTED = 8


def real_list(root: Node, selector: str, html: str) -> bool:
    """Whether a repeated structure is content, not navigation: any item has a picture, or the page has few scripts."""
    nodes = css.select(root, selector)
    if not nodes or any(css.select(n, "img, picture, [role=img], [style*=background-image]") for n in nodes):
        return True
    return html.lower().count("<script") < 3


def needs_scripts(root: Node, html: str) -> bool:
    """The row-wise twin of ``heuristics.is_script_rendered``."""
    from gleanery.functions import heuristics as h

    low = html.lower()
    shown = len(" ".join(t for n in [root] for t in _shown(n)).encode())
    marks = "|".join((h._APP_SHELL, h._FRAMEWORK, h._LOADING)).split("|")
    return shown < 300 or low.count("<script") >= 3 and shown < 800 or any(m in low for m in marks)


def _shown(n: Node) -> list[str]:
    if n.tag in ("head", "noscript", "script", "style", "template"):
        return []
    return [w for c in n.children for w in (c.split() if isinstance(c, str) else _shown(c))]


def propose(
    url: str, html: str, captured: list[dict] | None = None, rendered: str | None = None, single: bool = False, using: Preset = GENERIC, labels: bool = True
) -> Blueprint:
    """A blueprint for an address from what was fetched of it.

    ``captured`` are responses ``{url, method, body}`` that a browser saw, ``rendered`` the page it made. The order: a
    hosted shop's fixed API; a real list in the page; the richest captured API if it holds at least ``TRUSTED``
    records and the rendered list isn't stable or is under half as long; the rendered list; the API after all. A
    blocked page raises ``BotBlocked``, one that needs scripts without any of these ``ScriptRendered``; any other is one
    item as a whole.
    """
    from gleanery.functions import heuristics as h
    from gleanery.functions.urls import discardable_py
    from gleanery.sources.fetch import BotBlocked, vendor_of

    root = parse(html)
    if len(root.content().strip().encode()) <= 2000:
        vendor = vendor_of(html) or (h.FIREWALL if any(m in html.lower() for m in h._REFUSALS.split("|")) else None)
        if vendor:
            raise BotBlocked(vendor, None, url)
    if single:
        return from_page(url, html, True, using, labels)
    if any(m in html.lower() for m in h._SHOP_MARKS.split("|")):
        return hosted_shop(url)

    def listed(page: Node, text: str) -> str | None:
        found = find_list(page, using)
        return found[0] if found and real_list(page, found[0], text) else None

    own = listed(root, html)
    if own and (len(css.select(root, own)) >= TRUSTED or not needs_scripts(root, html) or not (captured or rendered)):
        return from_page(url, html, False, using, labels)
    page = parse(rendered) if rendered else None
    later = listed(page, rendered) if page is not None else None
    count = len(css.select(page, later)) if later else 0
    best: tuple | None = None
    for r in captured or []:
        usable = r["method"].upper() == "GET" and r["body"] and len(r["body"]) <= 800_000 and not discardable_py(r["url"])
        bp = from_response(r["url"], r["body"], using=using) if usable else None
        if bp is not None:
            import json

            found = record_list(json.loads(r["body"]))
            mine = (len(found["sample"]), found["count"])
            if best is None or mine > best[0]:
                best = (mine, bp, found["count"])
    stable = later is not None and not re.search(r"\.(?:css|emotion|jss|jsx|sc|svelte)-[A-Za-z0-9]{4,}|\._[A-Za-z0-9]{5,}", later)
    if best and best[2] >= TRUSTED and (not stable or best[2] >= 2 * count):
        return best[1]
    if later:
        bp = from_page(url, rendered, False, using, labels)
        from dataclasses import replace

        return bp.but(http=replace(bp.http, render_js=True, transport="browser"))
    if own:
        return from_page(url, html, False, using, labels)
    if best:
        return best[1]
    if needs_scripts(root, html):
        raise ScriptRendered(url, discovered(url, html, captured))
    return from_page(url, html, True, using, labels)


def endpoints_of(url: str, html: str) -> list[str]:
    """The row-wise twin of ``heuristics.endpoints``."""
    from gleanery.functions import heuristics as h
    from gleanery.functions.urls import absolute_py, fetchable_py, host_py

    base = f"{url.split(':')[0]}://{host_py(url)}/"
    whole = [absolute_py(base, u) for p in h._ENDPOINTS for u in re.findall(p, html)]
    return list(dict.fromkeys(u for u in whole if u and fetchable_py(u) and not re.search(h._ASSET, u)))


def safety_cap(bp: Blueprint) -> int:
    """A limit for a run whose sources have quotas: twice their sum, 0 (none) without any."""
    return 2 * sum(s.limit for s in bp.sources)
