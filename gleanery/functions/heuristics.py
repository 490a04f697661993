"""Scores and fingerprints of links, images and pages, as Spark columns with Python twins for the DOM stage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import visible_length
from gleanery.functions.urls import absolute, fetchable

# order within a list doesn't matter: any hit counts
_JUNK_LINKS = """
/about /atom /author/ /categories/ /category/ /contact /feed /followers /following /login /logout /page/ /privacy
/register /rss /search /signin /signup /sitemap /subscribe /tag/ /tags/ /terms /unsubscribe
# ?ref= ?source= facebook.com/sharer javascript: linkedin.com/shareArticle mailto: pinterest.com/pin/ t.co/ tel:
twitter.com/share whatsapp://
""".split()
_GOOD_LINKS = """
/apartamentos/ /article/ /articles/ /carro/ /detail/ /imoveis/ /imovel/ /item/ /items/ /leilao /leiloes /lot/ /lote/ /p/
/post/ /product/ /products/ /veiculo/ /view/
""".split()
_POOR_IMAGES = """
/b.gif /images/b. arrow avatar badge bank-icons bank_icon banner-small blank btn bullet button default facebook favicon
flag icon instagram loading logo missing no-image no_image noimage not-found pixel placeholder rating share social spacer
spinner sprite star twitter whatsapp
""".split()
_RICH_IMAGES = """
asset batch batches big carro file foto full galeria gallery image imagem img imovel large max media original photo pic
picture product produto thumb upload veiculo
""".split()
_SLUG = r"(?i)/[0-9a-z]+(?:-[0-9a-z]+){2,}/?$"
_NUMBER = r"/\d{3,}/?$"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"

#: first match wins, so the order of vendors counts
VENDORS = (
    ("Akamai Bot Manager", "_abck|ak_bmsc|akamai reference|akamai-logo|akamai.com/site|akamaighost|bm-verify|bm_sz|errors.edgesuite.net"),
    ("Cloudflare", "attention required|cf-chl|cf-ray|cf_chl|cloudflare|just a moment"),
    ("PerimeterX / HUMAN", "_pxhd|access to this page has been denied|human challenge|perimeterx|px-captcha"),
    ("DataDome", "datadome|dd-captcha"),
    ("Imperva / Incapsula", "_incapsula_resource|imperva|incapsula"),
    ("AWS WAF", "aws waf|awswaf"),
    ("Sucuri", "cloudproxy|sucuri website firewall"),
    ("Kasada", "kasada|kpsdk"),
)
_REFUSALS = "access denied|are you a robot|bot detected|forbidden|request blocked|unusual traffic|you don't have permission"
FIREWALL = "an anti-bot firewall"
_APP_SHELL = "__initial_state__|__next_data__|__nuxt__|data-reactroot|id=\"app\"|id=\"root\"|ng-app|ng-version|window.__app"
_FRAMEWORK = (
    "/webpack-runtime-|___gatsby|__next_data__|__nuxt__|_next/static|data-reactroot|data-server-rendered|id=\"__next\"|ng-version|"
    "self.__next_f|window.__initial_state__|wp-json"
)
_LOADING = "animate-spin|data-loading|lucide-loader|skeleton-|spinner"
_ENDPOINTS = (
    r"""(?i)["'](/(?:api|graphql|public|rest|v\d)/[\w\-/]*(?:data|finder|items?|list|results?|search)[\w\-/]*)["']""",
    r"""(?i)["'](https?://[^"']+/(?:api|public|rest)/[^"']*(?:finder|items?|list|results?|search)[^"']*)["']""",
    r"""(?i)(?:axios\.(?:get|post)|fetch|url)\s*[:(]\s*["'](https?://[^"']+|/[^"']+)["']""",
    r"""(?i)["'](/?(?:ajax/[\w\-/]+|Api(?:Engine|Features)/(?=[A-Za-z])[\w\-/]+|[\w\-/]*\.aspx/(?=[A-Za-z])\w{2,}))["']""",
)
_ASSET = r"(?i)\.(?:css|gif|ico|jpe?g|js|map|png|svg|webp|woff2?)(?:\?|$)"


def _any(c: Column, words) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def link_score(href: Column) -> Column:
    """How much a link looks like one to an item: -200 (none) to 120."""
    low, path = F.lower(href), F.regexp_extract(href, _PATH, 1)
    add = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0))
    score = (
        add(_any(low, _GOOD_LINKS), 60) + add(path.rlike(_SLUG), 30) + add(path.rlike(_NUMBER), 20)
        + add(~href.rlike("(?i)^https?://"), 10) - add(low.contains("utm_"), 5)
    )
    # the list is matched in lower case, so its one entry with a capital never hits
    junk = _any(low, _JUNK_LINKS)
    return F.when((href == "") | href.startswith("#"), -200).when(junk, -100).when(href.startswith("?"), -50).otherwise(score)


def link_score_py(href: str) -> int:
    if not href or href.startswith("#"):
        return -200
    low = href.lower()
    if any(w in low for w in _JUNK_LINKS):
        return -100
    if href.startswith("?"):
        return -50
    path = re.match(_PATH, href)[1]
    score = 60 * any(w in low for w in _GOOD_LINKS) + 30 * bool(re.search(_SLUG, path)) + 20 * bool(re.search(_NUMBER, path))
    return score + 10 * (not re.match("(?i)https?://", href)) - 5 * ("utm_" in low)


def image_score(url: Column) -> Column:
    """-100 for decoration, 50 for pictures, 0 for others, by the URL's path."""
    path = F.lower(F.regexp_extract(url, _PATH, 1))
    return F.when(_any(path, _POOR_IMAGES), -100).when(_any(path, _RICH_IMAGES), 50).otherwise(0)


def image_score_py(url: str) -> int:
    path = re.match(_PATH, url)[1].lower()
    return -100 if any(w in path for w in _POOR_IMAGES) else 50 if any(w in path for w in _RICH_IMAGES) else 0


def best_image(urls: Column) -> Column:
    """The first of the best-scored non-empty URLs of an array."""
    some = F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != "")
    ranked = F.transform(some, lambda u, i: F.struct(image_score(u).alias("score"), (-i).alias("first"), u.alias("url")))
    return F.array_max(ranked)["url"]


def unstable_selector(css: Column) -> Column:
    """Whether a selector uses class names that a build tool made up."""
    return F.coalesce(css.rlike(r"\.(?:css|sc|jsx|jss|emotion|svelte)-[A-Za-z0-9]{4,}|\.[A-Za-z]+_[A-Za-z]+__[A-Za-z0-9_-]{5,}|\._[A-Za-z0-9]{5,}"), F.lit(False))


def bot_vendor(body: Column, status: Column | None = None) -> Column:
    """Who blocks the response, null if nobody; wordings alone count only with status 403, 429 or 503."""
    low = F.lower(body)
    named = reduce(lambda c, v: c.when(_any(low, v[1].split("|")), v[0]), VENDORS[1:], F.when(_any(low, VENDORS[0][1].split("|")), VENDORS[0][0]))
    if status is None:
        return named
    return F.coalesce(named, F.when(status.isin(403, 429, 503) & _any(low, _REFUSALS.split("|")), FIREWALL))


def rendered_block(html: Column) -> Column:
    """Like ``bot_vendor`` for a rendered page: none with over 2000 bytes of text, and wordings always count."""
    text = F.btrim(F.regexp_replace(html, r"(?s)<[^>]*>", ""), F.lit(" \t\n\r\0\x0b"))
    named = F.coalesce(bot_vendor(html), F.when(_any(F.lower(html), _REFUSALS.split("|")), FIREWALL))
    return F.when(F.octet_length(text) <= 2000, named)


def is_app_shell(html: Column) -> Column:
    """Whether a page is the shell of a script application."""
    low = F.lower(html)
    return _any(low, _APP_SHELL.split("|")) | ((F.size(F.split(low, "<script")) - 1 >= 3) & (visible_length(html) < 800))


def is_script_rendered(html: Column) -> Column:
    """Whether a page's content seems to need scripts."""
    low = F.lower(html)
    return is_app_shell(html) | (visible_length(html) < 300) | _any(low, _FRAMEWORK.split("|")) | _any(low, _LOADING.split("|"))


def endpoints(base: Column, html: Column) -> Column:
    """Distinct absolute addresses of likely data endpoints in a page, by pattern and place."""
    root = F.regexp_replace(base, r"^([A-Za-z][\w+.-]*://(?:[^/?#@]*@)?)([^/?#:]+).*$", "$1$2/")
    found = F.flatten(F.array(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in _ENDPOINTS]))
    whole = F.transform(found, lambda u: absolute(root, u))
    return F.array_distinct(F.filter(whole, lambda u: fetchable(u) & ~u.rlike(_ASSET)))


_SHOP_MARKS = "/api/catalog_system/|/api/vtex|__runtime__|vtex.com.br|vtexassets.com|vtexcommercestable|vteximg.com.br"


def is_hosted_shop(html: Column) -> Column:
    """Whether a page carries the marks of the hosted shop platform that has a fixed catalogue API."""
    return _any(F.lower(html), _SHOP_MARKS.split("|"))


def image_kind(data: Column) -> Column:
    """File extension of image bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("47494638"), "gif").when(head.startswith("52494646") & head.contains("57454250"), "webp").otherwise("jpg")


def image_name(url: Column, data: Column, hashed: bool = False) -> Column:
    """File name for stored image bytes: the hash of the bytes, or the URL's file name made safe."""
    path = F.regexp_extract(url, _PATH, 1)
    base = F.regexp_extract(F.rtrim(path, F.lit("/")), r"([^/]*)$", 1)
    named = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    suffix = F.concat(F.lit("."), F.when(named.rlike("^[a-z0-9]{2,5}$"), named).otherwise(image_kind(data)))
    safe = F.regexp_replace(base, "[^A-Za-z0-9._-]", "_")
    return F.concat(F.sha1(data), suffix) if hashed else F.when(safe.isin("", "_"), F.concat(F.sha1(url.cast("binary")), suffix)).otherwise(safe)
