"""The engine's operators as queries over the test tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.batches import give_back, small_batches, spread, swept
from gleanery.columns import ITEM, PAGE_URL
from gleanery.dom.extract import label_values, markdown, select_all
from gleanery.functions import coerce, heuristics, jsonpath, text, urls
from gleanery.operators import filters, images, pipeline, shape, sink
from gleanery.plans import infer, run
from gleanery.plans.blueprint import Api, ApiDetail, Blueprint, Field, InfiniteScroll, Output, Pagination, Rule, Source
from gleanery.sinks import emit, export
from gleanery.sources import guard, requests
from gleanery.sources import pages as page_sources
from gleanery.streaming.incremental import event_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ARTICLES = Blueprint(url="https://example.com/", item_selector="article", fields=(Field("title", "h1"), Field("paragraphs", "p", multiple=True)))


@_query("SELECT url AS page_url, trim(regexp_replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf_dir):
    """Scan, item generator, CSS fields, trim."""
    return run.all_pages(_ARTICLES, _t(spark, sf_dir, "pages")).select(F.col(PAGE_URL).alias("page_url"), "title")


@_query("""
    WITH a AS (
        SELECT url, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a></li>', 1) AS words FROM pages
    ), b AS (SELECT url, unnest(hrefs) AS href, unnest(words) AS word, generate_subscripts(hrefs, 1) - 1 AS item_ord FROM a)
    SELECT url AS page_url, item_ord::BIGINT AS item_ord, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' || trim(replace(href, '&amp;', '&'), '/') AS link,
        trim(replace(word, '&amp;', '&')) AS word FROM b
""")
def page_links(spark, sf_dir):
    """Items in document order, attributes, absolute URLs."""
    bp = Blueprint(item_selector="nav ul li a", fields=(Field("link", "", "href"), Field("word", "")))
    return run.all_pages(bp, _t(spark, sf_dir, "pages")).select(F.col(PAGE_URL).alias("page_url"), F.col(ITEM).alias("item_ord"), "link", "word")


@_query("""
    SELECT url AS page_url, trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&')) AS by_path,
        nullif(regexp_extract(regexp_extract(html, '<h1>(.*?)</h1>', 1), '(\\w+) ', 1), '') AS first_word
    FROM pages
""")
def page_xpath_regex(spark, sf_dir):
    """XPath fields and regex capture."""
    bp = Blueprint(fields=(Field("by_path", "//head/title", type="xpath"), Field("first_word", "h1", regex=r"/([A-Za-z0-9_]+) /")))
    return run.all_pages(bp, _t(spark, sf_dir, "pages")).select(F.col(PAGE_URL).alias("page_url"), "by_path", "first_word")


@_query()
def page_markdown(spark, sf_dir):
    """HTML to Markdown with resolved links."""
    return _t(spark, sf_dir, "pages").select("page_id", markdown()("url", "html").alias("md"))


@_query("""
    SELECT page_id, l.label, l.value FROM (
        SELECT page_id, unnest([
            {'label': 'Host', 'value': regexp_extract(url, '://([^/?#:]+)', 1)}, {'label': 'Page', 'value': 'no. ' || page_id}, {'label': 'Code', 'value': 'C' || page_id % 7},
            {'label': 'Size', 'value': page_id % 40 || ' m'}, {'label': 'State', 'value': 'new'}
        ]) AS l FROM pages
    )
""")
def page_labels(spark, sf_dir):
    """Label and value harvest: a definition list, a table, bold labels, plain lines and label classes added to every page."""
    n = F.col("page_id")
    parts = [
        F.lit("<dl><dt>Host:</dt><dd>"), F.regexp_extract("url", "://([^/?#:]+)", 1), F.lit("</dd></dl><table><tr><th>Page</th><td> no. "), n.cast("string"), F.lit("</td></tr></table><p><b>Code:</b> C"),
        (n % 7).cast("string"), F.lit("</p><p>Size: "), (n % 40).cast("string"), F.lit(" m</p><div><span class='label'>State</span><span class='value'>new</span><span>x</span></div><p>host: again</p>"),
    ]
    html = F.concat(F.col("html"), F.lit("<section>"), *parts, F.lit("</section>"))
    got = _t(spark, sf_dir, "pages").select("page_id", F.explode(label_values()("url", html)).alias("p"))
    return got.select("page_id", "p.label", "p.value")


@_query("SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages")
def page_inspection(spark, sf_dir):
    """Selector inspection: how many links a page has."""
    return _t(spark, sf_dir, "pages").select("page_id", F.size(select_all("a", "href")("url", "html")).cast("bigint").alias("n_links"))


@_query("""
    SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS host, true AS fetchable,
        regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/img/p.jpg' AS rooted,
        regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/[^/]*$', '') || '/x.html' AS beside,
        regexp_extract(url, '^([a-z]+)://', 1) || '://cdn.example.com/a' AS cdn
    FROM pages
""")
def page_urls(spark, sf_dir):
    """URL resolution, host, fetchable."""
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select(
        "page_id", urls.host(u).alias("host"), urls.fetchable(u).alias("fetchable"), urls.absolute(u, F.lit("/img//./q/../p.jpg")).alias("rooted"),
        urls.absolute(u, F.lit(" x.html")).alias("beside"), urls.absolute(u, F.lit("//cdn.example.com/a")).alias("cdn"),
    )


@_query("""
    SELECT page_id, (CASE WHEN contains(url, '#') OR contains(url, '/page/') OR contains(lower(url), '/search') OR contains(url, '?ref=') THEN -100 ELSE
        (CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/[0-9]{3,}/?$') THEN 20 ELSE 0 END)
        - (CASE WHEN contains(url, 'utm_') THEN 5 ELSE 0 END) END)::INTEGER AS score,
        regexp_replace(regexp_replace(regexp_replace(url, '\\?page=[^&#]*', '?'), '\\?&', '?'), '[?]$', '') AS plain
    FROM pages
""")
def page_link_scores(spark, sf_dir):
    """Link quality and paging parameters."""
    return _t(spark, sf_dir, "pages").select("page_id", heuristics.link_score(F.col("url")).alias("score"), urls.without_page_params(F.col("url"), ("page",)).alias("plain"))


@_query("""
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN -100 WHEN p_size % 3 = 1 THEN 50 ELSE 0 END AS score,
        CASE WHEN p_size % 3 = 1 THEN '/photo/a.jpg' ELSE '/q/b.jpg' END AS best
    FROM part
""")
def part_image_scores(spark, sf_dir):
    """Image quality and best image."""
    kind = F.when(F.col("p_size") % 3 == 0, "/logo/a.jpg").when(F.col("p_size") % 3 == 1, "/photo/a.jpg").otherwise("/z/a.jpg")
    url = F.concat(F.lit("https://icon.example.com"), kind)
    best = heuristics.best_image(F.array(F.lit("/q/b.jpg"), kind))
    return _t(spark, sf_dir, "part").select("p_partkey", heuristics.image_score(url).alias("score"), best.alias("best"))


@_query("""
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '/photo/' || p_partkey ELSE '/g/1' END AS primary_image,
        CASE WHEN p_size % 2 = 0 THEN '/photo/' || p_partkey || ',/logo/1,/g/1' ELSE '/logo/' || p_partkey || ',/g/1,/logo/1' END AS every
    FROM part
""")
def part_images(spark, sf_dir):
    """Primary, gallery and all images."""
    df = _t(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "/photo/").otherwise("/logo/"), F.col("p_partkey").cast("string")).alias("image"),
        F.array(F.lit("/logo/1"), F.lit("/g/1")).alias("images"),
    )
    return images.shape(df, True, True, True).select("p_partkey", "primary_image", F.array_join("all_images", ",").alias("every"))


@_query("""
    SELECT event_id, value AS as_float, event_id AS as_int, event_type = 'purchase' AS as_bool, event_id::DOUBLE + 0.5 AS comma FROM events
""")
def event_coercion(spark, sf_dir):
    """Schema coercion."""
    value, number = F.col("value").cast("string"), F.col("event_id").cast("string")
    return _t(spark, sf_dir, "events").select(
        "event_id", coerce.to_float(F.concat(F.lit("US$ "), F.col("value").cast("decimal(20,6)").cast("string"))).alias("as_float"),
        coerce.to_int(F.concat(F.lit("no. "), number, F.lit(" x"))).alias("as_int"), coerce.to_bool(F.when(F.col("event_type") == "purchase", " SIM ").otherwise(value)).alias("as_bool"),
        coerce.to_float(F.concat(number, F.lit(",50 EUR"))).alias("comma"),
    )


@_query("""
    SELECT event_id, event_type <> '' AS f1, event_type = '' AS f2, contains(event_type, 'c') AS f3, NOT contains(event_type, 'c') AS f4,
        event_type = 'error' AS f5, event_type <> 'error' AS f6, regexp_matches(event_type, '(?i)^S|R$') AS f7, value > 100.5 AS f8, value < 20 AS f9,
        true AS f10, false AS f11, true AS f12
    FROM events
""")
def event_filters(spark, sf_dir):
    """Every filter operator."""
    df = _t(spark, sf_dir, "events")
    rules = [
        Rule("event_type"), Rule("event_type", "empty"), Rule("event_type", "contains", "c"), Rule("event_type", "not_contains", "c"), Rule("event_type", "equals", "error"),
        Rule("event_type", "not_equals", "error"), Rule("event_type", "matches", "/^S|R$/i"), Rule("value", "gt", "100.5"), Rule("value", "lt", "20"),
        Rule("event_type", "like", "x"), Rule("event_type", "matches", "(broken"), Rule("missing", "empty"),
    ]
    return df.select("event_id", *[filters.condition(df, r).alias(f"f{i}") for i, r in enumerate(rules, 1)])


_FEED = "SELECT 0 AS source_ord, 0 AS page_ord, event_id AS item_ord, user_id, event_type, value FROM events"


def _feed(spark, sf_dir) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return _t(spark, sf_dir, "events").select(zero.alias("source_ord"), zero.alias("page_ord"), F.col("event_id").alias("item_ord"), F.col("user_id").cast("string").alias("user_id"), "event_type", "value")


@_query(f"""
    WITH j AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_ord) AS nth FROM ({_FEED}))
    SELECT item_ord, user_id::VARCHAR AS user_id, event_type FROM j WHERE nth = 1 AND event_type <> 'error'
""")
def item_dedup_filter(spark, sf_dir):
    """First-wins dedup before filters."""
    return sink.accept(_feed(spark, sf_dir), "user_id", (Rule("event_type", "not_equals", "error"),)).select("item_ord", "user_id", "event_type")


@_query(f"""
    WITH j AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_ord) AS nth FROM ({_FEED}))
    SELECT item_ord, user_id::VARCHAR AS user_id FROM j WHERE nth = 1 AND value > 50 ORDER BY item_ord LIMIT 20
""")
def item_limit(spark, sf_dir):
    """Ordered limit of kept items."""
    return sink.accept(_feed(spark, sf_dir), "user_id", (Rule("value", "gt", "50"),), limit=20).select("item_ord", "user_id")


@_query("""
    WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type = 'click'),
    ka AS (SELECT * FROM a WHERE nth = 1 ORDER BY event_id LIMIT 5),
    b AS (
        SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events
        WHERE event_type <> 'click' AND user_id NOT IN (SELECT user_id FROM ka)
    )
    SELECT 0::BIGINT AS source_ord, event_id AS item_ord, user_id::VARCHAR AS user_id FROM ka
    UNION ALL SELECT 1, event_id, user_id::VARCHAR FROM b WHERE nth = 1
""")
def item_quotas(spark, sf_dir):
    """Per-source quota: keys beyond it stay free for the next source. Clicks are one source, all other events the second."""
    df = _feed(spark, sf_dir).withColumn("source_ord", F.when(F.col("event_type") == "click", 0).otherwise(1).cast("bigint"))
    return sink.accept(df, "user_id", quotas={0: 5}).select("source_ord", "item_ord", "user_id")


@_query(f"SELECT item_ord FROM ({_FEED}) WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def item_resume(spark, sf_dir):
    """Anti join with the keys of earlier runs."""
    seen = _t(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("key"))
    return sink.unseen(_feed(spark, sf_dir), "user_id", seen).select("item_ord")


@_query(f"""
    WITH j AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_ord) AS nth FROM ({_FEED}))
    SELECT 1::BIGINT AS pages_fetched, 0::BIGINT AS pages_failed, count(*) AS items_found, count(*) FILTER (nth > 1) AS items_deduped,
        count(*) FILTER (nth = 1 AND event_type = 'error') AS items_filtered, count(*) FILTER (nth = 1 AND event_type <> 'error') AS items_scraped,
        0::BIGINT AS details_fetched, 0::BIGINT AS details_failed, 0::BIGINT AS images_saved, 2::BIGINT AS images_failed,
        (SELECT count(*) FROM customer) AS cache_hits, 0::BIGINT AS cache_misses, 12.5::DOUBLE AS elapsed_s, round(items_scraped / 12.5::DOUBLE, 1) AS items_per_s
    FROM j
""")
def run_statistics(spark, sf_dir):
    """Run counters."""
    judged = sink.judged(_feed(spark, sf_dir), "user_id", (Rule("event_type", "not_equals", "error"),))
    return run.statistics(judged, 12.5, pages_fetched=1, images_failed=2, cache_hits=_t(spark, sf_dir, "customer").count())


_EVENTS_API = Blueprint(
    url="https://api.example.com/", mode="api",
    api=Api(endpoint="https://api.example.com/events", items_path="data.results", page_param="page", detail=ApiDetail(True, "https://api.example.com/users/{user}", items_path="user")),
    fields=(Field("id", "event.id", type="json"), Field("user", "user", type="json"), Field("k", "props.k", type="json"), Field("kinds", "kinds.0", multiple=True, type="json")),
    sources=(Source("a", {"feed": "all"}),), item_schema={"id": "int", "k": "int"},
)


def _responses(spark, sf_dir, size: int = 100) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("page_ord", F.floor(F.col("event_id") / size).cast("bigint"))
    row = F.struct(
        F.col("event_id").alias("at"), F.struct(F.col("event_id").alias("id")).alias("event"), F.col("user_id").alias("user"),
        F.from_json("props", "k bigint").alias("props"), F.array("event_type").alias("kinds"),
    )
    body = F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(row)).alias("results")).alias("data")))
    return e.groupBy("page_ord").agg(body.alias("body")).select(F.lit(0).cast("bigint").alias("source_ord"), "page_ord", "body")


@_query("""
    SELECT event_id AS id, user_id::VARCHAR AS user, (json_extract_string(props, '$.k'))::BIGINT AS k, event_type AS kind, 'all' AS feed FROM events
""")
def api_items(spark, sf_dir):
    """JSON scan, paths, fields, tags, coercion, pages."""
    got = run.run_api(spark, _EVENTS_API, _responses(spark, sf_dir))
    return got.select("id", "user", "k", F.array_join("kinds", ",").alias("kind"), "feed")


@_query("SELECT event_id AS id, source::BIGINT AS source FROM events, (SELECT unnest([0, 1, 2]) AS source)")
def api_page_cuts(spark, sf_dir):
    """A source ends before an equal payload, before an empty page and before what isn't JSON: three sources of all events, and pages beyond."""
    r = _responses(spark, sf_dir)
    last = r.agg(F.max("page_ord")).first()[0]
    at = lambda df, source, page: df.select(F.lit(source).cast("bigint").alias("source_ord"), F.lit(page).cast("bigint").alias("page_ord"), "body")
    first, end = r.where("page_ord = 0"), r.where(F.col("page_ord") == last)
    empty, broken = (spark.createDataFrame([(b,)], "body string") for b in ('{"data": {"results": []}}', "<html>"))
    parts = [r.withColumn("source_ord", F.lit(s).cast("bigint")) for s in range(3)]
    parts += [at(x, s, last + 1) for s, x in enumerate((end, empty, broken))] + [at(first, s, last + 2) for s in range(3)]
    bp = _EVENTS_API.but(sources=tuple(Source(str(s), {"source": s}) for s in range(3)))
    return run.run_api(spark, bp, run.combine(parts)).select("id", F.col("source").cast("bigint").alias("source"))


@_query("""
    SELECT event_id AS total, user_id::VARCHAR AS page_url, event_type AS item_ord, 'e' || event_id AS _first, 'x' AS source_ord, value AS _kept FROM events
""")
def fields_of_any_name(spark, sf_dir):
    """Fields named like columns of the engine, over all events."""
    e = _t(spark, sf_dir, "events").withColumn("page_ord", F.floor(F.col("event_id") / 100).cast("bigint"))
    row = F.struct(
        F.col("event_id").alias("total"), F.col("user_id").alias("page_url"), F.col("event_type").alias("item_ord"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("_first"),
        F.lit("x").alias("source_ord"), F.col("value").alias("_kept"),
    )
    body = F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("r")))
    pages = e.groupBy("page_ord").agg(body.alias("body")).select(F.lit(0).cast("bigint").alias("source_ord"), "page_ord", "body")
    names = ("total", "page_url", "item_ord", "_first", "source_ord", "_kept")
    bp = Blueprint(
        url="https://api.example.com/", mode="api", api=Api(endpoint="https://api.example.com/e", items_path="r", page_param="page"),
        fields=tuple(Field(n, n, type="json") for n in names), item_schema={"total": "int", "_kept": "float"}, dedup=True, dedup_key="total",
    )
    return run.run_api(spark, bp, pages).select(*names)


@_query("""
    SELECT event_id AS id, user_id::VARCHAR AS user, c_name AS name, c_mktsegment AS segment FROM events LEFT JOIN customer ON user_id = c_custkey AND c_nationkey < 12
""")
def api_details(spark, sf_dir):
    """Details merged by a filled-in address, items without one kept."""
    bp = _EVENTS_API.but(detail_fields=(Field("name", "name", type="json"), Field("segment", "tags.0", type="json")))
    c = _t(spark, sf_dir, "customer").where("c_nationkey < 12")
    user = F.struct(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags"))
    details = c.select(F.concat(F.lit("https://api.example.com/users/"), F.col("c_custkey").cast("string")).alias("url"), F.to_json(F.struct(user.alias("user"))).alias("body"))
    return run.run_api(spark, bp, _responses(spark, sf_dir), details).select("id", "user", "name", "segment")


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS none FROM events")
def json_paths(spark, sf_dir):
    """Dotted paths over JSON text."""
    doc = jsonpath.parse(F.col("props"))
    return _t(spark, sf_dir, "events").select("event_id", jsonpath.field(doc, "k").alias("k"), jsonpath.field(doc, "k.0.x").alias("none"))


def _shop(spark, sf_dir) -> DataFrame:
    """A list page a region and a detail page a nation, as fetched pages."""
    n = _t(spark, sf_dir, "nation")
    link = F.concat(F.lit("<div class='card item'><a href='n/"), F.col("n_nationkey").cast("string"), F.lit("'>"), F.col("n_name"), F.lit("</a></div>"))
    lists = n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n_nationkey", link.alias("h")))).getField("h"), "").alias("html"))
    more = F.when(F.col("n_regionkey") < 4, F.concat(F.lit("<a rel='next' href='/r"), (F.col("n_regionkey") + 1).cast("string"), F.lit("'>next</a>"))).otherwise("<a rel='next' href='/r0'>")
    lists = lists.select(F.concat(F.lit("https://shop.example.com/r"), F.col("n_regionkey").cast("string")).alias("url"), F.concat("html", more).alias("html"))
    detail = F.concat(F.lit("<h1>Nation "), F.col("n_nationkey").cast("string"), F.lit("</h1><p><b>Region:</b> "), F.col("n_regionkey").cast("string"), F.lit("</p>"))
    details = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("https://shop.example.com/n/"), F.col("n_nationkey").cast("string")).alias("url"), detail.alias("html"))
    return lists.unionByName(details)


_SHOP = Blueprint(
    url="https://shop.example.com/r0", item_selector=".card", fields=(Field("link", "a", "href"), Field("name", "a")), pagination=Pagination("next_link", "a[rel=next]"),
    scrape_detail=True, detail_link_field="link", detail_fields=(Field("title", "h1"), Field("region", label="Region")), dedup=True,
)


@_query("""
    SELECT 'https://shop.example.com/n/' || n_nationkey AS link, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Nation ' || n_nationkey END AS title,
        CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR END AS region FROM nation
""")
def html_run(spark, sf_dir):
    """A whole HTML run: next links, items, details, labels, dedup."""
    return run.run_html(spark, _SHOP, _shop(spark, sf_dir))


@_query("SELECT 0::BIGINT AS source_ord, range::BIGINT AS page_ord, 'https://shop.example.com/r' || range AS url FROM range(3)")
def page_chain(spark, sf_dir):
    """Next links up to the page cap."""
    return page_sources.page_list(spark, _SHOP.but(max_pages=3), _shop(spark, sf_dir))


@_query("SELECT 0::BIGINT AS source_ord, 0::BIGINT AS page_ord, 'https://shop.example.com/r2' AS url UNION ALL SELECT 0, row_number() OVER (ORDER BY n_nationkey), 'https://shop.example.com/n/' || n_nationkey FROM nation WHERE n_regionkey = 2")
def page_link_list(spark, sf_dir):
    """The start page, then the pages it lists."""
    bp = _SHOP.but(url="https://shop.example.com/r2", pagination=Pagination("link_list", ".card a"))
    return page_sources.page_list(spark, bp, _shop(spark, sf_dir))


@_query("SELECT n_name AS name FROM nation")
def infinite_scroll(spark, sf_dir):
    """Fragments by offset, ended by an equal payload after the last of all nations."""
    n = _t(spark, sf_dir, "nation")
    item = F.concat(F.lit("<div class='card'><a href='/"), F.col("n_nationkey").cast("string"), F.lit("'>"), F.col("n_name"), F.lit("</a></div>"))
    batch = n.groupBy((F.floor(F.col("n_nationkey") / 5) * 5).cast("bigint").alias("value")).agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("html"))
    start = batch.where("value = 0").select(F.lit("https://scroll.example.com/").alias("url"), "html")
    rest = batch.where("value > 0").unionByName(batch.where("value = 20").withColumn("value", F.lit(25).cast("bigint")))
    rest = rest.unionByName(batch.where("value = 5").withColumn("value", F.lit(30).cast("bigint")))
    bp = Blueprint(url="https://scroll.example.com/", item_selector=".card", fields=(Field("name", "a"),), infinite_scroll=InfiniteScroll(page_size=5, start=5))
    return run.run_html(spark, bp, start, scrolled=rest)


@_query("""
    SELECT n_nationkey, 'https://a.example.com/s?x=1&q=' || n_nationkey AS by_query, 'https://a.example.com/s/n/' || n_nationkey AS by_path,
        'https://a.example.com/api/n/' || n_nationkey || '?z=1' AS by_endpoint FROM nation
""")
def source_urls(spark, sf_dir):
    """Addresses of sources."""
    key = F.col("n_nationkey").cast("string")
    return _t(spark, sf_dir, "nation").select(
        "n_nationkey", urls.source_url(F.lit("https://a.example.com/s?x=1"), F.concat(F.lit("q="), key)).alias("by_query"),
        urls.source_url(F.lit("https://a.example.com/s/"), F.concat(F.lit("/n/"), key)).alias("by_path"),
        urls.endpoint_url(F.lit("https://a.example.com/api/{search}?z=1"), F.concat(F.lit("/n/"), key, F.lit("/"))).alias("by_endpoint"),
    )


@_query("""
    SELECT s.range::BIGINT AS source_ord, p.range::BIGINT AS page_ord, 'https://a.example.com/x/' || chr((97 + s.range)::INTEGER) AS url,
        '[(''limit'', 20), (''offset'', ' || p.range * 20 || '), (''size'', ''50'')]' AS query FROM range(2) s, range(3) p
""")
def request_plan(spark, sf_dir):
    """Requests of every source and page."""
    api = Api(endpoint="https://a.example.com/x?size=50", page_param="offset", page_size_param="limit", page_size=20)
    rows = [(r["source_ord"], r["page_ord"], r["url"], str(sorted(r["query"].items()))) for r in requests.plan(api, (Source("a"), Source("b")), 3)]
    return spark.createDataFrame(rows, "source_ord bigint, page_ord bigint, url string, query string")


@_query("""
    WITH p AS (SELECT page_id, html || repeat('<script src="/x.js"></script>', page_id % 5) AS html FROM pages),
    t AS (
        SELECT page_id, lower(html) AS low,
            regexp_replace(html, '(?is)<(script|style|noscript|template)\\b[^>]*>.*?</(script|style|noscript|template)\\s*>', ' ', 'g') AS bare FROM p
    )
    SELECT page_id, len(regexp_split_to_array(low, '<script')) - 1 >= 3 AND strlen(trim(regexp_replace(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) < 800 AS shell,
        CASE WHEN page_id % 3 = 0 THEN 'Cloudflare' END AS vendor FROM t
""")
def page_fingerprints(spark, sf_dir):
    """Script shells and bot protection, with up to four more scripts in each page and a mark in every third."""
    more = F.repeat(F.lit('<script src="/x.js"></script>'), (F.col("page_id") % 5).cast("int"))
    h = F.concat("html", more, F.when(F.col("page_id") % 3 == 0, "<!-- cf-ray: 1 -->").otherwise(""))
    return _t(spark, sf_dir, "pages").select("page_id", heuristics.is_app_shell(h).alias("shell"), heuristics.bot_vendor(h).alias("vendor"))


_HOSTS = (
    ("localhost", "127.0.0.1"), ("2130706433", "127.0.0.1"), ("127.1", "127.0.0.1"), ("[::ffff:169.254.169.254]", "169.254.169.254"), ("[::ffff:172.16.0.1]", "172.16.0.1"),
    ("[0:0:0:0:0:0:0:1]", "::1"), ("0x7f.0.0.1", "127.0.0.1"), ("0177.0.0.1", "127.0.0.1"), ("[fe80::1%25eth0]", "fe80::1"), ("[fd00::1]", "fd00::1"), ("192.168.1.1.", "192.168.1.1"),
    ("172.31.255.255", "172.31.255.255"), ("172.32.0.1", None), ("1.1.1.1", None), ("16843009", None), ("[2606:4700:4700::1111]", None), ("user@10.0.0.9:80", "10.0.0.9"), ("", "no host"),
    ("allowed.internal", None), ("example.com", None),
)


@_query(f"""
    WITH h AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{b or ''}')" for i, (_, b) in enumerate(_HOSTS))}) AS h(i, bad))
    SELECT page_id, bad AS host_case, CASE WHEN page_id % 7 = 0 THEN 'not a web address (scheme ''ftp'')' WHEN bad = 'no host' THEN bad WHEN bad <> '' THEN 'private address ' || bad END AS reason
    FROM pages JOIN h ON page_id % {len(_HOSTS)} = i
""")
def url_guard(spark, sf_dir):
    """Which addresses may be fetched: hosts written in every way, on the paths of all pages."""
    at = F.col("page_id") % len(_HOSTS)
    host, bad = (F.element_at(F.array(*[F.lit(h[k] or "") for h in _HOSTS]), (at + 1).cast("int")) for k in (0, 1))
    scheme = F.when(F.col("page_id") % 7 == 0, "ftp").otherwise("http")
    u = F.concat(scheme, F.lit("://"), host, F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1))
    u = F.when(host == "", F.concat(scheme, F.lit(":///x"))).otherwise(u)
    return _t(spark, sf_dir, "pages").select("page_id", bad.alias("host_case"), guard.refused(u, True, ("allowed.internal",)).alias("reason"))


@_query("""
    SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS field, p_brand || ' ' || p_type AS squashed FROM part
""")
def part_text(spark, sf_dir):
    """Field names and squashed whitespace."""
    return _t(spark, sf_dir, "part").select("p_partkey", text.field_name(F.concat(F.lit(" "), F.col("p_name"), F.lit(": "))).alias("field"), text.squash(F.concat(F.lit("\t"), F.col("p_brand"), F.lit(" \n "), F.col("p_type"))).alias("squashed"))


@_query("""
    SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","note":null}' AS json,
        s_suppkey || ',' || s_name || ',' || chr(34) || 'a ' || chr(34) || chr(34) || 'b' || chr(34) || chr(34) || chr(34) AS csv FROM supplier
""")
def export_lines(spark, sf_dir):
    """JSON lines and CSV lines."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("string").alias("note"))
    c = export.cells(s.withColumn("note", F.lit('a "b"')))
    j = s.select("s_suppkey", export.json_lines(s).alias("json"))
    return j.join(c.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), export.csv_line(c).alias("csv")), "s_suppkey")


@_query("SELECT '## ' || p_name || chr(10) || chr(10) || '- **p_brand:** ' || p_brand || chr(10) || '- **p_size:** ' || p_size AS md FROM part")
def export_markdown(spark, sf_dir):
    """Markdown sections."""
    p = _t(spark, sf_dir, "part").select(F.col("p_name").alias("title"), "p_brand", "p_size")
    return p.select(export.markdown_section(p, F.lit(0)).alias("md"))


@_query("SELECT n_name AS a_name, n_regionkey AS tags_0, n_nationkey AS tags_1, n_nationkey AS id FROM nation")
def output_shape(spark, sf_dir):
    """Exclude, rename, flatten."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name")).alias("a"), F.array("n_regionkey", "n_nationkey").alias("tags"), F.lit(1).alias("gone"))
    return shape.shaped(n, Output(flatten=True, exclude=("gone",), rename={"key": "id"}))


@_query("""
    SELECT c_custkey, coalesce(o.total, c_acctbal) AS c_acctbal, c_name FROM customer
    LEFT JOIN (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey
""")
def upsert(spark, sf_dir):
    """Rows put over those of equal key, the last one winning."""
    old = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")
    new = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("at"))
    return export.upserted(old, new, ("c_custkey",), ("at",))


@_query("""
    SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL
""")
def event_windows(spark, sf_dir):
    """Windowed counts, as the streaming job makes them."""
    got = event_counts(_t(spark, sf_dir, "events"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@_query("""
    WITH g AS (SELECT event_type, list(least(greatest(value, 20.0), 30000.0)::DOUBLE ORDER BY event_id) AS goals, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY event_type),
    f AS (
        SELECT event_type, ids, list_reduce(list_prepend([0.0::DOUBLE], list_transform(goals, lambda x: [x])), lambda d, g: list_append(d, (d[len(d)] + g[1]) / 2)) AS folded FROM g
    )
    SELECT event_type AS host, unnest(ids) AS at, round(unnest(folded[2:]), 6) AS delay_ms FROM f
""")
def throttle(spark, sf_dir):
    """Delays after each response of a host, folded in order."""
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("host"), F.col("event_id").alias("at"), F.col("value").alias("latency_ms"))
    return run.throttled(e, 20.0).select("host", "at", F.round("delay_ms", 6).alias("delay_ms"))


@_query("""
    WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch(date_trunc('second', ts)) AS s FROM events),
    r AS (
        SELECT user_id, n, s, s AS since, false AS hit FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, e.s, CASE WHEN e.s - r.since < 3600 THEN r.since ELSE e.s END, e.s - r.since < 3600 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1
    )
    SELECT user_id::VARCHAR AS url, s::DOUBLE AS "at", hit FROM r
""")
def cache_replay(spark, sf_dir):
    """Which requests a cache with a fixed lifetime answers."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return page_sources.replayed(e, 3600)


@_query("""
    SELECT 'https://api.example.com/orders' AS url, 'data.rows' AS path, 4::BIGINT AS n_fields, least(count(*), 200)::BIGINT AS n_records FROM orders
""")
def best_api_response(spark, sf_dir):
    """The richest captured response: of orders, customers and a build file with more fields, in pages of 200 records each."""
    def captured(table: str, key: str, columns: list, url: str):
        rows = _t(spark, sf_dir, table).withColumn("at", F.floor((F.col(key) - 1) / 200).cast("bigint"))
        body = F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows")).alias("data")))
        return rows.groupBy("at").agg(body.alias("body")).select(F.concat(F.lit(url), F.lit("?page="), F.col("at").cast("string")).alias("url"), F.lit("get").alias("method"), "body")

    o = captured("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], "https://api.example.com/orders")
    c = captured("customer", "c_custkey", ["c_custkey", "c_name"], "https://api.example.com/collections")
    build = captured("customer", "c_custkey", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"], "https://api.example.com/_next/data/x.json")
    post = o.withColumn("method", F.lit("POST")).withColumn("url", F.lit("https://api.example.com/a"))
    return infer.best_response(run.combine([o, c, build, post]))


@_query("""
    SELECT page_id, 'https://' || regexp_extract(url, '://([^/?#:]+)', 1) || '/api/list?limit=' || (page_id % 3) * 10 AS endpoint,
        CASE WHEN page_id % 3 = 0 THEN 'page' ELSE 'offset' END AS page_param, CASE WHEN page_id % 3 = 0 THEN 100 ELSE (page_id % 3) * 10 END AS page_size,
        false AS discarded FROM pages
    UNION ALL SELECT page_id, 'https://a.example.com/get/{page}/{page_size}', NULL, page_id % 90 + 10, true FROM pages
""")
def endpoint_paging(spark, sf_dir):
    """How endpoints page, and which are build files."""
    @F.pandas_udf("struct<endpoint:string,page_param:string,page_size:bigint>")
    def paging(url: pd.Series) -> pd.DataFrame:
        found = [urls.paging_py(urls.without_page_params_py(u)) for u in url]
        return pd.DataFrame([(p["endpoint"], p.get("page_param"), p["page_size"]) for p in found], columns=["endpoint", "page_param", "page_size"])

    p, n = _t(spark, sf_dir, "pages"), F.col("page_id")
    host = F.concat(F.lit("https://"), F.regexp_extract("url", "://([^/?#:]+)", 1))
    listed = F.concat(host, F.lit("/api/list?offset="), n.cast("string"), F.lit("&limit="), (n % 3 * 10).cast("string"), F.lit("&START=4"))
    by_path = F.concat(F.lit("https://a.example.com/get/1/"), (n % 90 + 10).cast("string"), F.lit("/"))
    both = p.select("page_id", listed.alias("u"), F.lit("https://a.example.com/api/collections").alias("d"))
    both = both.unionByName(p.select("page_id", by_path.alias("u"), F.concat(host, F.lit("/page-data/x.json")).alias("d")))
    return both.select("page_id", paging("u").alias("p"), urls.discardable(F.col("d")).alias("discarded")).select("page_id", "p.endpoint", "p.page_param", "p.page_size", "discarded")


@_query("""
    SELECT l_orderkey, l_linenumber, trunc(l_extendedprice * 1e6)::BIGINT AS as_int, l_extendedprice * 1e6 AS as_float, l_quantity = 1 AS as_bool, l_discount / 1e6 AS small FROM lineitem
""")
def number_coercion(spark, sf_dir):
    """Numbers, however large or small, coerced as numbers."""
    from gleanery.operators.pipeline import coerced

    price = F.col("l_extendedprice") * 1e6
    df = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", price.alias("as_int"), price.alias("as_float"), F.col("l_quantity").alias("as_bool"), (F.col("l_discount") / 1e6).alias("small"))
    return coerced(df, {"as_int": "int", "as_float": "float", "as_bool": "bool", "small": "float"})


@_query("""
    SELECT r_regionkey, (2 * (n % 2 * 5 + r_regionkey % 3 * 7))::BIGINT AS cap FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey
""")
def safety_caps(spark, sf_dir):
    """The limit of a run from its sources' quotas, some of which are none."""
    n = _t(spark, sf_dir, "nation").groupBy("n_regionkey").count()
    rows = _t(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "count")

    @F.pandas_udf("bigint")
    def cap(key: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([infer.safety_cap(Blueprint(sources=(Source("a", {}, int(c) % 2 * 5), Source("b", {}, int(k) % 3 * 7), Source("c")))) for k, c in zip(key, count)])

    return rows.select("r_regionkey", cap("r_regionkey", "count").alias("cap"))


@_query()
def inferred_blueprints(spark, sf_dir):
    """The blueprint that most pages of a host propose."""
    return infer.infer(_t(spark, sf_dir, "pages"))


# whole runs over larger tables, and parts that the runs above don't show


def _customers(spark, sf_dir) -> DataFrame:
    """A list page a nation and a detail page for every second customer, as fetched pages."""
    c = _t(spark, sf_dir, "customer")
    card = F.concat(F.lit("<div class='card'><a href='c/"), F.col("c_custkey").cast("string"), F.lit("'> "), F.col("c_name"), F.lit("</a></div>"))
    lists = c.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("c_custkey", card.alias("h")))).getField("h"), "").alias("html"))
    lists = lists.select(F.concat(F.lit("https://shop.example.com/n"), F.col("c_nationkey").cast("string")).alias("url"), "html")
    detail = F.concat(F.lit("<dl><dt>Segment</dt><dd>"), F.col("c_mktsegment"), F.lit("</dd></dl><p>Balance: "), F.format_string("%.2f", "c_acctbal"), F.lit("</p>"))
    details = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("https://shop.example.com/c/"), F.col("c_custkey").cast("string")).alias("url"), detail.alias("html"))
    return lists.unionByName(details)


_CATALOGUE = Blueprint(
    url="https://shop.example.com", item_selector=".card", fields=(Field("link", "a", "href"), Field("name", "a")), sources=tuple(Source(f"n{i}", {"nation": i}) for i in range(25)),
    scrape_detail=True, detail_link_field="link", detail_fields=(Field("segment", label="Segment"), Field("balance", label="Balance")), item_schema={"balance": "float"}, dedup=True,
)


@_query("""
    SELECT 'https://shop.example.com/c/' || c_custkey AS link, c_name AS name, c_nationkey::INTEGER AS nation,
        CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal, 2) END AS balance FROM customer
""")
def html_catalogue(spark, sf_dir):
    """A whole HTML run of 25 sources with tags and details over all customers."""
    return run.run_html(spark, _CATALOGUE, _customers(spark, sf_dir))


@_query("""
    SELECT 'https://shop.example.com/c/' || c_custkey AS link, c_nationkey::INTEGER AS nation FROM customer WHERE c_custkey % 3 <> 0
""")
def resumed_run(spark, sf_dir):
    """The same run after an earlier one that took every third customer."""
    done = _t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("https://shop.example.com/c/"), F.col("c_custkey").cast("string")).alias("key"))
    return run.run_html(spark, _CATALOGUE.but(scrape_detail=False), _customers(spark, sf_dir), seen=done).select("link", "nation")


@_query("SELECT url AS page_url, trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&')) AS title, len(regexp_extract_all(html, '<li>'))::INTEGER AS entries FROM pages")
def page_single(spark, sf_dir):
    """Each page as one item, by a blueprint that was written as JSON and read again."""
    bp = Blueprint.load(Blueprint(fields=(Field("title", "title"), Field("entries", "li", multiple=True))).dump())
    return run.all_pages(bp, _t(spark, sf_dir, "pages")).select(F.col(PAGE_URL).alias("page_url"), "title", F.size("entries").alias("entries"))


@_query("""
    SELECT p_partkey, '## ' || p_name || chr(10) || chr(10) || 'by **' || p_brand || '**, [more](https://a.example.com/p/' || p_partkey || ')' || chr(10) || chr(10)
        || '- ' || p_type || chr(10) || '- ' || p_size AS md FROM part
""")
def part_markdown(spark, sf_dir):
    """Headings, bold text, links and lists as Markdown."""
    html = F.concat(
        F.lit("<nav>menu</nav><h2> "), F.col("p_name"), F.lit("</h2><p>by <b>"), F.col("p_brand"), F.lit("</b>, <a href='/p/"), F.col("p_partkey").cast("string"), F.lit("'>more</a></p><ul><li>"),
        F.col("p_type"), F.lit("<li>"), F.col("p_size").cast("string"), F.lit("</ul><script>x</script>"),
    )
    return spread(_t(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.btrim(markdown()(F.lit("https://a.example.com/x"), html), F.lit("\n ")).alias("md"))


@_query("SELECT event_id AS id FROM events WHERE event_id < (SELECT ceil(count(*) / 2 / 100.0) * 100 FROM events)")
def api_total(spark, sf_dir):
    """A source ends with the page that reaches the total its first page reports: half of all events."""
    r = _responses(spark, sf_dir)
    half = F.floor(F.lit(_t(spark, sf_dir, "events").count() / 2)).cast("string")
    body = F.when(F.col("page_ord") == 0, F.concat(F.lit('{"total": '), half, F.lit(", "), F.expr("substring(body, 2)"))).otherwise(F.col("body"))
    bp = _EVENTS_API.but(api=Api(endpoint="https://api.example.com/events", items_path="data.results", page_param="page", total_path="total"))
    return run.run_api(spark, bp, r.withColumn("body", body)).select("id")


@_query("SELECT p_partkey::VARCHAR AS key, upper(p_name) AS name, p_size::BIGINT * 2 AS size FROM part")
def custom_steps(spark, sf_dir):
    """A pipeline of named steps, two of them the caller's own."""
    html = F.concat(F.lit("<i> "), F.col("p_partkey").cast("string"), F.lit(" </i><b>"), F.col("p_name"), F.lit("</b><u>"), F.col("p_size").cast("string"), F.lit(" cm</u>"))
    pages = spread(_t(spark, sf_dir, "part"), "p_partkey").select(F.concat(F.lit("https://a.example.com/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))
    registry = {"loud": lambda df: df.withColumn("name", F.upper("name")), "double": lambda df: df.withColumn("size", F.col("size") * 2)}
    df = run.all_pages(Blueprint(fields=(Field("key", "i"), Field("name", "b"), Field("size", "u")), item_schema={"size": "int"}, pipeline=("trim", "nothing")), pages)
    return pipeline.apply(df, pipeline.build(("loud", "double"), {}, registry=registry)).select("key", "name", "size")


@_query("""
    SELECT sha1(user_id::VARCHAR) AS key, max_by(event_type, (ts, event_id)) AS body FROM events
    WHERE epoch((SELECT max(ts) FROM events)) - epoch(date_trunc('second', ts)) < 864000 GROUP BY user_id
""")
def cache_lookup(spark, sf_dir):
    """The youngest response of each address that is under ten days old at the time of the last one."""
    e = _t(spark, sf_dir, "events")
    last = e.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("m")).first()["m"]
    one = e.groupBy("user_id", "ts").agg(F.max_by("event_type", "event_id").alias("body"))
    return page_sources.cached(one.select(F.col("user_id").cast("string").alias("url"), F.col("ts").cast("timestamp").alias("fetched_at"), "body"), 864000, last)


@_query("""
    SELECT DISTINCT p_partkey, floor(i * (p_size - 1)::DOUBLE / greatest(1, least(p_size, 15) - 1) + 0.5)::INTEGER AS place
    FROM part, LATERAL (SELECT unnest(range(least(p_size, 15))) AS i)
""")
def spread_positions(spark, sf_dir):
    """Which items of a list are looked at: all, or 15 spread evenly."""
    @F.pandas_udf("array<int>")
    def places(n: pd.Series) -> pd.Series:
        return n.map(lambda k: infer.spread(int(k), 15))

    return spread(_t(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.explode(places("p_size")).alias("place"))


@_query("""
    SELECT event_id // 100 AS page_ord, 'data.results' AS path, count(*) AS n, 'at,kinds,user' AS fields FROM events GROUP BY ALL
""")
def response_records(spark, sf_dir):
    """Where each response has its records, how many, and which fields they make."""
    import json

    @F.pandas_udf("struct<path:string,n:bigint,fields:string>")
    def found(body: pd.Series) -> pd.DataFrame:
        got = [infer.record_list(json.loads(b)) for b in body]
        return pd.DataFrame([(g["path"], g["count"], ",".join(sorted(f.name for f in infer.api_fields(g["sample"])))) for g in got], columns=["path", "n", "fields"])

    return _responses(spark, sf_dir).select("page_ord", found("body").alias("f")).select("page_ord", "f.path", "f.n", "f.fields")


@_query("SELECT name, row_number() OVER (ORDER BY first)::BIGINT AS place FROM (SELECT event_type AS name, min(event_id) AS first FROM events GROUP BY 1)")
def union_columns(spark, sf_dir):
    """Column names in the order in which rows first have them."""
    names = export.union_header(_t(spark, sf_dir, "events").select("event_id", F.array("event_type", "event_type").alias("has")), "has", ("event_id",))
    return spark.createDataFrame(list(zip(names, range(1, len(names) + 1))), "name string, place bigint")


@_query("""
    SELECT p_partkey, 'a_b' || p_partkey || '.png' AS plain, sha1(p_name) || '.jpeg' AS hashed, sha1('https://a.example.com/') || '.gif' AS bare FROM part
""")
def image_names(spark, sf_dir):
    """Names of stored images, from their address or their bytes."""
    data, gif = F.col("p_name").cast("binary"), F.unhex(F.lit("474946383961"))
    at = F.concat(F.lit("https://a.example.com/i/a b"), F.col("p_partkey").cast("string"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", heuristics.image_name(F.concat(at, F.lit(".png?x=1")), data).alias("plain"), heuristics.image_name(F.concat(at, F.lit(".jpeg")), data, True).alias("hashed"),
        heuristics.image_name(F.lit("https://a.example.com/"), gif).alias("bare"),
    )


def _refusing(item: dict) -> None:
    if item["s_suppkey"] % 10 == 0:
        raise ValueError("full")


@_query("SELECT count(*) FILTER (s_suppkey % 10 <> 0) AS written, count(*) FILTER (s_suppkey % 10 = 0) AS failed FROM supplier")
def sink_counts(spark, sf_dir):
    """Items handed to a callback that refuses every tenth."""
    return spark.createDataFrame([emit.emit(_t(spark, sf_dir, "supplier"), emit.Callback(_refusing))], "written bigint, failed bigint")


@_query("""
    SELECT c_nationkey, CASE WHEN count(*) >= 3 THEN 'div.card' END AS selector, CASE WHEN count(*) >= 3 THEN 'link,title' END AS fields,
        CASE c_nationkey % 4 WHEN 0 THEN 'next_link' WHEN 1 THEN 'link_list' WHEN 2 THEN 'infinite_scroll' ELSE 'none' END AS paging FROM customer GROUP BY 1
""")
def list_detection(spark, sf_dir):
    """The list that a page repeats, its items' fields and how it goes on: a page a nation, all customers as cards."""
    from gleanery.dom.tree import parse

    c = _t(spark, sf_dir, "customer")
    card = F.concat(F.lit("<div class=card><h3><a href='/product-"), F.col("c_custkey").cast("string"), F.lit("'>"), F.col("c_name"), F.lit("</a></h3></div>"))
    more = F.element_at(F.array(*map(F.lit, ("<a rel=next href=/2>n</a>", "<ul class=pagination><li><a href=/2>2</a></ul>", "<button class=load-more>m</button>", ""))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    pages = c.groupBy("c_nationkey").agg(F.array_join(F.collect_list(card), "").alias("cards")).select("c_nationkey", F.concat(F.lit("<body><main>"), "cards", F.lit("</main>"), more).alias("html"))

    def detected(html: str) -> tuple:
        root = parse(html)
        got = infer.find_list(root)
        return got and got[0], got and ",".join(sorted(f.name for f in infer.fields(got[1]))), infer.find_pagination(root).strategy

    small_batches()

    @F.pandas_udf("struct<selector:string,fields:string,paging:string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for html in batches:
                yield pd.DataFrame([detected(h) for h in swept(html)], columns=["selector", "fields", "paging"])
        finally:
            give_back()

    return pages.select("c_nationkey", found("html").alias("f")).select("c_nationkey", "f.selector", "f.fields", "f.paging")


@_query("""
    SELECT p_partkey, 'R$ ' || p_size || ',50' AS price, p_size % 5 || '.5' AS rating, p_brand || ' street' AS address, p_type AS weight FROM part
""")
def field_finders(spark, sf_dir):
    """Price, rating, address and labels found in an item, then read by the fields that the finders propose."""
    from gleanery.dom.extract import record
    from gleanery.dom.tree import parse
    from gleanery.plans.presets import preset

    html = F.concat(
        F.lit("<div class=item><a href='/x-"), F.col("p_partkey").cast("string"), F.lit("'>x</a><span class=cost>R$ "), F.col("p_size").cast("string"), F.lit(",50</span><i data-rating='"),
        (F.col("p_size") % 5).cast("string"), F.lit(".5'></i><address>"), F.col("p_brand"), F.lit(" street</address><p><b>Weight:</b> "), F.col("p_type"), F.lit("</p></div>"),
    )

    @F.pandas_udf("struct<price:string,rating:string,address:string,weight:string>")
    def found(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            sample = parse(h).find("div")[0]
            fields = tuple(infer.fields(sample, labels=True, using=preset("auctions_pt_BR")))
            got = dict(zip([f.name for f in fields], record(sample, fields, None)))
            rows.append([got.get(n) for n in ("price", "rating", "address", "weight")])
        return pd.DataFrame(rows, columns=["price", "rating", "address", "weight"])

    return spread(_t(spark, sf_dir, "part"), "p_partkey").select("p_partkey", found(html).alias("f")).select("p_partkey", "f.price", "f.rating", "f.address", "f.weight")


@_query("""
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://' || regexp_extract(url, '://([^/?#]+)', 1) || '/api/catalog_system/pub/products/search/{search}?_from=0&_to=49' END AS endpoint FROM pages
""")
def hosted_shops(spark, sf_dir):
    """Pages of the hosted shop platform, and the fixed API of each."""
    html = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<img src='//x.vtexassets.com/a.png'>"))).otherwise(F.col("html"))

    @F.pandas_udf("string")
    def endpoint(url: pd.Series) -> pd.Series:
        return url.map(lambda u: infer.hosted_shop(u.replace("http:", "https:")).api.endpoint)

    return _t(spark, sf_dir, "pages").select("page_id", F.when(heuristics.is_hosted_shop(html), endpoint("url")).alias("endpoint"))


@_query("""
    SELECT page_id, rank, endpoint FROM (
        SELECT page_id, unnest([1, 2, 3]) AS rank, unnest([h || '/api/v1/list/all', h || '/rest/items/' || page_id, h || '/x/' || page_id]) AS endpoint
        FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS h FROM pages)
    )
""")
def page_endpoints(spark, sf_dir):
    """Endpoints that pages name, those with a telling word first."""
    n = F.col("page_id").cast("string")
    script = F.concat(F.lit("<script>fetch('/x/"), n, F.lit("');a('/api/v1/list/all');a('/rest/items/"), n, F.lit("');a('/api/list/x.css')</script>"))
    p = _t(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", script).alias("html"))
    return infer.discovered_endpoints(p, by="page_id").select("page_id", "rank", "endpoint")
