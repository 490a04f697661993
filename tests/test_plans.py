import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import filters, images, pipeline, shape, sink
from gleanery.plans import infer, run
from gleanery.plans.presets import preset
from gleanery.plans.blueprint import Api, ApiDetail, Blueprint, Field, InfiniteScroll, Output, Pagination, Rule, Source
from gleanery.sinks import export
from gleanery.sources import pages as page_sources
from gleanery.sources import requests
from gleanery.streaming import incremental


def item(link):
    return f"<div class=i><a href='{link}'>{link}</a></div>"


def test_filters(spark):
    df = spark.createDataFrame([("Apartamento Centro", "R$ 250.000", "80", "", ["novo", "centro"])], "title string, price string, area string, empty string, tags array<string>")
    cases = [
        ("title", "not_empty", None, True), ("missing", "empty", None, True), ("empty", "empty", None, True), ("tags", "contains", "centro", True), ("price", "matches", r"/R\$\s*[\d.]+/", True),
        ("title", "gt", "10", False), ("area", "gt", "79.5", True), ("area", "lt", "80", False), ("title", "contains", None, False), ("title", "not_contains", None, True), ("empty", "equals", None, True),
        ("title", "unknown", "x", True), ("title", "matches", "(", False), ("tags", "equals", "novo centro", True), ("area", "not_equals", "80", False),
    ]
    got = df.select(*[filters.condition(df, Rule(f, o, v)).alias(f"c{i}") for i, (f, o, v, _) in enumerate(cases)]).first()
    assert list(got) == [c[3] for c in cases]


def model(rows, quota, limit, rule):
    seen, out, stop = set(), [], False
    for source, group in itertools.groupby(rows, key=lambda r: r[0]):
        kept = 0
        for r in group:
            key, good = r[3], r[4]
            if key and key in seen:
                continue
            if key:
                seen.add(key)
            if not good:
                continue
            out.append(r[:3])
            kept += 1
            if limit and len(out) >= limit:
                return out
            if quota.get(source) and kept >= quota[source]:
                break
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sink_against_row_model(spark, seed):
    rng = random.Random(seed)
    rows = sorted((s, p, i, rng.choice(["", "a", "b", "c", "d", "e"]), rng.choice(["1", ""])) for s in range(3) for p in range(2) for i in range(5))
    df = spark.createDataFrame(rows, "source_ord bigint, page_ord bigint, item_ord bigint, k string, good string").repartition(4)
    for quota, limit in (({}, 0), ({}, 4), ({0: 2, 1: 1}, 0), ({0: 2, 1: 1, 2: 3}, 3)):
        got = sink.accept(df, "k", (Rule("good"),), limit, quota).select("source_ord", "page_ord", "item_ord")
        assert sorted(map(tuple, got.collect())) == sorted(model(rows, quota, limit, None)), (quota, limit)


def test_quota_leaves_keys_free(spark):
    rows = [(0, 0, i, k) for i, k in enumerate("xyz")] + [(1, 0, 0, "z")]
    df = spark.createDataFrame(rows, "source_ord bigint, page_ord bigint, item_ord bigint, k string")
    got = sink.accept(df, "k", quotas={0: 2}).select("source_ord", "k")
    assert sorted(map(tuple, got.collect())) == [(0, "x"), (0, "y"), (1, "z")]
    assert sink.accept(df.limit(0), "k", quotas={0: 2}).count() == 0


PAGES = [
    ("https://s.com/", item("a") + item("b") + "<a class=n href='/2'>n</a>"), ("https://s.com/2", item("b") + item("c") + "<a class=n href='/'>n</a>"),
    ("https://s.com/a", "<h1>A</h1><p>Size: 5</p>"), ("https://s.com/c", "<h2>none</h2>"), ("https://s.com/null", None),
]
BP = Blueprint(url="https://s.com/", item_selector=".i", fields=(Field("link", "a", "href"), Field("size", "a")), pagination=Pagination("next_link", ".n"), dedup=True)


def pages(spark):
    return spark.createDataFrame(PAGES, "url string, html string")


def test_html_run(spark):
    got = run.run_html(spark, BP, pages(spark), ordered=True)
    assert [r["link"] for r in got.collect()] == ["https://s.com/a", "https://s.com/b", "https://s.com/c"]
    bp = BP.but(scrape_detail=True, detail_link_field="link", detail_fields=(Field("title", "h1"), Field("size", label="Size")))
    rows = {r["link"][-1]: (r["size"], r["title"]) for r in run.run_html(spark, bp, pages(spark)).collect()}
    # the detail of c is fetched but has nothing, so it overwrites; b has no detail page
    assert rows == {"a": ("5", "A"), "b": ("b", None), "c": (None, None)}
    assert run.run_html(spark, BP, pages(spark), limit=1).count() == 1
    assert run.run_html(spark, BP.but(max_pages=1), pages(spark)).count() == 2
    assert run.run_html(spark, BP.but(item_selector="[["), pages(spark)).count() == 0
    seen = spark.createDataFrame([("https://s.com/a",), (None,)], "key string")
    assert run.run_html(spark, BP, pages(spark), seen=seen).count() == 2
    assert run.run_html(spark, BP, pages(spark).limit(0)).count() == 0


def test_sources_tags_and_output(spark):
    bp = BP.but(pagination=Pagination(), sources=(Source("", {"kind": "one"}, 1), Source("2", {"kind": "two", "n": 3})), output=Output(exclude=("size",), rename={"link": "url"}))
    rows = run.run_html(spark, bp, pages(spark), ordered=True).collect()
    assert [(r["url"][-1], r["kind"], r["n"]) for r in rows] == [("a", "one", None), ("b", "two", 3), ("c", "two", 3)]


def test_infinite_scroll(spark):
    bp = BP.but(pagination=Pagination("infinite_scroll"), infinite_scroll=InfiniteScroll(start=20, page_size=20), dedup=False)
    scrolled = spark.createDataFrame([(20, item("p")), (40, item("q")), (60, "<p>"), (80, item("r"))], "value bigint, html string")
    got = [r["size"] for r in run.run_html(spark, bp, pages(spark), scrolled=scrolled, ordered=True).collect()]
    assert got == ["a", "b", "p", "q"]
    assert [bp.infinite_scroll.value(i) for i in (0, 1)] == [20, 40]


def responses(spark, bodies, source=0):
    rows = [(source, i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "source_ord bigint, page_ord bigint, body string")


API = Blueprint(url="https://a.com", mode="api", api=Api(endpoint="https://a.com/x", items_path="r", page_param="page"), fields=(Field("id", "id", type="json"),), dedup=True, dedup_key="id")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_api_run(spark):
    page = lambda *n: {"r": [{"id": i} for i in n]}
    assert ids(run.run_api(spark, API, responses(spark, [page(1, 2), page(3), page(), page(4)]))) == ["1", "2", "3"]
    assert ids(run.run_api(spark, API, responses(spark, [page(1), page(1), page(2)]))) == ["1"]
    # a page of known items only ends the source
    assert ids(run.run_api(spark, API, responses(spark, [page(1, 2), page(2, 1), page(3)]))) == ["1", "2"]
    assert ids(run.run_api(spark, API, responses(spark, [page(1), "<html>", page(2)]))) == ["1"]
    assert ids(run.run_api(spark, API.but(api=Api(endpoint="e", items_path="r")), responses(spark, [page(1), page(2)]))) == ["1"]
    total = API.but(api=Api(endpoint="e", items_path="r", page_param="p", total_path="t"))
    assert ids(run.run_api(spark, total, responses(spark, [{**page(1, 2), "t": 2}, page(3)]))) == ["1", "2"]
    seen = spark.createDataFrame([("1",), ("2",)], "key string")
    assert ids(run.run_api(spark, API, responses(spark, [page(1, 2, 3)]), seen=seen)) == ["3"]
    assert ids(run.run_api(spark, API, responses(spark, [{"r": [{"id": 1}, 5, "x", {"id": " 2 "}]}]))) == ["1", "2"]
    assert run.run_api(spark, API.but(api=Api()), responses(spark, [])).count() == 0
    assert ids(run.run_api(spark, API.but(max_pages=1), responses(spark, [page(1), page(2)]))) == ["1"]


ODD_NAMES = ("total", "page_url", "item_ord", "_first", "source_ord", "url", "doc", "_kept", "key")


def test_fields_of_any_name(spark):
    """The engine's own columns clash with no field, in either mode, with tags, details, quotas and filters."""
    records = [{n: f"{n}{i}" for n in ODD_NAMES} for i in range(3)]
    fields = tuple(Field(n, n, type="json") for n in ODD_NAMES)
    bp = API.but(api=Api(endpoint="e", items_path="r", page_param="p", total_path="t", detail=ApiDetail(True, "https://a.com/{total}")), fields=fields, detail_fields=(Field("_found", "x", type="json"), Field("_link", "x", type="json")), dedup_key="total")
    details = spark.createDataFrame([("https://a.com/total1", '{"x": "5"}')], "url string, body string")
    for more in ({}, {"sources": (Source("", {"kind": "a"}, 2),)}, {"max_items": 2}):
        rows = run.run_api(spark, bp.but(**more), responses(spark, [{"r": records, "t": 3}]), details).collect()
        assert len(rows) == (2 if more else 3) and all(r[n].endswith(f"{n}{r['total'][-1]}") for r in rows for n in ODD_NAMES)
        assert {r["total"]: r["_found"] for r in rows}["total1"] == "5"
    html = "".join(f"<div class=i>{''.join(f'<b class={n}>{n}{i}</b>' for n in ODD_NAMES)}</div>" for i in range(3))
    page = spark.createDataFrame([("https://s.com/", html)], "url string, html string")
    fields = tuple(Field(n, f".{n}") for n in ODD_NAMES)
    for more in ({}, {"sources": (Source("", {"item": "a"}, 2),)}, {"max_items": 2}):
        rows = run.run_html(spark, Blueprint(url="https://s.com/", item_selector=".i", fields=fields, dedup=True, dedup_key="total", **more), page).collect()
        assert len(rows) == (2 if more else 3)
        assert all(r[n].endswith(f"{n}{r['total'][-1]}") for r in rows for n in ODD_NAMES)
    with pytest.raises(ValueError, match="~a"):
        run.run_html(spark, BP.but(fields=(Field("~a", "b"),)), page)


def test_pages_are_parsed_once(spark):
    """Four sources with quotas and details: no page goes through the parser twice."""
    from gleanery.dom import extract as stage

    read = spark.sparkContext.accumulator(0)
    old = stage.parse

    def counted(html):
        read.add(1)
        return old(html)

    listed = [(f"https://s.com/{i}", "".join(item(f"d{i}{j}") for j in range(5))) for i in range(4)]
    source = spark.createDataFrame(listed + [(f"https://s.com/d{i}{j}", "<h1>T</h1>") for i in range(4) for j in range(5)], "url string, html string")
    bp = BP.but(pagination=Pagination(), sources=tuple(Source(str(i), {}, 3) for i in range(4)), scrape_detail=True, detail_link_field="link", detail_fields=(Field("title", "h1"),))
    stage.parse = counted
    try:
        assert run.run_html(spark, bp, source).count() == 12
    finally:
        stage.parse = old
    assert 0 < read.value <= 24


def test_api_plan_moves_no_payload(spark):
    plan = run.api_records(API, responses(spark, [{"r": [{"id": 1}]}]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_page_numbers(spark):
    page = lambda *n: json.dumps({"r": [{"id": i} for i in n]})
    rows = [(0, 0, page(1)), (0, 1, page(2)), (0, 3, page(3)), (1, 1, page(9)), (2, 0, page(4)), (2, 1, page(5)), (2, 1, page(6))]
    df = spark.createDataFrame(rows, "source_ord bigint, page_ord bigint, body string")
    assert ids(run.run_api(spark, API, df)) == ["1", "2", "4"]


def test_running_sums(spark):
    rows = [(s, p, (7 * p + s) % 5) for s in range(3) for p in range(50)]
    got = run._running(spark.createDataFrame(rows, "s bigint, p bigint, v bigint"), "v", ("s", "p"), 8).collect()
    want = dict(zip([r[:2] for r in rows], itertools.accumulate(r[2] for r in rows)))
    assert {(r["s"], r["p"]): r["~sum"] for r in got} == want


def test_numbers_stay_numbers(spark):
    from gleanery.operators.pipeline import coerced

    df = spark.createDataFrame([(1.5e7, 12345678.25, 1e-05, 7, [1.5e7, -2.5]), (None, None, None, None, None)], "a double, b double, c double, d bigint, l array<double>")
    r = coerced(df, {"a": "int", "b": "float", "c": "float", "d": "float", "l": "int[]"}).collect()
    assert tuple(r[0]) == (15_000_000, 12345678.25, 1e-05, 7.0, [15_000_000, -2]) and tuple(r[1]) == (None,) * 5
    assert tuple(coerced(df, {"a": "bool", "d": "int", "c": "int"}).first())[:4] == (False, 12345678.25, 0, 7)


def test_api_detail_and_coercion(spark):
    bp = API.but(
        api=Api(endpoint="e", items_path="r", detail=ApiDetail(True, "https://a.com/d/{id}")), detail_fields=(Field("price", "price", type="json"),), item_schema={"price": "float"},
    )
    details = spark.createDataFrame([("https://a.com/d/a%20b", '{"price": "R$ 1.234,56"}'), ("https://a.com/d/c", "[oops")], "url string, body string")
    rows = run.run_api(spark, bp, responses(spark, [{"r": [{"id": "a b"}, {"id": "c"}]}]), details).collect()
    assert [(r["id"], r["price"]) for r in rows] == [("a b", 1234.56), ("c", None)]


def test_requests():
    api = Api(endpoint="https://a.com/x?size=50&sort=0&a=true", page_param="page")
    got = requests.request(api, 2)
    assert (got["url"], got["query"], got["body"]) == ("https://a.com/x", {"size": "50", "sort": "0", "a": "true", "page": 2}, None)
    assert requests.request(Api(endpoint="e", page_param="offset", page_size_param="n", page_size=10), 3)["query"] == {"offset": 30, "n": 10}
    assert requests.request(Api(endpoint="e/{page}/{page_size}"), 3)["url"] == "e/3/100"
    body = requests.request(Api(endpoint="e", method="POST", body={"start": 0, "q": "é"}, page_param="p", page_in_body=True, page_size=5), 2)["body"]
    assert json.loads(body) == {"start": 10, "q": "é", "p": 2}
    assert requests.encode_body("POST", {}, "json") == "{}" and requests.encode_body("POST", {}, "form") == ""
    assert requests.source_endpoint(Api(endpoint="e/{search}?q=1"), "/a/") == "e/a?q=1" and requests.source_endpoint(Api(endpoint="e/?q=1"), "a") == "e/a?q=1"
    assert requests.filled_py("x/{a}/{b}", {"a": "1 2"}) == "x/1%202/{b}"
    assert "".join(requests.scroll_request(InfiniteScroll("s", extra_params={"k": "v"}), 1, "t")["body"]) == "k=v&page=40&_token=t"


def test_pipeline(spark):
    df = spark.createDataFrame([("https://a.com/x/y", " t \n u ", "p", ["i.jpg", ""], None)], "`~page_url` string, title string, link string, images array<string>, image string")
    r = pipeline.apply(df, pipeline.build((), {})).first()
    assert (r["title"], r["link"], r["images"], r["image"]) == ("t u", "https://a.com/p", ["https://a.com/x/i.jpg", ""], None)
    assert pipeline.apply(df, pipeline.build((), {}, "cdn")).first()["images"][0] == "https://a.com/cdn/i.jpg"
    assert pipeline.apply(df, pipeline.build(("unknown",), {})).first()["title"] == " t \n u "
    up = {"upper": lambda d: d.withColumn("title", F.upper("title"))}
    assert pipeline.apply(df, pipeline.build(("trim", "upper"), {}, registry=up)).first()["title"] == "T U"


def test_images(spark):
    df = spark.createDataFrame([(1, "/logo.png", ["/icon.png", "/g.png"]), (2, "/photo.png", None), (3, None, []), (4, "/logo.png", [])], "id int, image string, images array<string>")
    rows = {r["id"]: r for r in images.shape(df, True, True, True).collect()}
    assert [rows[i]["primary_image"] for i in (1, 2, 3, 4)] == ["/g.png", "/photo.png", None, "/logo.png"]
    assert rows[1]["all_images"] == ["/logo.png", "/g.png", "/icon.png"] and rows[3]["all_images"] is None
    assert images.shape(df, False, False, False).columns == ["id", "image", "images"]


def test_shape(spark):
    df = spark.createDataFrame([(1, 2)], "a int, c int")
    assert shape.renamed(df, {"a": "b"}).columns == ["c", "b"]
    assert shape.renamed(df, {"a": "c"}).first().asDict() == {"c": 1}
    nested = df.select("a", F.array("a", "c").alias("l"), F.struct(F.array("c").alias("m")).alias("s"), F.array().cast("array<int>").alias("none"))
    assert shape.flattened(nested).first().asDict() == {"a": 1, "l_0": 1, "l_1": 2, "s_m_0": 2}


def test_exports(spark):
    df = spark.createDataFrame([(0, "A", "10", None), (1, "B, \"x\"", "20", ["a.jpg", "b.jpg"])], "ord int, title string, price string, images array<string>")
    assert export.text(df, "csv", ("ord",)) == 'title,price,images\nA,10,\n"B, ""x""",20,"[""a.jpg"",""b.jpg""]"\n'
    assert json.loads(export.text(df, "json", ("ord",)))[0] == {"title": "A", "price": "10", "images": None}
    assert export.text(df, "jsonl", ("ord",)).count("\n") == 1
    assert export.text(df, "markdown", ("ord",)) == "## A\n\n- **price:** 10\n\n---\n\n## B, \"x\"\n\n- **price:** 20\n- **images:** a.jpg, b.jpg\n"
    body = spark.createDataFrame([("", " text ")], "name string, body string")
    assert export.text(body, "markdown") == "## Item 1\n\ntext\n"
    none = df.limit(0)
    assert [export.text(none, k, ("ord",)) for k in ("json", "jsonl", "csv", "markdown")] == ["[]", "", "", ""]
    assert export.file_path("/o", "x", "markdown") == "/o/x.md" and export.file_path("/o", "-", "csv") == "-"
    keys = spark.createDataFrame([(0, ["a", "b"]), (1, ["c", "a"])], "ord int, keys array<string>")
    assert export.union_header(keys, "keys", ("ord",)) == ["a", "b", "c"]


def test_export_files(spark, tmp_path):
    df = spark.createDataFrame([("A", None), ("B", "x\"y")], "title string, note string").coalesce(1)
    export.write(df, "csv", f"{tmp_path}/c")
    export.write(df, "jsonl", f"{tmp_path}/j")
    export.write(df, "markdown", f"{tmp_path}/m")
    assert sorted(r["title"] for r in spark.read.json(f"{tmp_path}/j").collect()) == ["A", "B"]
    assert next((tmp_path / "c").glob("*.csv")).read_text() == 'title,note\nA,\nB,"x""y"\n'
    assert "## B" in next((tmp_path / "m").glob("*.txt")).read_text()


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "link string, v int")
    new = spark.createDataFrame([("b", 5, 0), ("b", 6, 1), ("c", 7, 2), (None, 8, 3)], "link string, v int, o int")
    assert sorted(map(tuple, export.upserted(old, new, order=("o",)).collect()), key=str) == sorted([("a", 1), ("b", 6), ("c", 7), (None, 8)], key=str)


def test_blueprint_round_trip():
    bp = Blueprint.of({
        "url": "https://a.com", "mode": "other", "item_selector": ".i", "fields": [{"name": "a", "css": "b", "type": "odd"}], "search_filters": ["x", {"url_sufix": "y", "limit": -2, "k": 1, "l": [1]}],
        "pagination": {"strategy": "load_more", "css": ".m"}, "infinite_scroll": {"endpoint": "/m", "page_size": 0}, "output": {"format": "odd"}, "max_pages": -1,
        "result_filters": {"enabled": True, "rules": [{"field": "a"}]}, "dedup": {"enabled": True},
    })
    assert (bp.mode, bp.fields[0].type, bp.pagination.strategy, bp.output.format, bp.max_pages, bp.dedup_key) == ("html", "css", "infinite_scroll", "json", 0, "link")
    assert bp.sources == (Source("x"), Source("y", {"k": 1}, 0)) and bp.infinite_scroll.page_size == 1 and bp.infinite_scroll.body_format == "form"
    assert bp.http.verify_tls is True
    assert Blueprint.load(bp.dump()) == bp
    with pytest.raises(ValueError):
        Blueprint.of({"pagination": {"strategy": "odd"}})
    with pytest.raises(ValueError):
        Blueprint.load("[]")


def test_validate_and_builder():
    bad, odd = Blueprint().validate()
    assert len(bad) == 2 and len(odd) == 1
    bp = Blueprint(url="https://a.com", item_selector=".i").select("link", "a", attribute="href").select("", "x").select("nothing").where("link")
    assert len(bp.fields) == 1 and bp.filter and bp.validate() == ([], [])
    bad, odd = bp.but(scrape_detail=True, item_schema={"link": "date"}, pipeline=("odd",), pagination=Pagination("infinite_scroll")).validate()
    assert len(bad) == 3 and len(odd) == 1
    assert preset("auctions").rate == 0.6 and preset("none") == preset("generic") and "leilao" in preset("auctions").endpoints
    assert infer.safety_cap(bp.but(sources=(Source("a", {}, 5), Source("b")))) == 10 and infer.safety_cap(bp) == 0
    assert any("unknown type" in e for e in bp.but(fields=(Field("a", "b", type="odd"),)).validate()[0])
    assert infer.safety_cap(bp.but(sources=(Source("a", {}, 2), Source("b", {}, 3)))) == 10


def test_statistics_cache_throttle(spark):
    df = spark.createDataFrame([(0, 0, 0, "a", "1"), (0, 0, 1, "a", "1"), (0, 0, 2, "b", "")], "source_ord bigint, page_ord bigint, item_ord bigint, k string, good string")
    got = run.statistics(sink.judged(df, "k", (Rule("good"),)), 90.5, pages_fetched=1, cache_hits=2).first()
    assert (got["items_found"], got["items_deduped"], got["items_filtered"], got["items_scraped"]) == (3, 1, 1, 1)
    assert (got["pages_fetched"], got["details_failed"], got["elapsed_s"], got["items_per_s"]) == (1, 0, 90.5, 0.0)
    assert run.summary(got.asDict()).splitlines() == ["items scraped: 1 in 1m30s (0.0/s)", "pages: 1 fetched, 0 failed", "filtered out: 1 items", "repeated: 1 items", "cache: 2 hits, 0 misses"]
    with pytest.raises(ValueError):
        run.statistics(sink.judged(df, "k", ()), pages=1)
    asked = spark.createDataFrame([("u", 0.0), ("u", 50.0), ("u", 100.0), ("u", 120.0)], "url string, at double")
    hits = [r["hit"] for r in page_sources.replayed(asked, 100).orderBy("at").collect()]
    assert hits == [False, True, False, True]
    lat = spark.createDataFrame([("h", 1, 200.0), ("h", 2, 400.0)], "host string, at int, latency_ms double")
    assert [r["delay_ms"] for r in run.throttled(lat, 0).orderBy("at").collect()] == [100.0, 250.0]


def test_corpus_inference(spark):
    from test_dom import cards

    df = spark.createDataFrame([(f"https://h.com/{i}", cards(4 + i)) for i in range(3)] + [("https://g.com/", None)], "url string, html string")
    row = infer.infer(df).collect()
    assert len(row) == 1 and row[0]["votes"] == 3
    bp = Blueprint.load(row[0]["blueprint"])
    assert bp.url == "https://h.com/0" and bp.item_selector == "div.card"
    captured = spark.createDataFrame([("https://a/x", "GET", '{"items": [{"a": 1, "b": 2}]}'), ("https://a/y", "get", '[{"a": 1, "b": 2, "c": 3}]'), ("https://a/z", "POST", "[]"), ("https://a/w", "GET", None)], "url string, method string, body string")
    assert infer.best_response(captured).first()["url"] == "https://a/y"


def test_captured_responses(spark):
    rows = [
        ("https://a/api/collections?page=3&q=1", "GET", '[{"a": 1, "b": 2, "c": 3}]'), ("https://a/api/tracks", "GET", '[{"a": 1, "b": 2}]'),
        ("https://a/_next/data/h/x.json", "GET", '[{"a": 1, "b": 2, "c": 3, "d": 4}]'), ("https://a/manifest.json?v=1", "GET", '[{"a": 1, "b": 2, "c": 3, "d": 4}]'), (None, "GET", "[]"),
    ]
    df = spark.createDataFrame(rows, "url string, method string, body string")
    assert infer.best_response(df).first()["url"] == "https://a/api/collections?q=1"
    assert sorted(r["url"] for r in infer.judged_responses(df).collect()) == ["https://a/api/collections?q=1", "https://a/api/tracks"]
    html = "<script>fetch('/x/y'); get('/api/v1/list/items')</script>"
    captured = [dict(zip(("url", "method", "body"), r)) for r in rows if r[0]]
    assert infer.discovered("https://a/", html, captured) == ["https://a/api/collections?q=1", "https://a/api/tracks", "https://a/api/v1/list/items", "https://a/x/y"]
    pages = spark.createDataFrame([("https://a/", html)], "url string, html string")
    found = infer.discovered_endpoints(pages, df.withColumn("page_url", F.lit("https://a/"))).orderBy("rank").collect()
    assert [r["endpoint"] for r in found] == ["https://a/api/collections?q=1", "https://a/api/tracks", "https://a/api/v1/list/items", "https://a/x/y"]
    assert infer.hinted(["https://a/x", "https://a/search"], 1) == ["https://a/search"]
    many = "".join(f"fetch('/x{i}');" for i in range(20))
    assert infer.to_try("https://a/", f"<script>{many}</script>") == [f"https://a/x{i}" for i in range(12)]
    scripts = "".join(f"<script src='/s{i}.js'></script>" for i in range(9)) + "<script src='/search.js'></script><script src='https://cdn/api.js'></script>"
    assert infer.scripts_to_read("https://a/", scripts) == ["https://a/search.js", *(f"https://a/s{i}.js" for i in range(5))]


def test_paging_of_endpoints():
    from gleanery.functions.urls import paging_py, without_page_params_py

    assert paging_py("https://a/Get/1/20") == {"endpoint": "https://a/Get/{page}/{page_size}", "start_page": 1, "page_size": 20}
    assert paging_py("https://a/x?limit=50") == {"endpoint": "https://a/x?limit=50", "page_param": "offset", "page_size": 50}
    assert paging_py("https://a/x?limit=0")["page_param"] == "page" and paging_py("https://a/x")["page_size"] == 100
    assert without_page_params_py("https://a/x?Page=2&q=1&from=3#f") == "https://a/x?q=1#f" and without_page_params_py("https://a/x?start=1") == "https://a/x"
    bp = infer.from_response("https://a/x?offset=40&limit=20", '{"r": [{"id": 1, "photo": "p"}]}')
    assert (bp.api.endpoint, bp.api.page_param, bp.api.page_size, bp.api.items_path) == ("https://a/x?limit=20", "offset", 20, "r")
    assert infer.from_response("https://a", '{"a": {"b": [{"id": 1}]}, "r": [{"x": 1}, {"x": 2}]}', "a.b").fields[0].name == "id"
    assert infer.from_response("https://a", '{"a": 1}', "a.b") is None


def test_generate_command(tmp_path, capsys):
    from test_dom import cards

    from gleanery.__main__ import main

    (tmp_path / "p.html").write_text(cards(9))
    (tmp_path / "d.html").write_text("<body><main><h1>One</h1><p><b>Weight:</b> 5 kg</p><p>" + "long text " * 20 + "</p></main></body>")
    ask = ["generate", str(tmp_path / "p.html"), "--url", "https://h.com/"]
    options = [
        "--max-pages", "3", "--http-timeout", "9", "--header", "A: b:c", "--cookie", "x=1; y=2", "--output-format", "csv", "--stream", "--search-filters", '["a", {"url": "b", "limit": 4, "k": "v"}]',
        "--get-detail", str(tmp_path / "d.html"), "--preset", "ecommerce", "--dedup-key", "title", "--browser-wait-for", ".card", "--get-all-images", "--resumable", "--page-delay", "7",
    ]
    assert main([*ask, *options]) == 0
    bp = Blueprint.load(capsys.readouterr().out)
    assert (bp.max_pages, bp.http.timeout, bp.http.headers["A"], bp.http.cookies, bp.output.format, bp.output.stream) == (3, 9, "b:c", {"x": "1", "y": "2"}, "csv", True)
    assert (bp.max_items, bp.sources[1].limit, bp.dedup_key, bp.http.transport, bp.all_images, bp.resumable, bp.delay_between_pages_ms) == (8, 4, "title", "browser", True, True, 7)
    assert bp.item_schema == {"price": "float", "rating": "float"} and bp.scrape_detail and any(f.label == "Weight" for f in bp.detail_fields)
    assert main([*ask, "--fields", "link", "--no-dedup", "--blueprint", str(tmp_path / "b.json")]) == 0 and main([*ask, "--blueprint", str(tmp_path / "b.json")]) == 1
    kept = Blueprint.load((tmp_path / "b.json").read_text())
    assert [f.name for f in kept.fields] == ["link"] and not kept.dedup
    (tmp_path / "r.json").write_text('{"data": [{"id": 1, "name": "x"}]}')
    assert main(["generate", str(tmp_path / "r.json"), "--url", "https://h.com/", "--api-endpoint", "https://h.com/api/1/10", "--api-items-path", "data"]) == 0
    api = Blueprint.load(capsys.readouterr().out)
    assert (api.url, api.api.endpoint, api.api.start_page) == ("https://h.com/", "https://h.com/api/{page}/{page_size}", 1)


def test_file_stream(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("é", None)], "t string, n int").coalesce(1)
    for kind, want in (("json", '[\n  {"t":"A","n":1},\n  {"t":"é","n":null},\n  {"u":2}\n]\n'), ("jsonl", '{"t":"A","n":1}\n{"t":"é","n":null}\n{"u":2}\n'), ("csv", "t,n,u\nA,1,\né,,\n,,2\n")):
        out = export.FileStream(f"{tmp_path}/x/{kind}", kind)
        out.write(df)
        out.write(spark.createDataFrame([(2,)], "u int"))
        out.close()
        assert open(f"{tmp_path}/x/{kind}", encoding="utf-8").read() == want
    export.FileStream(f"{tmp_path}/empty", "json").close()
    assert open(f"{tmp_path}/empty").read() == "[\n]\n"


PRIVATE = ["localhost", "2130706433", "127.1", "[::ffff:169.254.169.254]", "[::ffff:172.16.0.1]", "[0:0:0:0:0:0:0:1]", "10.0.0.5", "[::1]", "0x7f000001", "169.254.169.254", "[64:ff9b::10.0.0.1]", "0.0.0.0", "100.64.0.1", "１２７.0.0.1", "a.localhost"]
PUBLIC = ["1.1.1.1", "8.8.8.8", "[2606:4700:4700::1111]", "example.com", "1.1.1.1.example.com", "16843009"]


def test_guard(spark, monkeypatch):
    from gleanery.sources import guard

    rows = [(f"http://{h}:80/x",) for h in PRIVATE + PUBLIC]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").coalesce(1).select(guard.refused(F.col("u"), True)).collect()]
    assert all(got[: len(PRIVATE)]) and not any(got[len(PRIVATE) :]) and "10.0.0.5" in got[PRIVATE.index("10.0.0.5")]
    assert [guard.reason(u, True, resolve=False) for (u,) in rows] == got
    assert guard.reason("http://localhost:6379/", True, ("LOCALHOST",)) is None and guard.reason("http://127.0.0.1/", False) is None
    assert guard.reason("file:///etc/passwd") and guard.reason("gopher://evil/") and guard.reason(None) and guard.reason("http:///x", True) == "no host"
    asked = []
    monkeypatch.setattr(guard.socket, "getaddrinfo", lambda h, *a, **k: asked.append(h) or [(2, 1, 6, "", ("10.1.2.3", 0))])
    assert [guard.reason(f"http://inner.test/{i}", True) for i in range(3)] == ["private address 10.1.2.3"] * 3 and asked == ["inner.test"]


def test_streaming(spark, tmp_path):
    folder = tmp_path / "pages"
    first = pages(spark).where("url LIKE '%.com/'").coalesce(1)
    first.write.parquet(str(folder))
    got = []
    bp = BP.but(pagination=Pagination())
    emit = lambda df, n: got.extend((n, r["link"]) for r in df.collect())
    args = (bp, emit, str(tmp_path / "check"), f"{tmp_path}/state")
    stream = lambda: spark.readStream.schema("url string, html string").parquet(str(folder))
    incremental.stream_items(stream(), *args).awaitTermination()
    pages(spark).where("url LIKE '%/2'").coalesce(1).write.mode("append").parquet(str(folder))
    incremental.stream_items(stream(), *args).awaitTermination()
    assert got == [(0, "https://s.com/a"), (0, "https://s.com/b"), (1, "https://s.com/c")]


def test_resume(spark, tmp_path):
    state = f"file://{tmp_path}/keys"
    assert incremental.resume(spark, BP, pages(spark), state).count() == 3
    assert incremental.resume(spark, BP, pages(spark), state).count() == 0


def test_endpoints_of_pages_of_one_address(spark, tmp_path):
    """Pages of one address keep to the endpoints that they name themselves; captured ones go to all of them."""
    pages = spark.createDataFrame([(1, "https://a/", "<p>"), (2, "https://a/", "<p>"), (3, "https://b/", "<p>")], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    from gleanery.queries import QUERIES

    got = sorted(map(tuple, QUERIES["page_endpoints"](spark, str(tmp_path)).collect()))
    hosts = {1: "a", 2: "a", 3: "b"}
    assert got == [(i, k, f"https://{h}{u}") for i, h in hosts.items() for k, u in enumerate(("/api/v1/list/all", f"/rest/items/{i}", f"/x/{i}"), 1)]
    captured = spark.createDataFrame([("https://a/", "https://a/api/list", "GET", '[{"a": 1}, {"a": 2}]')], "page_url string, url string, method string, body string")
    found = infer.discovered_endpoints(pages, captured, "page_id")
    assert sorted(map(tuple, found.collect())) == [(i, "https://a/", "https://a/api/list", 1) for i in (1, 2)]


@pytest.mark.parametrize("name", ["part_markdown", "field_finders", "spread_positions", "custom_steps"])
def test_short_rows_are_worked_on_by_all_cores(spark, tmp_path, name):
    """A small file is one task to read; what Python does with its rows is shared out."""
    from gleanery.queries import QUERIES

    rows = spark.range(4000, numPartitions=1).selectExpr("id AS p_partkey", "'a b' AS p_name", "'Brand#1' AS p_brand", "'LARGE' AS p_type", "CAST(id % 50 AS int) AS p_size")
    rows.write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    whole = sum(r["count"] for r in got)
    assert len(got) >= 4 and whole >= 4000 and max(r["count"] for r in got) < whole / 2
