import pytest

from gleanery.dom import css, xpath
from gleanery.dom.labels import pairs
from gleanery.dom.markdown import to_markdown
from gleanery.dom.tree import parse
from gleanery.plans import infer

PAGE = parse("""<html><head><title>T</title></head><body class='x y'><ul class="a b"><li id=one>1 <b>two<li data-k="v-w" class=last>3</ul>
<p>p1<p lang=en-GB>p2 <a href='/q' rel="next nofollow">q</a><div><p>in div</p><span></span></div></body></html>""")


@pytest.mark.parametrize("selector, want", [
    ("li", ["1 two", "3"]), ("ul.a.b > li#one b", ["two"]), ("li + li", ["3"]), ("[data-k|=v]", ["3"]), ("[data-k^=v][data-k$=w]", ["3"]), ("li:nth-child(2n+1)", ["1 two"]),
    ("p ~ div p", ["in div"]), ("a[rel~=next]", ["q"]), ("p:not(:has(a))", ["p1", "in div"]), ("span:empty", [""]), ("li:last-child, title", ["T", "3"]), ("p:contains('p2')", ["p2 q"]),
    ("body.x.y > p:first-of-type", ["p1"]), ("p:lang(en)", ["p2 q"]), ("nope", []),
])
def test_css(selector, want):
    assert [n.text() for n in css.select(PAGE, selector)] == want


@pytest.mark.parametrize("bad", ["", "li >", "[", "li:nth-child(x)", ":unknown", "::", "a,,b"])
def test_css_errors(bad):
    with pytest.raises(css.SelectorError):
        css.select(PAGE, bad)


@pytest.mark.parametrize("path, want", [
    ("//li[2]", ["3"]), ("//li[@id='one']/b", ["two"]), ("//a/@href", ["/q"]), ("//p[contains(., 'p2')]//a[starts-with(@href, '/')]", ["q"]), ("//li[last()]", ["3"]),
    ("//b/..", ["1 two"]), ("//ul/following-sibling::p[1]", ["p1"]), ("//p[not(a) and string-length(.) > 2]", ["in div"]), ("//li[position() < 2] | //title", ["1 two", "T"]),
    ("//p[normalize-space()='p1']", ["p1"]), ("//li[@class='last' or @id='x']", ["3"]), ("//ul[count(li) = 2]/@class", ["a b"]), ("/html/body/div/p", ["in div"]),
])
def test_xpath(path, want):
    assert [n if isinstance(n, str) else n.text() for n in xpath.select(PAGE, path)] == want


@pytest.mark.parametrize("bad", ["//", "//li[", "foo(", "//li[unknown-fn()]", "1"])
def test_xpath_errors(bad):
    with pytest.raises(css.SelectorError):
        xpath.select(PAGE, bad)


@pytest.mark.parametrize("html, want", [
    ("<h2>Title</h2><p>One</p><p>Two</p>", "## Title\n\nOne\n\nTwo"), ("a <b> b </b>c", "a **b** c"), ("<a href='/x'>t</a> <a href='#'>u</a> <a href=''>v</a>", "[t](https://h.com/x) u v"),
    ("<img src='i.png' alt='A'>", "![A](https://h.com/i.png)"), ("<ol><li>a<li>b<ul><li>c</ol>", "1. a\n2. b\n   - c"), ("<pre><code class='x language-js'>a\n b\n</code></pre>", "```js\na\n b\n```"),
    ("<table><tr><th>a<th>b|c<tr><td>1</table>", "| a | b\\|c |\n| --- | --- |\n| 1 |  |"), ("<nav>n</nav><script>x</script><p>t</p>", "t"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"), ("x<br>y", "x\ny"), ("  ", ""), (None, ""), ("<hr><p>a</p>", "---\n\na"), ("<p>a <code> c </code></p>", "a `c`"),
])
def test_markdown(html, want):
    assert to_markdown(html, "https://h.com/") == want


def test_labels():
    html = "<dl><dt>Area:</dt><dd>80</dd></dl><table><tr><th>Rooms<td>3</table><b>Price:</b> 10<div><i class='my-label'>Lot</i><i class=value>7</i></div><span>Floor: 2</span><span>Area: 9</span>"
    assert pairs(parse(f"<div>{html}</div>")) == [("Area", "80"), ("Rooms", "3"), ("Lot", "7"), ("Floor", "2")]
    assert pairs(parse("<p><b>Price:</b> 10</p>")) == [("Price", "10")]


def cards(n=6, cls="card"):
    body = "".join(f"<div class='{cls}'><a href='/item/{i}'><img src='/photo/{i}.jpg' width=200><h3>Item {i}</h3></a><span class=price>US$ {i}.50</span></div>" for i in range(n))
    return f"<html><body><nav><a href='/login'>in</a></nav><main><div class=list>{body}</div><ul class=pagination><li><a href='?page=2'>2</a></ul></main></body></html>"


def test_list_inference():
    bp = infer.from_page("https://h.com/", cards())
    assert bp.item_selector == "div.card"
    assert {f.name: f.css for f in bp.fields} == {"link": "a", "title": "h3", "image": "img", "price": "span.price"}
    assert (bp.pagination.strategy, bp.pagination.css) == ("link_list", "ul.pagination a")
    assert bp.dedup and bp.dedup_key == "link"
    assert bp.validate() == ([], [])


def test_single_page_inference():
    bp = infer.from_page("https://h.com/", "<body><main><h1>Head</h1><p>Some text of an article that is rather long, longer than sixty characters.</p></main></body>")
    assert bp.item_selector == "body" and {f.name for f in bp.fields} == {"title", "description", "content"}
    assert bp.pagination.strategy == "none"


@pytest.mark.parametrize("doc, path, count", [
    ([{"id": 1, "name": "a", "price": 2}, {"id": 2}], "", 2), ({"data": {"results": [{"id": 1}]}}, "data.results", 1),
    ({"data": [{"a": 1, "b": 2, "c": 3}] * 2, "filters": {"year": [{"k": 1, "n": 2, "x": 3}] * 37}}, "data", 2),
    ({"results": [{"a": 1}], "aggregations": {"M": {"elements": [{"a": 1, "b": 2, "c": 3}] * 174}}}, "results", 1), ({"items": [{"a": 1}], "nested": {"deep": {"items": [{"a": 1}]}}}, "items", 1),
])
def test_record_list(doc, path, count):
    got = infer.record_list(doc)
    assert (got["path"], got["count"]) == (path, count)


def test_no_record_list():
    assert infer.record_list({"a": 1, "b": [1, 2]}) is None
    assert infer.from_response("https://a.com", "<html>") is None
    bp = infer.from_response("https://a.com/x", '{"data": [{"id": 1, "productUrl": "/x", "imgs": ["a"], "meta": {}}]}')
    assert [f.name for f in bp.fields] == ["id", "product_url", "link", "imgs", "gallery_images"]
    assert bp.api.items_path == "data" and bp.dedup_key == "id"


def test_spread():
    assert infer.spread(3, 5) == [0, 1, 2]
    assert infer.spread(10, 5) == [0, 2, 5, 7, 9]


def test_propose():
    from gleanery.sources.fetch import BotBlocked

    url = "https://h.com/list"
    assert infer.propose(url, cards()).item_selector == "div.card"
    assert infer.propose(url, cards(), single=True).item_selector == "body"
    with pytest.raises(BotBlocked) as e:
        infer.propose(url, "<title>Just a moment...</title>")
    assert e.value.vendor == "Cloudflare"
    assert infer.propose(url, "<p>x</p><link href='//a.vtexassets.com/x.css'>").api.endpoint.startswith("https://h.com/api/catalog_system")
    shell = "<div id='root'></div><script src='a.js'></script><script>fetch('/api/items/list')</script>"
    shell = shell.replace("'root'", '"root"')
    with pytest.raises(infer.ScriptRendered) as e:
        infer.propose(url, shell)
    assert e.value.endpoints == ["https://h.com/api/items/list"]
    body = '{"items": [' + ", ".join('{"id": %d, "name": "n", "url": "/%d"}' % (i, i) for i in range(8)) + "]}"
    seen = [{"url": "https://h.com/api/items/list", "method": "get", "body": body}, {"url": "https://h.com/x", "method": "POST", "body": body}]
    api = infer.propose(url, shell, seen)
    assert (api.mode, api.api.endpoint, api.api.items_path, api.dedup_key) == ("api", "https://h.com/api/items/list", "items", "id")
    assert infer.propose(url, shell, rendered=cards()).http.render_js
    assert infer.propose(url, shell, seen, cards(6)).mode == "html" and infer.propose(url, shell, seen, cards(4)).mode == "api"
    text = "<main><h1>Head</h1><p>" + "word " * 100 + "</p></main>"
    assert infer.propose(url, text).item_selector == "body"


def test_real_list():
    links = "".join(f"<li class=m><a href='/{i}'>{i}</a>" for i in range(5))
    few, many = f"<ul>{links}</ul>", f"<ul>{links}</ul>" + "<script></script>" * 3
    assert infer.real_list(parse(few), "li.m", few) and not infer.real_list(parse(many), "li.m", many)


@pytest.mark.parametrize("html, want", [
    ("a&&amp", "a&&amp"), ("x &amp;&copy; &ltd &copy2", "x &© &ltd &copy2"), ("&notit; &nosuch; &#65;&#66 &", "&notit; &nosuch; AB &"), ("&\ufdd0amp; &amp", "&\ufdd0amp; &amp"),
    ("<b>&amp</b>;", "&amp;"), ("AT&T &quo", "AT&T &quo"),
])
def test_names_without_semicolon(html, want):
    """A named character reference ends in a semicolon; what doesn't is text."""
    assert parse(f"<p>{html}</p>").find("p")[0].text() == want


def test_names_in_attributes_and_scripts():
    root = parse("<a href='/?a=1&copy=2&amp;b=3' &x>l</a><script>a&amp;&lt</script><i&j>k</i&j>m")
    assert root.find("a")[0].attrs == {"href": "/?a=1&copy=2&b=3", "&x": ""}
    assert root.find("script")[0].content() == "a&amp;&lt" and root.find("i&j")[0].text() == "k"


@pytest.mark.parametrize("name, row", [("page_titles", ("A&&amp",)), ("page_single", ("T&&am&amp", 2)), ("page_xpath_regex", ("T&&am&amp", None))])
def test_titles_cut_within_a_reference(spark, tmp_path, name, row):
    from gleanery.queries import QUERIES

    html = "<html><head><title>T&amp;&am&amp</title></head><body><article><h1>A&amp;&amp</h1><ul><li>1<li>2</ul></article></body></html>"
    spark.createDataFrame([(1, "https://a/", html)], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()] == [row]


def long_list(n):
    return "<main>" + "".join(f"<div class=card><h3><a href='/product-{i}'>Customer#{i:09d}</a></h3></div>" for i in range(n)) + "</main>"


def test_trees_of_long_lists_are_small():
    """Under 850 bytes an item of three elements; equal attributes are held once."""
    import tracemalloc

    html = long_list(20000)
    tracemalloc.start()
    root = parse(html)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held / 20000 < 850
    one, other = root.find("main")[0].children[:2]
    assert one.attrs is other.attrs == {"class": "card"} and one.html() == "<div class=\"card\"><h3><a href=\"/product-0\">Customer#000000000</a></h3></div>"


def test_trees_go_with_their_texts(monkeypatch):
    import gc

    from gleanery import batches
    from gleanery.dom.tree import Node

    html = long_list(1000)
    monkeypatch.setattr(batches, "SWEEP", len(html))
    before, most = sum(isinstance(o, Node) for o in gc.get_objects()), 0
    gc.disable()
    try:
        for text in batches.swept([html] * 5):
            most = max(most, sum(isinstance(o, Node) for o in gc.get_objects()) - before)
            parse(text)
    finally:
        gc.enable()
    assert most < 100


def test_texts_go_to_python_in_small_batches(spark):
    """What is called on pages has the session cut batches by bytes; a smaller setting stays."""
    from gleanery import batches
    from gleanery.dom import extract

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name, None)
    try:
        for given, want in (("67108864", batches.BATCH_BYTES), ("1000", 1000)):
            spark.conf.set(name, given)
            extract.markdown()
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)
    pages = spark.createDataFrame([("https://a/", f"<p>{i}</p>" if i % 3 else None) for i in range(30)], "url string, html string").coalesce(1)
    assert [r[0] for r in pages.select(extract.markdown()("url", "html")).collect()] == [str(i) if i % 3 else None for i in range(30)]

