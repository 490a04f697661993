import pytest
from pyspark.sql import functions as F

from gleanery.functions import coerce, heuristics, jsonpath, text, urls
from gleanery.sources import guard

ABSOLUTE = [
    ("https://a.com/x", "https://b.com/y", "https://b.com/y"),
    ("https://a.com/deep/page", "/img/p.jpg", "https://a.com/img/p.jpg"),
    ("https://a.com/", "//cdn.com/p.jpg", "https://cdn.com/p.jpg"),
    ("https://a.com/cat/list.html", "item.html", "https://a.com/cat/item.html"),
    ("https://a.com/a/b/c.html", "../../x.jpg", "https://a.com/x.jpg"),
    ("https://a.com/a/b/", "./x.jpg", "https://a.com/a/b/x.jpg"),
    ("https://a.com:8080/p", "/q", "https://a.com:8080/q"),
    ("https://a.com/", "", None),
    ("https://a.com/", None, None),
    ("a.com/cat/", "item.html", "https://a.com/cat/item.html"),
    ("https://a.com/list.html", "?page=2", "https://a.com/?page=2"),
    ("https://a.com/x/", "/a/b/", "https://a.com/a/b"),
    ("https://a.com", "x", "https://a.com/x"),
    ("https://a.com/a", "../../../y", "https://a.com/y"),
    ("https://a.com/a", "#top", "https://a.com/#top"),
    ("", "https://b.com", "https://b.com"),
    ("", "x", None),
]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_absolute(spark):
    df = spark.createDataFrame(ABSOLUTE, "base string, link string, want string")
    for r in df.select("*", urls.absolute(F.col("base"), F.col("link")).alias("got")).collect():
        assert r["got"] == r["want"], r
        assert urls.absolute_py(r["base"], r["link"]) == r["want"], r


@pytest.mark.parametrize("url, normal, host, ok", [
    (" example.com/x ", "https://example.com/x", "example.com", False), ("//e.com", "https://e.com", "e.com", False), ("HTTP://E.com", "HTTP://E.com", "E.com", True),
    ("", "", "site", False), ("ftp://x.org/a", "ftp://x.org/a", "x.org", False), ("https://u:p@h.com:81/", "https://u:p@h.com:81/", "h.com", True),
])
def test_normalize_host_fetchable(spark, url, normal, host, ok):
    c = F.lit(url)
    assert one(spark, urls.normalize(c)) == normal == urls.normalize_py(url)
    assert one(spark, urls.host(c)) == host == urls.host_py(url)
    assert one(spark, urls.fetchable(c)) == ok == urls.fetchable_py(url)


@pytest.mark.parametrize("value, kind, want", [
    ("R$ 1.234,56", "float", 1234.56), ("1,234", "float", 1234.0), ("1.234,5", "float", 1234.5), ("abc", "float", 0.0), (None, "float", None), ("-3.5.1", "float", -3.5),
    ("1.234,56", "int", 123456), ("no 7", "int", 7), ("5-3", "int", 5), ("--5", "int", 0), ("", "int", 0), ("não", "bool", False), (" Sim ", "bool", True), (None, "bool", None),
    (" x ", "string", "x"), ("x", "date", "x"),
])
def test_coerce(spark, value, kind, want):
    assert one(spark, coerce.coerce(F.lit(value).cast("string"), kind)) == want


def test_coerce_lists(spark):
    many = F.array(F.lit("1"), F.lit("0"), F.lit(""), F.lit("b 2"))
    assert one(spark, coerce.coerce(many, "string", True)) == "1 b 2"
    assert one(spark, coerce.coerce(many, "int[]", True)) == [1, 0, 0, 2]
    assert one(spark, coerce.coerce(F.lit("3"), "float[]")) == [3.0]
    assert one(spark, coerce.coerce(F.lit(None).cast("string"), "int[]")) is None


@pytest.mark.parametrize("value, literal, want", [
    ("R$ 250", r"/R\$\s*([\d.]+)/", "250"), ("R$ 250", r"/\d+/", "250"), ("none", r"/\d+/", None), ("", r"/\d+/", ""), ("ABC", "#b(c)#i", "C"), ("x", "(broken", None), ("a/b", r"/a\/(b)/", "b"),
])
def test_capture(spark, value, literal, want):
    assert one(spark, text.capture(F.lit(value), literal)) == want == text.capture_py(value, literal)


def test_text(spark):
    assert one(spark, text.field_name(F.lit(" Área útil (m²): "))) == "area_util_m" == text.field_name_py(" Área útil (m²): ")
    assert one(spark, text.field_name(F.lit("º"))) == "field" == text.field_name_py("º")
    assert one(spark, text.squash(F.lit(" a \n\t b "))) == "a b"
    assert one(spark, text.snake(F.lit("productName"))) == "product_name"
    assert one(spark, text.shorten(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.visible_length(F.lit("<script>xx</script><p>a <b>b</b></p><!-- c -->"))) == 3
    assert one(spark, text.parse_pairs(F.lit("a=1; b=2=3; a=4; c"), ";", "=")) == {"a": "4", "b": "2=3", "c": ""}


LINKS = [("", -200), ("#x", -200), ("/login", -100), ("/a#b", -100), ("?x=1", -50), ("/my-product-name", 40), ("/p/12345/", 90), ("https://a.com/item/x?utm_a=1", 55), ("/x", 10)]


def test_scores(spark):
    df = spark.createDataFrame(LINKS, "u string, want int")
    for r in df.select("*", heuristics.link_score(F.col("u")).alias("got")).collect():
        assert r["got"] == r["want"] == heuristics.link_score_py(r["u"]), r
    assert one(spark, heuristics.best_image(F.array(F.lit("/logo.png"), F.lit(""), F.lit("/x.png"), F.lit("/photo/1.png"), F.lit("/photo/2.png")))) == "/photo/1.png"
    assert one(spark, heuristics.best_image(F.array().cast("array<string>"))) is None
    assert one(spark, heuristics.unstable_selector(F.lit("div.css-1a2b3c"))) is True
    assert one(spark, heuristics.unstable_selector(F.lit("div.card"))) is False
    assert one(spark, heuristics.bot_vendor(F.lit("<title>Just a moment</title>"))) == "Cloudflare"
    assert one(spark, heuristics.bot_vendor(F.lit("Access Denied"), F.lit(403))) == heuristics.FIREWALL
    assert one(spark, heuristics.bot_vendor(F.lit("Access Denied"), F.lit(200))) is None
    assert one(spark, heuristics.rendered_block(F.lit("cloudflare" + "x" * 3000))) is None
    assert one(spark, heuristics.is_app_shell(F.lit('<div id="app"></div>'))) is True
    assert one(spark, heuristics.is_script_rendered(F.lit("<p>short</p>"))) is True
    html = "<script>fetch('/data/v1/x'); a='/api/items/list'; b=\"/api/search.js\"</script>"
    assert one(spark, heuristics.endpoints(F.lit("https://h.com/a/b"), F.lit(html))) == ["https://h.com/api/items/list", "https://h.com/data/v1/x"]
    assert one(spark, heuristics.image_kind(F.lit(bytearray(b"\x89PNG1234")))) == "png"
    assert one(spark, heuristics.image_kind(F.lit(bytearray(b"RIFFxxxxWEBP")))) == "webp"
    assert one(spark, heuristics.image_name(F.lit("https://a.com/p/my pic.JPG?x"), F.lit(bytearray(b"1")))) == "my_pic.JPG"


def test_json(spark):
    doc = jsonpath.parse(F.lit('{"a": {"0": "key", "b": [10, {"c": true}]}, "l": ["x", "", null, 3], "s": " v "}'))
    assert one(spark, jsonpath.field(doc, "a.0")) == "key"
    assert one(spark, jsonpath.field(doc, "a.b.0")) == "10"
    assert one(spark, jsonpath.field(doc, "a.b.1.c")) == "true"
    assert one(spark, jsonpath.field(doc, "nope.x")) is None
    assert one(spark, jsonpath.field(doc, "s")) == "v"
    assert one(spark, jsonpath.field(doc, "l", multiple=True)) == ["x", "3"]
    assert one(spark, jsonpath.field(doc, "s", multiple=True)) == ["v"]
    assert one(spark, jsonpath.field(doc, "none", multiple=True)) == []
    assert one(spark, jsonpath.field(doc, "a", regex="/x/")) is None
    assert one(spark, jsonpath.parse(F.lit("<html>"))) is None


@pytest.mark.parametrize("url, block, allow, bad", [
    ("ftp://a.com", False, (), True), ("https://a.com", False, (), False), ("http://10.1.2.3/x", False, (), False), ("http://10.1.2.3/x", True, (), True),
    ("http://127.0.0.1:80", True, ("127.0.0.1",), False), ("http://[::1]/", True, (), True), ("http://172.32.0.1/", True, (), False), ("javascript:x", True, (), True), ("x", False, (), True),
])
def test_guard(spark, url, block, allow, bad):
    assert (one(spark, guard.refused(F.lit(url), block, allow)) is not None) == bad
