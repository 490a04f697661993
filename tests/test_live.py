import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from gleanery.__main__ import main, robot
from gleanery.plans.blueprint import Blueprint, Field, Http, InfiniteScroll
from gleanery.sinks.emit import Webhook, batches, emit, upsert_statements
from gleanery.sources.fetch import BotBlocked, climb, fetch, fetch_through
from gleanery.plans.infer import best_response, propose
from gleanery.sources.pages import scroll_requests
from gleanery.sources.transports import Browser, ScrapingApi, Solver, captured


@pytest.fixture(scope="module")
def site():
    posted = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/jump":
                self.send_response(302)
                self.send_header("Location", f"http://localhost:{self.server.server_port}/ok")
                self.end_headers()
                return
            code = {"/ok": 200, "/blocked": 403}.get(self.path, 404)
            text = {"/ok": f"<p>{self.headers.get('Cookie')}</p>", "/blocked": "cloudflare says no"}.get(self.path, "gone")
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

        def do_POST(self):
            posted.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", posted
    server.shutdown()


def test_fetch(spark, site):
    url = site[0]
    asked = spark.createDataFrame([(f"{url}/ok",), (f"{url}/none",), (f"{url}/blocked",), ("ftp://x",), (None,), ("http://127.0.0.1:1/",)], "url string")
    got = {r["url"]: r for r in fetch(asked, Http(cookies={"a": "1"}, retry_count=1, timeout=5)).collect()}
    assert (got[f"{url}/ok"]["status"], got[f"{url}/ok"]["html"]) == (200, "<p>a=1</p>")
    assert (got[f"{url}/none"]["status"], got[f"{url}/none"]["error"]) == (404, None)
    assert "Cloudflare" in got[f"{url}/blocked"]["error"] and got["ftp://x"]["error"] and got[None]["error"] and got["http://127.0.0.1:1/"]["error"]
    assert all("private" in r["error"] for r in fetch(asked.where("url LIKE 'http:%'"), block_private=True).collect())
    assert fetch(asked.limit(0)).count() == 0
    jump = spark.createDataFrame([(f"{url}/jump",)], "url string")
    assert fetch(jump, Http(retry_count=1, timeout=5)).first()["status"] == 200
    kept = fetch(jump, Http(retry_count=1, timeout=5), block_private=True, allow=("127.0.0.1",)).first()
    assert kept["html"] is None and "redirect" in kept["error"]


def test_cache_before_fetching(spark, site):
    url, posted = site
    http = Http(retry_count=1, timeout=5)
    asked = spark.createDataFrame([(f"{url}/ok", "GET", None), (f"{url}/none", "GET", None), (f"{url}/ok", "POST", "{}")], "url string, method string, body string")
    store = spark.createDataFrame(fetch(asked.where("method = 'GET'"), http).collect(), fetch(asked, http).schema)
    got = sorted((r["url"][-4:], r["status"], r["hit"], r["html"]) for r in fetch_through(asked, store, 600, http=http).collect())
    # answers that failed aren't kept, and only plain GET requests are looked up
    assert got == sorted([(f"{url}/ok"[-4:], 200, True, "<p>None</p>"), (f"{url}/ok"[-4:], 204, False, ""), ("none", 404, False, "gone")])
    assert posted.pop() == {}
    old = store.withColumn("fetched_at", F.expr("fetched_at - INTERVAL 1 DAY"))
    assert not any(r["hit"] for r in fetch_through(asked, old, 600, http=http).collect()) and any(r["hit"] for r in fetch_through(asked, old, 0, http=http).collect())
    posted.clear()


def test_scroll_requests_carry_the_token(spark):
    bp = Blueprint(url="https://s.com/", infinite_scroll=InfiniteScroll("https://s.com/more", token_css="meta[name=csrf]", token_attribute="content", start=20))
    pages = spark.createDataFrame([("https://s.com/", "<meta name=csrf content=' t1 '>"), ("https://s.com/x", "<meta name=csrf content=no>")], "url string, html string")
    got = scroll_requests(spark, bp, pages, 2)
    assert [(r["value"], r["body"]) for r in got] == [(20, "page=20&_token=t1"), (40, "page=40&_token=t1")]
    assert scroll_requests(spark, bp, pages.limit(0), 1)[0]["body"] == "page=20" and scroll_requests(spark, Blueprint(), pages, 3) == []


@pytest.fixture(scope="module")
def services():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, value):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(value if isinstance(value, bytes) else json.dumps(value).encode())

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            asked.append((self.path, body))
            if self.path.startswith("/content"):
                return self.answer(b"<p>rendered</p>")
            if self.path.startswith("/function"):
                bad = "refused.test" in body
                return self.answer([1] if bad else {"html": "<p>r</p>", "responses": [{"url": "https://a.test/api", "method": "GET", "body": '[{"a": 1, "b": 2}]'}]})
            ok = "hard.test" not in body
            return self.answer({"status": "ok", "solution": {"status": 200, "response": "<p>solved</p>"}} if ok else {"status": "error", "message": "too hard"})

        def do_GET(self):
            asked.append((self.path, ""))
            self.answer(b"<p>api</p>")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_service_transports(services):
    base, asked = services
    http = Http(cookies={"a": "1"}, headers={"X": "y", "User-Agent": "me"})
    browser, solver, api = Browser(base, "t&k", ".card"), Solver(base + "/", proxy="http://p"), ScrapingApi(base + "/get", "key", extra={"render": "true"})
    assert browser("GET", "https://a.test/", {"Z": "1"}, None, http) == (200, "<p>rendered</p>")
    path, body = asked[-1]
    sent = json.loads(body)
    assert path == "/content?token=t%26k" and sent["waitFor"] == ".card" and sent["gotoOptions"]["waitUntil"] == "networkidle2" and sent["userAgent"] == "me"
    assert sent["setExtraHTTPHeaders"] == {"X": "y", "Z": "1"} and sent["cookies"] == [{"name": "a", "value": "1", "url": "https://a.test/"}]
    Browser(base, wait_for="networkidle")("GET", "https://a.test/", {}, None, Http())
    assert json.loads(asked[-1][1])["gotoOptions"]["waitUntil"] == "networkidle0" and "waitFor" not in json.loads(asked[-1][1])
    assert solver("POST", "https://a.test/", {}, "q=1", http) == (200, "<p>solved</p>")
    assert json.loads(asked[-1][1]) == {"cmd": "request.post", "url": "https://a.test/", "maxTimeout": 60000, "postData": "q=1", "cookies": [{"name": "a", "value": "1"}], "proxy": {"url": "http://p"}}
    with pytest.raises(RuntimeError, match="too hard"):
        solver("GET", "https://hard.test/", {}, None, http)
    assert api("GET", "https://a.test/?x=1", {}, None, http) == (200, "<p>api</p>") and asked[-1][0] == "/get?render=true&api_key=key&url=https%3A%2F%2Fa.test%2F%3Fx%3D1"
    for bad in (lambda: api("POST", "u", {}, "", http), lambda: ScrapingApi(base, "")("GET", "u", {}, None, http), lambda: browser("POST", "u", {}, "", http)):
        with pytest.raises(ValueError):
            bad()


def test_captures(spark, services):
    browser = Browser(services[0])
    pages = spark.createDataFrame([("https://a.test/",), ("https://refused.test/",), ("ftp://x",), (None,)], "url string")
    got = {r["page_url"]: r for r in captured(pages, browser).collect()}
    assert (got["https://a.test/"]["url"], got["https://a.test/"]["html"], got["https://a.test/"]["error"]) == ("https://a.test/api", "<p>r</p>", None)
    assert got["https://refused.test/"]["url"] is None and got["https://refused.test/"]["html"] == "" and "scheme" in got["ftp://x"]["error"] and got[None]["error"]
    assert best_response(captured(pages, browser).select("url", "method", "body")).first()["url"] == "https://a.test/api"
    bp = propose("https://a.test/", "<body><div id='app'></div></body>", [{"url": "https://a.test/api", "method": "GET", "body": json.dumps([{"id": i, "name": "n"} for i in range(9)])}])
    assert bp.mode == "api" and bp.api.endpoint == "https://a.test/api"
    rendered = fetch(pages.where("url = 'https://a.test/'"), Http(timeout=5), transports={"browser": browser}).first()
    assert (rendered["status"], rendered["html"]) == (200, "<p>rendered</p>")


def test_ladder():
    tried = []

    def answer(name, status, text):
        return lambda *a: tried.append(name) or (status, text)

    ladder = {"http": answer("http", 403, "datadome"), "browser": answer("browser", 200, "fine")}
    assert climb("https://a.com", ladder, Http()) == (200, "fine") and tried == ["http", "browser"]
    with pytest.raises(BotBlocked) as e:
        climb("https://a.com", {"http": ladder["http"]}, Http())
    assert e.value.vendor == "DataDome"


def test_emit(spark, site):
    class Picky:
        def open(self):
            pass

        def write(self, item):
            if item["id"] == 2:
                raise ValueError("no")

        def close(self):
            pass

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    assert emit(df, Picky()) == (2, 1)
    assert emit(df.coalesce(1), Webhook(site[0] + "/hook", 2)) == (3, 0)
    assert site[1] == [[{"id": 1, "v": "a"}, {"id": 2, "v": None}], [{"id": 3, "v": "c"}]]
    assert [len(b) for b in batches(iter([{}] * 5), 2)] == [2, 2, 1]
    r = upsert_statements(df, "t", ("id",)).first()
    assert r["statement"].startswith('MERGE INTO "t" t USING (VALUES (?, ?))') and json.loads(r["parameters"]) == ["1", "a"]


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    bp = Blueprint(url="https://s.com/", item_selector="li", fields=(Field("link", "a", "href"),))
    (tmp_path / "blueprints").mkdir()
    (tmp_path / "blueprints/x.json").write_text(bp.dump())
    html = "<ul><li><a href='/a'>A</a><li><a href='/b'>B</a></ul>"
    (tmp_path / "p.html").write_text(html)
    spark.createDataFrame([("https://s.com/", html)], "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert main(["validate", "x"]) == 0 and main(["run", "x", "--pages", f"{tmp_path}/pages.parquet", "--limit", "1"]) == 0
    assert json.loads(capsys.readouterr().out) == [{"link": "https://s.com/a"}]
    assert main(["shell", "p.html", "a", "--attribute", "href"]) == 0 and capsys.readouterr().out == "/a\n/b\n"
    assert main(["generate", "p.html", "--url", "https://s.com/"]) == 1 and "scripts" in capsys.readouterr().err
    assert main(["generate", "p.html", "--url", "https://s.com/", "--single-page"]) == 0
    assert Blueprint.load(capsys.readouterr().out).url == "https://s.com/"
    assert "BLUEPRINT" in robot("x", bp.dump()) and main(["robot", "x", "x"]) == 0
    with pytest.raises(SystemExit):
        main(["validate", "none"])
