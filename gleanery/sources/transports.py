"""Transports that pass a request to a service: a browser that renders pages, a challenge solver, a scraping API.

Each is a callable that ``fetch`` and ``climb`` take for its step of the ladder, and holds plain values only, so it can
be sent to the executors. ``Browser.capture`` gives what a page asked for while it was rendered.
"""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass, field
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.plans.blueprint import Http
from gleanery.scratch import arrow_schema
from gleanery.sources import guard


def _post(url: str, body: bytes, kind: str, timeout: float) -> bytes:
    ask = urllib.request.Request(url, body, {"Content-Type": kind}, method="POST")
    with urllib.request.urlopen(ask, timeout=timeout) as answer:
        return answer.read()


def _cookies(http: Http, url: str | None = None) -> list[dict]:
    return [{"name": k, "value": str(v), **({"url": url} if url else {})} for k, v in http.cookies.items()]


#: runs in the service's browser: keeps the JSON that the page fetches, build files left out
_LISTENER = """
module.exports = async ({ page }) => {
  const job = %s, kept = new Map();
  if (job.agent) await page.setUserAgent(job.agent);
  await page.setExtraHTTPHeaders(job.headers);
  if (job.cookies.length) await page.setCookie(...job.cookies);
  page.on('response', async (answer) => {
    const at = answer.url(), type = String(answer.headers()['content-type'] || '');
    if (kept.has(at) || !/json/i.test(type) || /\\/_next\\/|manifest\\.json$/.test(at)) return;
    const body = await answer.text().catch(() => '');
    if (body && body.length <= job.longest) kept.set(at, { url: at, method: answer.request().method(), body });
  });
  await page.goto(job.url, { waitUntil: 'networkidle2', timeout: job.timeout });
  await new Promise((done) => setTimeout(done, job.settle));
  const html = await page.content().catch(() => '');
  return { type: 'application/json', data: { html: html.slice(0, job.page), responses: [...kept.values()].slice(0, job.most) } };
};
"""


@dataclass(frozen=True)
class Browser:
    """A service that renders: ``/content`` for a page, ``/function`` for a page and the responses it caused."""

    service: str
    token: str = ""
    wait_for: str = ""

    def _at(self, path: str) -> str:
        return f"{self.service.rstrip('/')}/{path}" + (f"?{urlencode({'token': self.token})}" if self.token else "")

    def __call__(self, method: str, url: str, headers: dict, body: str | None, http: Http) -> tuple[int, str]:
        if method.upper() != "GET":
            raise ValueError("a browser opens addresses: only GET")
        until = {"domcontentloaded": "domcontentloaded", "load": "load", "networkidle": "networkidle0", "networkidle0": "networkidle0"}
        word = self.wait_for.strip()
        ask: dict = {"url": url, "gotoOptions": {"waitUntil": until.get(word.lower(), "networkidle2"), "timeout": max(30, http.timeout) * 1000}}
        if word and word.lower() not in (*until, "networkidle2"):
            ask["waitFor"] = word
        sent = {**http.headers, **headers}
        agent = sent.pop("User-Agent", None)
        ask.update({k: v for k, v in (("userAgent", agent), ("setExtraHTTPHeaders", sent), ("cookies", _cookies(http, url))) if v})
        return 200, _post(self._at("content"), json.dumps(ask).encode(), "application/json", max(30, http.timeout + 15)).decode("utf-8", "replace")

    def capture(self, url: str, http: Http | None = None) -> dict:
        """``{html, responses: [{url, method, body}]}``: the rendered page and the JSON responses seen meanwhile, 25 at most, which is what
        ``infer.propose`` takes. A service that answers with anything else gives an empty page."""
        http = http or Http()
        headers = dict(http.headers)
        job = {
            "url": url, "agent": headers.pop("User-Agent", None), "headers": headers, "cookies": _cookies(http, url), "timeout": max(30, http.timeout) * 1000,
            "longest": 800_000, "settle": 3500, "page": 2_500_000, "most": 25,
        }
        try:
            got = json.loads(_post(self._at("function"), (_LISTENER % json.dumps(job)).encode(), "application/javascript", max(30, http.timeout) + 20))
        except ValueError:
            got = None
        got = got if isinstance(got, dict) else {}
        html, seen = got.get("html"), got.get("responses")
        return {"html": html if isinstance(html, str) else "", "responses": [r for r in seen if isinstance(r, dict)] if isinstance(seen, list) else []}


@dataclass(frozen=True)
class Solver:
    """A service that solves challenges: one command with the address, the page in its answer."""

    service: str
    most_ms: int = 60_000
    proxy: str = ""

    def __call__(self, method: str, url: str, headers: dict, body: str | None, http: Http) -> tuple[int, str]:
        post = method.upper() == "POST"
        ask: dict = {"cmd": "request.post" if post else "request.get", "url": url, "maxTimeout": self.most_ms}
        more = (("postData", body if post else None), ("cookies", _cookies(http)), ("proxy", {"url": self.proxy} if self.proxy else None))
        ask.update({k: v for k, v in more if v})
        got = json.loads(_post(f"{self.service.rstrip('/')}/v1", json.dumps(ask).encode(), "application/json", self.most_ms / 1000 + 30))
        found = got.get("solution") if got.get("status") == "ok" else None
        if not found or "response" not in found:
            raise RuntimeError(f"{url} wasn't solved: {got.get('message', 'no page in the answer')}")
        return int(found.get("status") or 200), str(found["response"])


@dataclass(frozen=True)
class ScrapingApi:
    """A provider that fetches an address given, with its key, as query parameters."""

    service: str
    key: str
    key_param: str = "api_key"
    url_param: str = "url"
    extra: dict = field(default_factory=dict)

    def __call__(self, method: str, url: str, headers: dict, body: str | None, http: Http) -> tuple[int, str]:
        if not self.key:
            raise ValueError("a scraping API needs its key")
        if method.upper() != "GET":
            raise ValueError("a scraping API passes only GET requests on")
        query = urlencode({**self.extra, self.key_param: self.key, self.url_param: url})
        with urllib.request.urlopen(f"{self.service}{'&' if '?' in self.service else '?'}{query}", timeout=max(70, http.timeout)) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")


def captured(pages: DataFrame, browser: Browser, http: Http | None = None, block_private: bool = False, allow: tuple[str, ...] = ()) -> DataFrame:
    """``(page_url, html, url, method, body, error)`` of ``pages(url)``: a row for each response of each page, one with nulls where there was none.

    A page that the guard refuses or that fails has an ``error``. Pages are rendered one after the other in each partition.
    """
    http = http or Http()
    schema, out = arrow_schema("page_url string, html string, url string, method string, body string, error string")

    def run(batches):
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                error = guard.reason(url, block_private, allow)
                got = {"html": None, "responses": []}
                if error is None:
                    try:
                        got = browser.capture(url, http)
                    except Exception as e:  # one page must not end the job: the error is the row's result
                        error = f"{type(e).__name__}: {e}"
                rows += [(url, got["html"], r.get("url"), r.get("method"), r.get("body"), error) for r in got["responses"] or [{}]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return pages.select("url").mapInArrow(run, schema)
