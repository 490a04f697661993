"""Live fetching: rows of addresses to rows of responses, on the executors.

The analytic plans read fetched tables; this is how such a table is made. Each partition fetches its rows one
after the other, so the number of partitions is the number of connections.
"""

from __future__ import annotations

import itertools
import json
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.heuristics import VENDORS
from gleanery.plans.blueprint import Http
from gleanery.scratch import arrow_schema
from gleanery.sources import guard
from gleanery.sources.pages import cached

#: from the plainest to the most costly
LADDER = ("http", "browser", "challenge_solver", "scraping_api")
Transport = Callable[[str, str, dict, str | None, Http], tuple[int, str]]


class BlockedUrl(ValueError):
    """An address that may not be fetched."""


class BotBlocked(RuntimeError):
    """A response that a bot protection made."""

    def __init__(self, vendor: str, status: int | None, url: str):
        super().__init__(f"{vendor} blocks {url} (status {status})")
        self.vendor, self.status, self.url = vendor, status, url


def vendor_of(body: str) -> str | None:
    low = body.lower()
    return next((name for name, marks in VENDORS if any(m in low for m in marks.split("|"))), None)


class _Redirects(urllib.request.HTTPRedirectHandler):
    """Asks before it follows."""

    def __init__(self, check: Callable[[str], str | None]):
        self.check = check

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        bad = self.check(newurl)
        if bad:
            raise BlockedUrl(f"redirect to {newurl}: {bad}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def plain(method: str, url: str, headers: dict, body: str | None, http: Http, check: Callable[[str], str | None] = lambda url: None) -> tuple[int, str]:
    """One request by the standard library, proxies in turn, cookies as a header; ``check`` says why a redirect may not be followed."""
    handlers: list = [_Redirects(check)]
    if http.proxies:
        proxy = next(_turn(http.proxies))
        handlers.append(urllib.request.ProxyHandler({"http": proxy, "https": proxy}))
    if not http.verify_tls:
        import ssl

        handlers.append(urllib.request.HTTPSHandler(context=ssl._create_unverified_context()))
    sent = {"User-Agent": "Mozilla/5.0 (compatible)", **http.headers, **headers}
    if http.cookies:
        sent.setdefault("Cookie", "; ".join(f"{k}={v}" for k, v in http.cookies.items()))
    ask = urllib.request.Request(url, body.encode() if body is not None else None, sent, method=method)
    with urllib.request.build_opener(*handlers).open(ask, timeout=http.timeout) as r:
        return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


_TURNS: dict[tuple[str, ...], Iterator[str]] = {}


def _turn(proxies: tuple[str, ...]) -> Iterator[str]:
    return _TURNS.setdefault(proxies, itertools.cycle(proxies))


def with_retries(ask: Callable[[], tuple[int, str]], http: Http) -> tuple[int, str]:
    """Errors and statuses from 500 are tried again; refused connections and other statuses aren't."""
    for left in range(max(1, http.retry_count), 0, -1):
        try:
            return ask()
        except urllib.error.HTTPError as e:
            if e.code < 500 or left == 1:
                return e.code, e.read().decode("utf-8", "replace")
        except urllib.error.URLError as e:
            if left == 1 or isinstance(e.reason, (ConnectionRefusedError, socket.gaierror)):
                raise
        except (TimeoutError, ConnectionError):
            if left == 1:
                raise
        time.sleep(http.retry_delay_ms / 1000)
    raise AssertionError("unreachable")


def climb(url: str, transports: dict[str, Transport], http: Http, method: str = "GET", headers: dict | None = None, body: str | None = None) -> tuple[int, str]:
    """The first transport of the ladder whose response no protection blocks; once a vendor is known plain requests are passed over."""
    blocked: BotBlocked | None = None
    for name in (n for n in LADDER if n in transports):
        if blocked and name == "http":
            continue
        status, text = with_retries(lambda name=name: transports[name](method, url, headers or {}, body, http), http)
        vendor = vendor_of(text) if status in (403, 429, 503) else None
        if vendor is None:
            return status, text
        blocked = BotBlocked(vendor, status, url)
    raise blocked or ValueError("no transport")


def fetch(
    requests: DataFrame, http: Http | None = None, block_private: bool = False, allow: tuple[str, ...] = (), transports: dict[str, Transport] | None = None
) -> DataFrame:
    """``(url, status, html, error, latency_ms, fetched_at)`` of ``requests(url[, method, headers MAP, body])``.

    An address that the guard refuses, after looking up its host, and a request that fails, have an ``error`` and no
    ``html``; null addresses are refused. Rows wait ``delay_ms`` after each other within a partition.
    """
    http = http or Http()
    check = partial(guard.reason, block_private=block_private, allow=allow)
    ladder = transports or {"http": partial(plain, check=check)}
    have = requests.columns
    df = requests.select(
        "url", (F.col("method") if "method" in have else F.lit("GET")).alias("method"),
        F.to_json("headers").alias("headers") if "headers" in have else F.lit("{}").alias("headers"),
        (F.col("body") if "body" in have else F.lit(None).cast("string")).alias("body"),
    )
    schema, out = arrow_schema("url string, status int, html string, error string, latency_ms double, fetched_at timestamp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                began, status, html, error = time.time(), None, None, check(r["url"])
                if error is None:
                    try:
                        status, html = climb(r["url"], ladder, http, r["method"], json.loads(r["headers"] or "{}"), r["body"])
                    except Exception as e:  # one address must not end the job: the error is the row's result
                        error = f"{type(e).__name__}: {e}"
                    if http.delay_ms:
                        time.sleep(http.delay_ms / 1000)
                rows.append((r["url"], status, html, error, (time.time() - began) * 1000, int(began * 1e6)))
            if rows:
                cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), out)]
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    return df.mapInArrow(run, schema)



def fetch_through(requests: DataFrame, store: DataFrame, ttl: int, **more) -> DataFrame:
    """``fetch`` with a cache: ``(url, status, html, error, latency_ms, fetched_at, hit)``.

    ``store`` is an earlier result of ``fetch``. Plain GET requests whose address has an answer there that is younger
    than ``ttl`` seconds (0: of any age) are answered by the youngest one; the others are fetched. Add the rows that aren't hits to the store.
    """
    good = store.where("error IS NULL AND status BETWEEN 200 AND 299").select("url", "fetched_at", F.struct("status", "html", "fetched_at").alias("body"))
    known = cached(good, ttl).withColumnRenamed("key", "~key")
    plain_get = (F.upper("method") == "GET") if "method" in requests.columns else F.lit(True)
    body = F.col("body").isNull() if "body" in requests.columns else F.lit(True)
    key = F.when(plain_get & body, F.sha1(F.col("url").cast("binary")))
    asked = requests.withColumn("~key", key).join(known.withColumnRenamed("body", "~answer"), "~key", "left")
    hits = asked.where("`~answer` IS NOT NULL").select(
        "url", "`~answer`.status", "`~answer`.html", F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("latency_ms"), "`~answer`.fetched_at", F.lit(True).alias("hit")
    )
    rest = asked.where("`~answer` IS NULL").select(*[f"`{c}`" for c in requests.columns])
    return hits.unionByName(fetch(rest, **more).withColumn("hit", F.lit(False)))
