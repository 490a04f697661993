"""Which pages a source reads, in order: ``(source_ord, page_ord, url)`` from a table of fetched pages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.dom.extract import links, next_link, token
from gleanery.functions.urls import source_url
from gleanery.plans.blueprint import Blueprint
from gleanery.scratch import arrow_schema, write_shared
from gleanery.sources.requests import scroll_request


def capped(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pages of each source, all for 0, a repeated address once."""
    first = F.row_number().over(Window.partitionBy("source_ord", "url").orderBy("page_ord")) == 1
    df = df.withColumn("_first", first).where("_first").drop("_first")
    order = F.row_number().over(Window.partitionBy("source_ord").orderBy("page_ord"))
    df = df.withColumn("page_ord", (order - 1).cast("bigint"))
    return df.where(F.col("page_ord") < most) if most > 0 else df


def starts(spark: SparkSession, bp: Blueprint) -> DataFrame:
    """``(source_ord, url)``: the address of every source."""
    rows = [(i, s.suffix) for i, s in enumerate(bp.sources)] or [(0, "")]
    df = spark.createDataFrame(rows, "source_ord bigint, suffix string")
    return df.select("source_ord", source_url(F.lit(bp.url), F.col("suffix")).alias("url"))


def one_each(pages: DataFrame) -> DataFrame:
    """``(url, html)``, one row an address (the least HTML), so that lookups don't multiply items."""
    return pages.where("url IS NOT NULL").groupBy("url").agg(F.min("html").alias("html"))


def page_list(spark: SparkSession, bp: Blueprint, pages: DataFrame) -> DataFrame:
    """Pages of every source by the blueprint's pagination, capped by ``max_pages``.

    ``link_list`` is the start page and then the links of its matches; ``next_link`` follows the first match
    until there is none, the address was read already, or the cap; other strategies read the start page.
    """
    first = starts(spark, bp)
    here = first.select("source_ord", F.lit(0).cast("bigint").alias("page_ord"), "url")
    if bp.pagination.strategy == "link_list" and bp.pagination.css:
        found = first.join(pages.select("url", "html"), "url").select("source_ord", F.posexplode(links(bp.pagination.css)("url", "html")).alias("at", "url"))
        return capped(here.unionByName(found.select("source_ord", (F.col("at") + 1).cast("bigint").alias("page_ord"), "url")), bp.max_pages)
    if bp.pagination.strategy != "next_link" or not bp.pagination.css:
        return here
    # one pass reads every page's next link; each hop then joins its few tips to narrow rows
    edges, _ = write_shared(pages.select("url", next_link(bp.pagination.css)("url", "html").alias("to")).where("`to` IS NOT NULL").distinct(), "edges")
    done, path = write_shared(here, "chain")
    tip, hop, paths = done, 1, [path]
    while bp.max_pages <= 0 or hop < bp.max_pages:
        step = tip.select("source_ord", "url").join(edges, "url").select("source_ord", F.lit(hop).cast("bigint").alias("page_ord"), F.col("to").alias("url"))
        tip, path = write_shared(step.join(done.select("source_ord", "url"), ["source_ord", "url"], "left_anti"), "chain")
        if tip.isEmpty():
            break
        paths.append(path)
        # the folders of all hops are one table: the plan doesn't grow with them
        done, hop = spark.read.schema(here.schema).parquet(*paths), hop + 1
    return done


def fragments(spark: SparkSession, bp: Blueprint, responses: DataFrame) -> DataFrame:
    """Infinite-scroll batches in order, ``(page_ord, url, html)``, from ``responses(value BIGINT, html)``.

    Batch *i* asks with the configured value; at most ``max_pages - 1`` batches. It stops before a missing
    response or a payload equal to the one before. Batches without items are cut by the run.
    """
    scroll = bp.infinite_scroll
    if scroll is None:
        return spark.createDataFrame([], "page_ord bigint, url string, html string")
    step = F.lit(1 if scroll.param_mode == "page" else scroll.page_size)
    at = (F.col("value") - F.lit(scroll.start)) / step
    got = responses.where((at >= 0) & (at == F.floor(at))).select((F.floor(at) + 1).cast("bigint").alias("page_ord"), "value", "html")
    got = got.groupBy("page_ord").agg(F.min("html").alias("html"))
    if bp.max_pages > 0:
        got = got.where(F.col("page_ord") <= bp.max_pages - 1)
    got, _ = write_shared(got, "fragments")
    # where it ends is found on hashes alone
    one = got.select("page_ord", F.md5("html").alias("sign"))
    before = one.select((F.col("page_ord") + 1).alias("page_ord"), F.col("sign").alias("last"), F.lit(True).alias("there"))
    bad = F.coalesce(F.col("sign") == F.col("last"), F.lit(False)) | (F.col("page_ord") > 1) & F.col("there").isNull()
    end = one.join(before, "page_ord", "left").agg(F.min(F.when(bad, F.col("page_ord"))).alias("end"))
    got = got.crossJoin(F.broadcast(end)).where("end IS NULL OR page_ord < end")  # one row
    return got.select("page_ord", F.lit(scroll.endpoint).alias("url"), "html")


def scroll_requests(spark: SparkSession, bp: Blueprint, pages: DataFrame, count: int) -> list[dict]:
    """The first ``count`` requests of an infinite scroll, with the token that the start page holds; ``value`` names each one's answer.

    None without settings. A token that isn't there is left out of the requests.
    """
    scroll = bp.infinite_scroll
    if scroll is None:
        return []
    found = None
    if scroll.token_css:
        start = pages.where(F.col("url") == bp.url).select(token(scroll.token_css, scroll.token_attribute)("url", "html").alias("t"))
        row = start.agg(F.min("t")).first()  # one page's
        found = row[0]
    return [{"value": scroll.value(i), **scroll_request(scroll, i, found)} for i in range(count)]


def cached(responses: DataFrame, ttl: int, now: str | None = None) -> DataFrame:
    """Fresh rows of ``responses(url, fetched_at, body)`` keyed by the hash of the URL, the latest of each; ``ttl`` 0 keeps all."""
    when = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    age = F.unix_timestamp(when) - F.unix_timestamp("fetched_at")
    fresh = responses if ttl == 0 else responses.where(age < ttl)
    return fresh.groupBy(F.sha1(F.col("url").cast("binary")).alias("key")).agg(F.max_by("body", "fetched_at").alias("body"))


def replayed(requests: DataFrame, ttl: int) -> DataFrame:
    """``(url, at, hit)``: which of ``requests(url, at DOUBLE)`` a cache would answer.

    A hit doesn't renew its entry, so each URL's requests are gone through in order, once.
    """
    schema, out = arrow_schema("url string, at double, hit boolean")

    def run(batches):
        current, since = None, None
        for batch in batches:
            hits = []
            for url, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if url != current:
                    current, since = url, None
                hit = since is not None and (ttl == 0 or at - since < ttl)
                since = since if hit else at
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], schema=out)

    df = requests.where("url IS NOT NULL AND at IS NOT NULL").select("url", F.col("at").cast("double").alias("at"))
    return df.repartition("url").sortWithinPartitions("url", "at").mapInArrow(run, schema)

