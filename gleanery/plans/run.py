"""Compiling a blueprint to a DataFrame plan and running it over fetched pages or responses."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.columns import DETAIL, DOC, FIRST, FOUND, INNER, ITEM, KEPT, LINK, ORDER, PAGE, PAGE_URL, SOURCE, TOTAL, refuse
from gleanery.dom.extract import extract
from gleanery.functions import jsonpath
from gleanery.functions.urls import absolute
from gleanery.operators import images, pipeline, shape, sink
from gleanery.plans.blueprint import Blueprint
from gleanery.scratch import write_shared
from gleanery.sources import pages as page_sources
from gleanery.sources.requests import filled


def _checked(bp: Blueprint) -> None:
    refuse(f.name for f in (*bp.fields, *bp.detail_fields))
    refuse(k for s in bp.sources for k in s.tags)


def _tagged(df: DataFrame, bp: Blueprint) -> DataFrame:
    """Constant columns of each source; a tag that a source lacks leaves the field's own value."""
    for name in dict.fromkeys(k for s in bp.sources for k in s.tags):
        own = F.col(f"`{name}`") if name in df.columns else None
        value = own
        for i, s in enumerate(bp.sources):
            if name in s.tags:
                tag = F.lit(s.tags[name])
                if own is not None:
                    tag = tag.cast(df.schema[name].dataType)
                value = F.when(F.col(SOURCE) == i, tag) if value is None else F.when(F.col(SOURCE) == i, tag).otherwise(value)
        df = df.withColumn(name, value)
    return df


def _merged(df: DataFrame, details: DataFrame, names: list[str]) -> DataFrame:
    """Detail values over list values wherever a detail was found, nulls and empty lists included."""
    found = F.col(FOUND).isNotNull()
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    merged = []
    for n in names:
        theirs = F.col(f"`{DETAIL}{n}`")
        if n in df.columns and dict(df.dtypes)[n] == dict(details.dtypes)[f"{DETAIL}{n}"]:
            merged.append(F.when(found, theirs).otherwise(F.col(f"`{n}`")).alias(n))
        else:
            merged.append(theirs.alias(n))
    return df.join(details, LINK, "left").select(*kept, *merged).drop(LINK)


def html_details(df: DataFrame, bp: Blueprint, pages: DataFrame) -> DataFrame:
    """Detail pages merged by the items' absolute link; items without a fetched detail page stay as they are."""
    if not (bp.scrape_detail and bp.detail_fields and bp.detail_link_field in df.columns):
        return df
    # written, since the links are read before the items are: list pages are parsed once
    df, _ = write_shared(df.withColumn(LINK, absolute(F.col(PAGE_URL), F.col(f"`{bp.detail_link_field}`"))), "items")
    got = extract(_asked(pages, df.select(F.col(LINK).alias("url"))), bp.detail_fields, None)
    names = list(dict.fromkeys(f.name for f in bp.detail_fields))
    got = got.select(F.col(PAGE_URL).alias(LINK), F.lit(True).alias(FOUND), *[F.col(f"`{n}`").alias(f"{DETAIL}{n}") for n in names])
    return _merged(df, got, names)


def _asked(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages, one an address, that ``wanted(url)`` asks for: what isn't asked for is neither moved nor parsed."""
    wanted = wanted.where("url IS NOT NULL").distinct()
    return page_sources.one_each(pages.select("url", "html").join(wanted, "url", "left_semi"))


def _finish(
    df: DataFrame, bp: Blueprint, limit: int, seen: DataFrame | None, registry: Mapping[str, pipeline.Step] | None, shaped: bool,
    observe: Callable[[DataFrame], None] | None, ordered: bool,
) -> DataFrame:
    df = pipeline.apply(df, pipeline.build(bp.pipeline, bp.item_schema, bp.image_path_prefix, registry))
    quotas = {i: s.limit for i, s in enumerate(bp.sources)}
    df = sink.accept(df, bp.dedup_key if bp.dedup else None, bp.rules if bp.filter else (), limit if limit > 0 else bp.max_items, quotas, seen, observe, ORDER)
    return _given(df, bp, shaped, ordered)


def _given(df: DataFrame, bp: Blueprint, shaped: bool, ordered: bool) -> DataFrame:
    df = images.shape(df, bp.primary_image, bp.gallery_images, bp.all_images)
    df = df.orderBy(*ORDER) if ordered else df
    return shape.shaped(df.drop(*INNER), bp.output) if shaped else df


def html_items(spark: SparkSession, bp: Blueprint, pages: DataFrame, scrolled: DataFrame | None = None) -> DataFrame:
    """Items of all pages of all sources, tagged and with details, in columns (order, page, fields)."""
    _checked(bp)
    listed = page_sources.page_list(spark, bp, pages)
    found = listed.join(_asked(pages, listed.select("url")), "url").select(F.col("source_ord").alias(SOURCE), F.col("page_ord").alias(PAGE), "url", "html")
    df = _tagged(extract(found, bp.fields, bp.item_selector, (SOURCE, PAGE)), bp)
    if scrolled is not None and bp.infinite_scroll is not None:
        batches = page_sources.fragments(spark, bp, scrolled).select(F.lit(0).cast("bigint").alias(SOURCE), F.col("page_ord").alias(PAGE), F.lit(bp.url).alias("url"), "html")
        more = extract(batches, bp.fields, bp.infinite_scroll.item_selector or bp.item_selector, (SOURCE, PAGE))
        if bp.infinite_scroll.stop_when_empty:
            more, _ = write_shared(more, "fragments")
            full = more.select(PAGE).distinct()
            gap = batches.select(PAGE).join(full, PAGE, "left_anti").agg(F.min(PAGE).alias("~end"))
            more = more.crossJoin(F.broadcast(gap)).where(F.col("~end").isNull() | (F.col(PAGE) < F.col("~end"))).drop("~end")
        # tags and quotas don't reach into fragments
        df = df.unionByName(more, allowMissingColumns=True)
    return html_details(df, bp, pages)


def run_html(
    spark: SparkSession, bp: Blueprint, pages: DataFrame, limit: int = 0, seen: DataFrame | None = None, scrolled: DataFrame | None = None,
    registry: Mapping[str, pipeline.Step] | None = None, shaped: bool = True, observe: Callable[[DataFrame], None] | None = None, ordered: bool = False,
) -> DataFrame:
    """An HTML blueprint over ``pages(url, html)``.

    ``seen(key)`` are keys of earlier runs, ``limit`` beats the blueprint's own, ``scrolled(value, html)`` are
    infinite-scroll responses. Unless ``shaped`` the engine's columns stay (``gleanery.columns``). Which items are
    taken depends on their order; the rows come sorted by it only if ``ordered``, as writers of files ask.
    """
    return _finish(html_items(spark, bp, pages, scrolled), bp, limit, seen, registry, shaped, observe, ordered)


def all_pages(bp: Blueprint, pages: DataFrame, order: str = "url") -> DataFrame:
    """A blueprint's items of every page of a corpus, each page a source page of its own: no page lists, no limits."""
    at = F.xxhash64(F.col(f"`{order}`")) if order == "url" else F.col(f"`{order}`").cast("bigint")
    _checked(bp)
    df = pages.select(F.lit(0).cast("bigint").alias(SOURCE), at.alias(PAGE), "url", "html")
    df = extract(df, bp.fields, bp.item_selector or None, (SOURCE, PAGE))
    return pipeline.apply(df, pipeline.build(bp.pipeline, bp.item_schema, bp.image_path_prefix))


def _json_fields(doc, fields) -> list:
    return [jsonpath.field(doc, f.css, f.multiple, f.regex).alias(f.name) for f in {f.name: f for f in fields}.values()]


def api_records(bp: Blueprint, responses: DataFrame) -> DataFrame:
    """Records of ``responses(source_ord, page_ord, body)`` as (order, total, record VARIANT).

    A source ends before a response that isn't a JSON list or object, that has no records at the items path, whose
    records equal those of the page before, or whose page number is missing or occurs twice; after one page if
    there is no paging. Where each source ends is found on (source, page, hash, size) alone, so no payload is
    moved: two numbers a source then go to the scan of the responses.
    """
    api = bp.api
    df = responses.select(F.col("source_ord").alias(SOURCE), F.col("page_ord").alias(PAGE), "body")
    if bp.max_pages > 0:
        df = df.where(F.col(PAGE) < bp.max_pages)
    if api.page_param is None and "{page}" not in api.endpoint and "{page_size}" not in api.endpoint:
        df = df.where(F.col(PAGE) == 0)
    df = df.select(SOURCE, PAGE, jsonpath.parse(F.col("body")).alias(DOC))
    records = F.try_variant_get(jsonpath.get(F.col(DOC), api.items_path), "$", "array<variant>")
    total = jsonpath.get(F.col(DOC), api.total_path, "double").cast("bigint") if api.total_path else F.lit(None).cast("bigint")
    one = df.select(SOURCE, PAGE, F.md5(F.to_json(records)).alias("sign"), F.size(records).alias("n"), total.alias(TOTAL))
    one = one.groupBy(SOURCE, PAGE).agg(F.count(F.lit(1)).alias("times"), *[F.max(c).alias(c) for c in ("sign", "n", TOTAL)])
    one, _ = write_shared(one, "pages-read")
    before = one.select(SOURCE, (F.col(PAGE) + 1).alias(PAGE), F.col("sign").alias("last"), F.lit(True).alias("there"))
    one = one.join(before, [SOURCE, PAGE], "left")
    bad = (F.col("times") > 1) | ~F.coalesce(F.col("n") > 0, F.lit(False)) | F.coalesce(F.col("sign") == F.col("last"), F.lit(False)) | (F.col(PAGE) > 0) & F.col("there").isNull() | (F.col(PAGE) < 0)
    told = F.min(F.when(F.col(TOTAL).isNotNull(), F.struct(PAGE, TOTAL)))
    ends = one.groupBy(SOURCE).agg(F.min(F.when(bad, F.col(PAGE))).alias("~end"), told.alias("~told"))
    df = df.join(F.broadcast(ends), SOURCE).where(F.col("~end").isNull() | (F.col(PAGE) < F.col("~end")))
    known = F.when(F.col(PAGE) >= F.col("~told").getField(PAGE), F.col("~told").getField(TOTAL))
    df = df.select(SOURCE, PAGE, known.alias(TOTAL), F.posexplode(records).alias(ITEM, DOC))
    return df.where(F.schema_of_variant(DOC).rlike("^(OBJECT|ARRAY)")).withColumn(ITEM, F.col(ITEM).cast("bigint"))


def api_details(df: DataFrame, bp: Blueprint, details: DataFrame | None) -> DataFrame:
    """Detail responses ``details(url, body)`` merged by the filled-in detail address."""
    if details is None or not (bp.api.detail.enabled and bp.detail_fields):
        return df
    link = filled(bp.api.detail.endpoint, {c: F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("array")})
    df, _ = write_shared(df.withColumn(LINK, link), "items")
    wanted = df.select(F.col(LINK).alias("url")).where("url IS NOT NULL").distinct()
    one = details.select("url", "body").join(wanted, "url", "left_semi").groupBy("url").agg(F.min("body").alias("body"))
    node = jsonpath.get(jsonpath.parse(F.col("body")), bp.api.detail.items_path)
    names = list(dict.fromkeys(f.name for f in bp.detail_fields))
    got = one.select("url", node.alias(DOC)).where(jsonpath.is_nested(F.col(DOC)))
    got = got.select(F.col("url").alias(LINK), F.lit(True).alias(FOUND), *[c.alias(f"{DETAIL}{n}") for n, c in zip(names, _json_fields(F.col(DOC), bp.detail_fields))])
    return _merged(df, got, names)


def run_api(
    spark: SparkSession, bp: Blueprint, responses: DataFrame, details: DataFrame | None = None, limit: int = 0, seen: DataFrame | None = None,
    registry: Mapping[str, pipeline.Step] | None = None, shaped: bool = True, observe: Callable[[DataFrame], None] | None = None, ordered: bool = False,
) -> DataFrame:
    """An API blueprint over ``responses(source_ord, page_ord, body)``, page_ord from 0. An empty endpoint gives no rows.

    A page that keeps nothing while dropping duplicates is a source's last, and so is the page with which
    all sources together reach the reported total. Rows are sorted only if ``ordered``.
    """
    names = {f.name: f for f in bp.fields}
    if bp.api is None or not bp.api.endpoint:
        return spark.createDataFrame([], ", ".join(f"`{n}` {'array<string>' if f.multiple else 'string'}" for n, f in names.items()) or "_none string")
    _checked(bp)
    df = api_records(bp, responses)
    df = df.select(*ORDER, TOTAL, F.lit(bp.url).alias(PAGE_URL), *_json_fields(F.col(DOC), bp.fields))
    df = api_details(_tagged(df, bp), bp, details)
    df = pipeline.apply(df, pipeline.build(bp.pipeline, bp.item_schema, bp.image_path_prefix, registry))
    key, rules = bp.dedup_key if bp.dedup else None, bp.rules if bp.filter else ()
    if not any(s.limit for s in bp.sources) and (key is not None or bp.api.total_path):
        # written, as the pages are judged before the items are: responses are read once
        df = _page_cuts(write_shared(df, "items")[0], key, rules, seen)
    quotas = {i: s.limit for i, s in enumerate(bp.sources)}
    df = sink.accept(df.drop(TOTAL), key, rules, limit if limit > 0 else bp.max_items, quotas, seen, observe, ORDER)
    return _given(df, bp, shaped, ordered)


def _running(df: DataFrame, value: str, order: tuple[str, str], size: int = 4096) -> DataFrame:
    """``df`` with ``~sum``: the sum of ``value`` up to each row by (group, number), in blocks so that no task sorts all rows."""
    group, number = order
    df = df.withColumn("~block", F.floor(F.col(number) / size))
    blocks = df.groupBy(group, "~block").agg(F.sum(value).alias("~part"))
    before = F.sum("~part").over(Window.orderBy(group, "~block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(group, "~block", F.coalesce(before, F.lit(0)).alias("~before"))
    within = F.sum(value).over(Window.partitionBy(group, "~block").orderBy(number))
    return df.join(blocks, [group, "~block"]).withColumn("~sum", F.col("~before") + within).drop("~block", "~before")


def _page_cuts(df: DataFrame, key: str | None, rules, seen: DataFrame | None) -> DataFrame:
    """Without the pages after a source's last. The counts are one row a page."""
    got = sink.judged(df, key, rules, None, ORDER)
    if key is not None and seen is not None:
        fresh = sink.unseen(df, key, seen).select(*ORDER, F.lit(True).alias("~new"))
        got = got.join(fresh, list(ORDER), "left").withColumn(KEPT, F.col(KEPT) & F.col("~new").isNotNull()).drop("~new")
    lost = ~F.col(FIRST) | ~F.col(KEPT) if seen is not None and key is not None else ~F.col(FIRST)
    per = got.groupBy(SOURCE, PAGE).agg(F.sum(F.col(KEPT).cast("int")).alias("kept"), F.count_if(lost).alias("copies"), F.max(TOTAL).alias("total"))
    per, _ = write_shared(per, "page-counts")
    per = _running(per, "kept", (SOURCE, PAGE))
    last = ((F.col("kept") == 0) & (F.col("copies") > 0)) | F.coalesce(F.col("~sum") >= F.col("total"), F.lit(False))
    ends = per.groupBy(SOURCE).agg(F.min(F.when(last, F.col(PAGE))).alias("~end"))
    return df.join(F.broadcast(ends), SOURCE).where(F.col("~end").isNull() | (F.col(PAGE) <= F.col("~end"))).drop("~end")


def run(spark: SparkSession, bp: Blueprint, source: DataFrame, **more) -> DataFrame:
    """Run a blueprint over its fetched source: ``pages(url, html)`` or ``responses(source_ord, page_ord, body)``."""
    return run_api(spark, bp, source, **more) if bp.mode == "api" else run_html(spark, bp, source, **more)


COUNTERS = (
    "pages_fetched", "pages_failed", "items_found", "items_scraped", "items_filtered", "items_deduped", "details_fetched", "details_failed",
    "images_saved", "images_failed", "cache_hits", "cache_misses",
)


def statistics(judged: DataFrame, elapsed_s: float | None = None, **known: int) -> DataFrame:
    """One row of run counters from rows with ``columns.FIRST`` and ``columns.KEPT`` (see ``sink.accept``'s ``observe``).

    ``known`` are counters that other tables hold (``pages_fetched``, ``details_failed``, ..), 0 where they aren't given.
    With ``elapsed_s`` the time in seconds and the items a second are there as well.
    """
    odd = set(known) - set(COUNTERS)
    if odd:
        raise ValueError(f"no such counters: {', '.join(sorted(odd))}")
    own = {
        "items_found": F.count(F.lit(1)), "items_deduped": F.count_if(~F.col(FIRST)), "items_filtered": F.count_if(F.col(FIRST) & ~F.col(KEPT)),
        "items_scraped": F.count_if(F.col(KEPT)),
    }
    out = judged.agg(*[(own[n] if n in own else F.lit(known.get(n, 0)).cast("bigint")).alias(n) for n in COUNTERS])
    if elapsed_s is None:
        return out
    took = F.lit(float(elapsed_s))
    rate = F.when(F.round(took, 2) > 0, F.round(F.col("items_scraped") / F.round(took, 2), 1)).otherwise(0.0)
    return out.select("*", F.round(took, 2).alias("elapsed_s"), rate.alias("items_per_s"))


def summary(counters: Mapping[str, float]) -> str:
    """The lines of a finished run's report; counters that are 0 have no line beyond the first two."""
    n = {**dict.fromkeys(COUNTERS, 0), **counters}
    took = int(n.get("elapsed_s", 0))
    time = f"{took // 60}m{took % 60}s" if took >= 60 else f"{took}s"
    lines = [f"items scraped: {n['items_scraped']} in {time} ({n.get('items_per_s', 0.0):.1f}/s)", f"pages: {n['pages_fetched']} fetched, {n['pages_failed']} failed"]
    for label, good, bad in (("details", "details_fetched", "details_failed"), ("images", "images_saved", "images_failed")):
        if n[good] or n[bad]:
            lines.append(f"{label}: {n[good]} {good.split('_')[1]}, {n[bad]} failed")
    lines += [f"{label}: {n[name]} items" for label, name in (("filtered out", "items_filtered"), ("repeated", "items_deduped")) if n[name]]
    if n["cache_hits"] or n["cache_misses"]:
        lines.append(f"cache: {n['cache_hits']} hits, {n['cache_misses']} misses")
    return "\n".join(lines)


def throttled(latencies: DataFrame, delay_ms: float, start_ms: float = 0.0, concurrency: float = 1.0, most_ms: float = 30000.0) -> DataFrame:
    """The delay after each response of ``latencies(host, at, latency_ms)``: the mean of the last delay and of the
    latency over the concurrency, held between ``delay_ms`` and ``most_ms``; folded in order for each host.

    Each step halves what came before, so the last 64 responses decide: what lies further back weighs less than
    2**-64 of the greatest delay, under what a double of the sum can hold.
    """
    goal = F.least(F.greatest(F.col("latency_ms").cast("double") / max(0.1, concurrency), F.lit(float(delay_ms))), F.lit(float(most_ms)))
    row = Window.partitionBy("host").orderBy("at")
    recent = F.collect_list(goal).over(row.rowsBetween(-63, 0))
    folded = F.aggregate("goals", F.when(F.size("goals") < 64, float(start_ms)).otherwise(0.0), lambda d, g: (d + g) / 2)
    return latencies.select("host", "at", recent.alias("goals")).select("host", "at", folded.alias("delay_ms"))


def combine(frames: list[DataFrame]) -> DataFrame:
    """Several results as one, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
