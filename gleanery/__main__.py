"""Commands: run, validate, generate, shell and robot."""

from __future__ import annotations

import argparse
import os
import sys

ROBOT = '''"""Runs one blueprint: python {name}.py --pages FOLDER [--output FILE] [--limit N] [--state FOLDER]"""

from gleanery.__main__ import main

BLUEPRINT = r"""{blueprint}"""

if __name__ == "__main__":
    main(["run", "-"], BLUEPRINT)
'''


def find(name: str) -> str:
    """Text of a blueprint file, also looked for in ``blueprints`` and with ``.json``."""
    for path in (name, os.path.join("blueprints", name), os.path.join("blueprints", f"{name}.json")):
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return f.read()
    raise SystemExit(f"no blueprint {name}")


def robot(name: str, blueprint: str) -> str:
    """A job file with the blueprint inside."""
    return ROBOT.format(name=name, blueprint=blueprint.replace('"""', '\\"\\"\\"'))


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gleanery").getOrCreate()


def _table(spark, path: str):
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _generate_options(p: argparse.ArgumentParser) -> None:
    flag = {"action": "store_true"}
    p.add_argument("page", help="the fetched listing page (HTML) or response (JSON)")
    p.add_argument("--url", required=True)
    p.add_argument("--rendered", help="the page as a browser made it")
    p.add_argument("--captured", help="responses that the browser saw: a JSON list of {url, method, body}")
    p.add_argument("--get-detail", metavar="PAGE", help="a fetched detail page, for fields that items lack")
    p.add_argument("--preset", default="generic")
    p.add_argument("--single-page", **flag)
    p.add_argument("--main-content", **flag, help="with --single-page: its main region only")
    p.add_argument("--no-labeled-fields", **flag)
    p.add_argument("--fields", default="", help="names of fields to keep, with commas")
    p.add_argument("--api-endpoint", help="the page is this endpoint's response")
    p.add_argument("--api-method", default="GET")
    p.add_argument("--api-items-path")
    p.add_argument("--search-filters", help="sources: a JSON list of suffixes or {url, limit, tags}")
    for name in ("max-pages", "max-items", "http-delay", "page-delay", "item-delay"):
        p.add_argument(f"--{name}", type=int, default=0)
    p.add_argument("--http-timeout", type=int, default=60)
    p.add_argument("--http-retries", type=int, default=3)
    p.add_argument("--header", action="append", default=[], help="'Key: value', repeatable")
    p.add_argument("--cookie", default="", help="'a=1; b=2'")
    p.add_argument("--user-agent")
    p.add_argument("--transport", choices=("auto", "http", "browser", "challenge_solver", "scraping_api"))
    p.add_argument("--render-js", **flag)
    p.add_argument("--browser-wait-for", help="what a browser waits for; implies --render-js")
    p.add_argument("--output-format", choices=("json", "jsonl", "csv", "markdown"), default="json")
    p.add_argument("--stream", **flag)
    p.add_argument("--dedup", **flag)
    p.add_argument("--no-dedup", **flag)
    p.add_argument("--dedup-key")
    for name in ("primary-image", "gallery-images", "all-images"):
        p.add_argument(f"--get-{name}", **flag)
    p.add_argument("--resumable", **flag)
    p.add_argument("--blueprint", metavar="FILE", help="write the blueprint there instead of printing it")
    p.add_argument("--robot-name", help="print a job file of that name instead")
    p.add_argument("--force", **flag, help="overwrite FILE")


def _read(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def _generate(args: argparse.Namespace, text: str) -> int:
    """The blueprint that the page, what was captured of it, and the options make."""
    import json
    from dataclasses import replace

    from gleanery.plans import infer
    from gleanery.plans.blueprint import Source
    from gleanery.plans.presets import preset
    from gleanery.sources.fetch import BotBlocked

    using, labels = preset(args.preset), not args.no_labeled_fields
    try:
        if args.api_endpoint or text.lstrip()[:1] in ("[", "{"):
            bp = infer.from_response(args.api_endpoint or args.url, text, args.api_items_path, args.api_method.upper(), using)
            bp = bp.but(url=args.url) if bp else None
        elif args.single_page:
            bp = infer.from_page(args.url, text, True, using, labels, args.main_content)
        else:
            captured = json.loads(_read(args.captured)) if args.captured else None
            bp = infer.propose(args.url, text, captured, _read(args.rendered) if args.rendered else None, False, using, labels)
    except (BotBlocked, infer.ScriptRendered) as e:
        print(e, file=sys.stderr)
        return 1
    if bp is None:
        print("no list of records found", file=sys.stderr)
        return 1
    if args.get_detail and bp.mode == "html":
        bp = infer.with_details(bp, _read(args.get_detail), using, labels)
    keep = {n.strip() for n in args.fields.split(",") if n.strip()}
    if keep:
        bp = bp.but(fields=tuple(f for f in bp.fields if f.name in keep), detail_fields=tuple(f for f in bp.detail_fields if f.name in keep))
    if args.search_filters:
        bp = bp.but(sources=tuple(map(Source.of, json.loads(args.search_filters))))
    headers = {k.strip(): v.strip() for k, _, v in (h.partition(":") for h in args.header)}
    if args.user_agent:
        headers["User-Agent"] = args.user_agent
    if args.browser_wait_for:
        headers["X-Wait-For"] = args.browser_wait_for
    cookies = {k.strip(): v.strip() for k, _, v in (c.partition("=") for c in args.cookie.split(";")) if k.strip()}
    browser = args.render_js or bool(args.browser_wait_for)
    http = replace(
        bp.http, timeout=args.http_timeout, retry_count=args.http_retries, delay_ms=args.http_delay, headers={**bp.http.headers, **headers}, cookies=cookies,
        render_js=bp.http.render_js or browser, transport=args.transport or ("browser" if browser else bp.http.transport),
    )
    bp = bp.but(
        http=http, max_pages=args.max_pages, max_items=args.max_items or infer.safety_cap(bp), delay_between_pages_ms=args.page_delay, delay_between_items_ms=args.item_delay,
        output=replace(bp.output, format=args.output_format, stream=args.stream), primary_image=args.get_primary_image, gallery_images=args.get_gallery_images,
        all_images=args.get_all_images, resumable=args.resumable, dedup=(bp.dedup or args.dedup or bool(args.dedup_key)) and not args.no_dedup, dedup_key=args.dedup_key or bp.dedup_key,
    )
    made = robot(args.robot_name, bp.dump()) if args.robot_name else bp.dump()
    if not args.blueprint:
        print(made)
        return 0
    if os.path.exists(args.blueprint) and not args.force:
        print(f"{args.blueprint} is there already; --force writes over it", file=sys.stderr)
        return 1
    with open(args.blueprint, "w", encoding="utf-8") as f:
        f.write(made)
    return 0


def main(argv: list[str] | None = None, blueprint: str | None = None) -> int:
    from gleanery.plans.blueprint import Blueprint

    parser = argparse.ArgumentParser(prog="gleanery", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("run")
    p.add_argument("blueprint")
    p.add_argument("--pages", required=True, help="fetched pages or responses: Parquet or JSON")
    p.add_argument("--details", help="fetched detail responses of an API blueprint")
    p.add_argument("--output", default="-")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--state", help="folder of the keys of earlier runs: resume")
    p = commands.add_parser("validate")
    p.add_argument("blueprint")
    p.add_argument("--strict", action="store_true")
    _generate_options(commands.add_parser("generate", help="propose a blueprint from fetched files"))
    p = commands.add_parser("shell")
    p.add_argument("page")
    p.add_argument("selector")
    p.add_argument("--attribute")
    p = commands.add_parser("robot")
    p.add_argument("name")
    p.add_argument("blueprint")
    args = parser.parse_args((argv or []) + sys.argv[1:] if blueprint else argv)

    if args.command == "validate":
        bad, odd = Blueprint.load(find(args.blueprint)).validate()
        for kind, lines in (("error", bad), ("warning", odd)):
            for line in lines:
                print(f"{kind}: {line}")
        return int(bool(bad) or bool(args.strict and odd))
    if args.command == "robot":
        print(robot(args.name, find(args.blueprint)))
        return 0
    if args.command in ("generate", "shell"):
        with open(args.page, encoding="utf-8", errors="replace") as f:
            text = f.read()
        if args.command == "shell":
            from gleanery.dom.extract import items
            from gleanery.dom.tree import parse

            for n in items(parse(text), args.selector)[:20]:
                print(n.get(args.attribute) if args.attribute else n.text())
            return 0
        return _generate(args, text)

    from gleanery.plans.run import run
    from gleanery.sinks.export import FileStream
    from gleanery.sinks.export import text as as_text
    from gleanery.sinks.export import write
    from gleanery.streaming.incremental import resume

    spark = _spark()
    bp = Blueprint.load(blueprint if blueprint else find(args.blueprint))
    more = {"limit": args.limit, "ordered": True, **({"details": _table(spark, args.details)} if args.details and bp.mode == "api" else {})}
    pages = _table(spark, args.pages)
    got = resume(spark, bp, pages, args.state, **more) if args.state else run(spark, bp, pages, **more)
    if bp.output.stream and (args.output == "-" or not os.path.isdir(args.output)):
        out = FileStream(args.output, bp.output.format)
        out.write(got)
        out.close()
    elif args.output == "-":
        print(as_text(got, bp.output.format))
    else:
        write(got, bp.output.format, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
