"""HTML as Markdown."""

from __future__ import annotations

import re

from gleanery.dom.tree import Node, parse
from gleanery.functions.urls import absolute_py

_DROPPED = frozenset(
    "audio button canvas embed form head iframe input label link map meta noscript object option script select style svg template textarea video".split()
)
_CHROME = frozenset(("aside", "footer", "header", "nav"))
_BLOCK = frozenset(
    "address article aside blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody tfoot thead tr ul".split()
)


class Markdown:
    """A renderer: ``chrome`` keeps navigation, headers, footers and asides; links are resolved against ``base``."""

    def __init__(self, base: str | None = None, chrome: bool = False):
        self.base, self.dropped = base, _DROPPED if chrome else _DROPPED | _CHROME

    def render(self, node: Node) -> str:
        return re.sub(r"\n{3,}", "\n\n", self._flow(node, "\n\n")).strip()

    def _flow(self, node: Node, between: str, item: bool = False) -> str:
        """Blocks among the children, with runs of inline content between them as blocks too."""
        blocks: list[str] = []
        run: list[str] = []

        def flush() -> None:
            text = "".join(run)
            run.clear()
            if text.strip():
                blocks.append(_tidy(text))

        for child in node.children:
            if isinstance(child, Node) and item and child.tag in ("ul", "ol"):
                flush()
                blocks.append(self._list(child))
            elif isinstance(child, Node) and child.tag in _BLOCK:
                flush()
                block = self._block(child)
                if block.strip():
                    blocks.append(block)
            else:
                run.append(self._inline(child))
        flush()
        return between.join(blocks)

    def _block(self, node: Node) -> str:
        tag = node.tag
        if tag in self.dropped:
            return ""
        if re.fullmatch("h[1-6]", tag):
            return "#" * int(tag[1]) + " " + _tidy(self._inline(node))
        if tag == "hr":
            return "---"
        if tag == "pre":
            return self._code(node)
        if tag == "blockquote":
            return "\n".join("> " + line if line else ">" for line in self._flow(node, "\n\n").split("\n"))
        if tag in ("ul", "ol"):
            return self._list(node)
        if tag == "table":
            return self._table(node)
        return self._flow(node, "\n\n")

    def _inline(self, node: Node | str) -> str:
        if isinstance(node, str):
            return re.sub(r"\s+", " ", node)
        tag = node.tag
        if tag in self.dropped:
            return ""
        if tag == "br":
            return "\n"
        if tag in ("b", "strong"):
            return self._mark(node, "**")
        if tag in ("em", "i"):
            return self._mark(node, "*")
        if tag == "code":
            return f"`{node.content().strip()}`"
        if tag == "a":
            text, href = self._inside(node).strip(), node.get("href").strip()
            return text if href in ("", "#") else f"[{text or href}]({self._url(href)})"
        if tag == "img":
            src = node.get("src").strip()
            return f"![{node.get('alt').strip()}]({self._url(src)})" if src else ""
        return self._inside(node)

    def _inside(self, node: Node) -> str:
        return "".join(self._inline(c) for c in node.children)

    def _mark(self, node: Node, mark: str) -> str:
        inner = self._inside(node)
        text = inner.strip()
        if not text:
            return " " if inner else ""
        return (" " if inner[0].isspace() else "") + mark + text + mark + (" " if inner[-1].isspace() else "")

    def _url(self, url: str) -> str:
        return url if self.base is None else absolute_py(self.base, url) or url

    @staticmethod
    def _code(node: Node) -> str:
        code = node.find("code")
        named = [c[9:] for c in code[0].get("class").split(" ") if c.startswith("language-")] if code else []
        text = node.content().rstrip("\n")
        return f"```{named[0] if named else ''}\n{text}\n```"

    def _list(self, node: Node) -> str:
        lines: list[str] = []
        for i, li in enumerate((c for c in node.elements if c.tag == "li"), 1):
            mark = f"{i}. " if node.tag == "ol" else "- "
            first, *others = self._flow(li, "\n", item=True).split("\n")
            lines.append(mark + first)
            lines += [" " * len(mark) + line if line else "" for line in others]
        return "\n".join(lines)

    def _table(self, node: Node) -> str:
        rows = [[_tidy(self._inside(c)).replace("|", "\\|") for c in tr.elements if c.tag in ("td", "th")] for tr in node.find("tr")]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        n = len(rows[0])
        rows = [rows[0], ["---"] * n, *((r + [""] * n)[:n] for r in rows[1:])]
        return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def _tidy(text: str) -> str:
    return re.sub(r" *\n *", "\n", re.sub("[ \t\xa0]+", " ", text)).strip()


def to_markdown(html: str | None, base: str | None = None, chrome: bool = False) -> str:
    """Markdown of a document or fragment; '' for null and blank input."""
    if not (html or "").strip():
        return ""
    body = next(n for n in parse(html).elements if n.tag == "body")
    return Markdown(base, chrome).render(body)
