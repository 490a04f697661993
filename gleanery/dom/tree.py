"""A lenient HTML tree. It exists only while one page is read; it is never a column."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))
#: an opening tag closes these when they are open, up to the given container
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)


_NO_ATTRS: dict[str, str] = {}
#: sets of attributes that the elements of a page share, as items of a list do
_SHARED = 1000


class Node:
    """An element: ``children`` are elements and strings in order, a tuple once it is closed. Elements may share ``attrs``."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or _NO_ATTRS, parent
        self.children: list[Node | str] | tuple[Node | str, ...] = []

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below this one in document order."""
        stack = [c for c in reversed(self.children) if c.__class__ is Node]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack += [c for c in reversed(node.children) if c.__class__ is Node]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def content(self) -> str:
        """All text below, as it stands."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if item.__class__ is Node:
                stack += reversed(item.children)
            else:
                out.append(item)
        return "".join(out)

    def text(self) -> str:
        """All text below with whitespace squashed."""
        return " ".join(self.content().split())

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def siblings(self) -> list[Node]:
        return self.parent.elements if self.parent else [self]

    def after(self) -> Node | None:
        """The next sibling element."""
        row = self.siblings()
        at = next(i for i, n in enumerate(row) if n is self)
        return row[at + 1] if at + 1 < len(row) else None

    def html(self) -> str:
        from html import escape

        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        inner = "".join(c.html() if isinstance(c, Node) else c if self.tag in _RAW else escape(c, quote=False) for c in self.children)
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"


_NAMED = re.compile("&([A-Za-z][A-Za-z0-9]*;?)")


def _guarded(html: str) -> tuple[str, str]:
    """The text with a mark after the ``&`` of what is no named character reference, and that mark, '' for none.

    A name counts only with its semicolon: ``&amp`` and ``&copy=1`` stay as they are. The standard parser takes these
    for references; it reads none across the mark, which is a character that the text lacks.
    """
    if all(name[-1] == ";" and name in html5 for name in set(_NAMED.findall(html))):
        return html, ""
    mark = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in html)
    return _NAMED.sub(lambda m: m[0] if m[1][-1] == ";" and m[1] in html5 else f"&{mark}{m[1]}", html), mark


class _Builder(HTMLParser):
    def __init__(self, mark: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.mark = mark
        self.shared: dict[tuple, dict[str, str]] = {}
        self.root = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None
        self.open = [self.root]

    def _into_body(self) -> None:
        if self.body is None:
            self.body = Node("body", {}, self.root)
            self.root.children.append(self.body)
            self.open = [self.root, self.body]

    def _plain(self, text: str) -> str:
        return text.replace(self.mark, "") if self.mark else text

    def _attributes(self, attrs: tuple) -> dict[str, str]:
        given = self.shared.get(attrs)
        if given is None:
            given = {}
            for name, value in attrs:
                given.setdefault(sys.intern(self._plain(name)), self._plain(value or ""))
            if len(self.shared) < _SHARED:
                self.shared[attrs] = given
        return given

    def _close(self, at: int) -> None:
        """End the open elements from this place on."""
        for node in self.open[at:]:
            node.children = tuple(node.children)
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs) -> None:
        tag = sys.intern(self._plain(tag))
        given = self._attributes(tuple(attrs)) if attrs else _NO_ATTRS
        if tag in ("html", "head", "body"):
            if tag == "html":
                self.root.attrs = {**given, **self.root.attrs}
            elif tag == "head" and self.head is None and self.body is None:
                self.head = Node("head", given, self.root)
                self.root.children.append(self.head)
                self.open = [self.root, self.head]
            elif tag == "body":
                if self.body is None:
                    self._into_body()
                self.body.attrs = {**given, **self.body.attrs}
            return
        in_head = self.body is None and tag in ("title", "meta", "link", "base", "style", "script", "noscript", "template")
        if in_head and self.head is None:
            self.head = Node("head", {}, self.root)
            self.root.children.append(self.head)
            self.open = [self.root, self.head]
        elif not in_head:
            self._into_body()
        closes = _CLOSES.get(tag)
        if closes:
            self._close_through(*closes)
        elif tag in _BLOCKS and any(n.tag == "p" for n in self.open):
            self._close_through({"p"}, {"td", "th", "li", "button", "object"})
        parent = self.open[-1]
        node = Node(tag, given, parent)
        parent.children.append(node)
        if tag in VOID:
            node.children = ()
        else:
            self.open.append(node)

    def _close_through(self, tags: set[str], stop: set[str]) -> None:
        last = None
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in tags:
                last = i
            elif self.open[i].tag in stop:
                break
        if last is not None:
            self._close(last)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        tag = self._plain(tag)
        if tag not in VOID and len(self.open) > 2 and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        tag = self._plain(tag)
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head is not None and self.body is None:
                self.open = [self.root]
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag and self.open[i] is not self.body:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        if self.body is None and (self.open[-1] is self.root or self.open[-1] is self.head):
            if not data.strip():
                return
            self._into_body()
        self.open[-1].children.append(self._plain(data))


def parse(html: str | None) -> Node:
    """The ``html`` element of a document or fragment; text and elements outside the head lie in ``body``."""
    text, mark = _guarded(html or "")
    builder = _Builder(mark)
    builder.feed(text)
    builder.close()
    builder._into_body()
    return builder.root
