"""Label and value pairs of a page region."""

from __future__ import annotations

import re

from gleanery.dom.tree import Node

_SKIPPED = frozenset("head link meta noscript script style svg".split())
LABEL_MOST, VALUE_MOST = 40, 300
_COLON = re.compile(r"(?P<label>.{2,40}?):\s*(?P<value>\S.*)")


def normal(label: str) -> str:
    """A label as a key: squashed, without colons at its end, lower case."""
    return " ".join(label.split()).rstrip(":").strip().lower()


def _labelled(n: Node) -> bool:
    return any(c == "header" or "label" in c for c in n.classes)


def _beside(n: Node) -> str | None:
    """The value of an element whose class says label: a sibling whose class says value, else the next element."""
    for other in n.siblings() if n.parent else []:
        if other is not n and any("value" in c for c in other.classes) and other.text():
            return other.text()
    after = n.after() if n.parent else None
    return after.text() or None if after is not None and not _labelled(after) else None


def pairs(root: Node) -> list[tuple[str, str]]:
    """(label, value) in document order, the first value of each label.

    Taken from ``dt``/``dd``, ``th``/``td``, elements of label classes, bold text that ends in a colon, and
    innermost elements that read ``Label: value``.
    """
    found: dict[str, tuple[str, str]] = {}

    def put(label: str, value: str | None) -> None:
        label = " ".join(label.split()).rstrip(":").strip()
        value = " ".join((value or "").split())
        if 0 < len(label) <= LABEL_MOST and 0 < len(value) <= VALUE_MOST and normal(label):
            found.setdefault(normal(label), (label, value))

    for n in root.walk():
        if n.tag in _SKIPPED:
            continue
        if n.tag in ("dt", "th"):
            after = n.after()
            put(n.text(), after.text() if after is not None and after.tag == {"dt": "dd", "th": "td"}[n.tag] else None)
        elif _labelled(n):
            put(n.text(), _beside(n))
        elif n.tag in ("b", "label", "strong"):
            label = n.text()
            whole = n.parent.text() if n.parent else ""
            if label.endswith(":") and whole.lower().startswith(label.lower()):
                put(label, whole[len(label) :].lstrip(": \t"))
        elif not n.elements:
            m = _COLON.fullmatch(n.text())
            if m:
                put(m[1], m[2])
    return list(found.values())


def label_map(root: Node) -> dict[str, str]:
    return {normal(label): value for label, value in pairs(root)}
