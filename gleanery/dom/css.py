"""CSS selectors over the tree: type, id, class, attribute, structural and ``:not :is :has :contains`` tests, and the four combinators."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from gleanery.dom.tree import Node

Test = Callable[[Node], bool]


class SelectorError(ValueError):
    """A selector that can't be read."""


_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_TOKEN = re.compile(
    rf"""\s*(?P<comb>[>+~,])\s* | (?P<space>\s+) | \#(?P<id>{_NAME}) | \.(?P<cls>{_NAME})
    | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<fold>[iIsS])?)?\s*\]
    | ::?(?P<pseudo>[\w-]+) | (?P<tag>\*|{_NAME})""",
    re.X,
)


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _attribute(m: re.Match) -> Test:
    name, op = m["attr"].lower(), m["op"]
    want = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
    fold = (m["fold"] or "").lower() == "i"
    want = want.lower() if fold else want

    def test(n: Node) -> bool:
        if name not in n.attrs:
            return False
        have = n.attrs[name].lower() if fold else n.attrs[name]
        if op is None:
            return True
        if op == "=":
            return have == want
        if op == "~=":
            return want in have.split()
        if op == "|=":
            return have == want or have.startswith(want + "-")
        if not want:
            return False
        return have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have

    return test


def _nth(text: str) -> Callable[[int], bool]:
    text = text.replace(" ", "").lower()
    if text in ("odd", "even"):
        text = {"odd": "2n+1", "even": "2n"}[text]
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not m:
        raise SelectorError(f"not a position: {text}")
    if m[3]:
        return lambda i, at=int(m[3]): i == at
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return lambda i: i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _place(n: Node, same_type: bool, last: bool) -> int:
    row = [x for x in n.siblings() if not same_type or x.tag == n.tag]
    at = next(i for i, x in enumerate(row) if x is n)
    return len(row) - at if last else at + 1


def _pseudo(name: str, arg: str | None) -> Test:
    if name in ("first-child", "last-child", "first-of-type", "last-of-type"):
        return lambda n: _place(n, name.endswith("type"), name.startswith("last")) == 1
    if name in ("only-child", "only-of-type"):
        return lambda n: _place(n, name.endswith("type"), False) == _place(n, name.endswith("type"), True) == 1
    if name == "empty":
        return lambda n: not n.elements and not n.content()
    if name == "root":
        return lambda n: n.parent is None
    if name == "checked":
        return lambda n: "checked" in n.attrs or "selected" in n.attrs
    if name in ("disabled", "enabled"):
        return lambda n: ("disabled" in n.attrs) == (name == "disabled")
    if arg is None:
        raise SelectorError(f"unknown test :{name}")
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        good = _nth(arg)
        return lambda n: good(_place(n, name.endswith("type"), "last" in name))
    if name == "contains":
        want = arg.strip().strip("\"'")
        return lambda n: want in n.content()
    if name == "not":
        parts = compile(arg)
        return lambda n: not any(p(n) for p in parts)
    if name in ("is", "where", "matches"):
        parts = compile(arg)
        return lambda n: any(p(n) for p in parts)
    if name == "has":
        parts = compile(arg)
        return lambda n: any(p(d) for d in n.walk() for p in parts)
    if name == "lang":
        return lambda n: n.get("lang").lower().split("-")[0] == arg.strip().lower()
    raise SelectorError(f"unknown test :{name}")


def _argument(css: str, at: int) -> tuple[str, int]:
    depth, i = 1, at
    while i < len(css) and depth:
        depth += {"(": 1, ")": -1}.get(css[i], 0)
        i += 1
    if depth:
        raise SelectorError(f"open bracket in {css!r}")
    return css[at : i - 1], i


def _related(left: Test, comb: str, right: Test) -> Test:
    def test(n: Node) -> bool:
        if not right(n):
            return False
        if comb == ">":
            return n.parent is not None and left(n.parent)
        if comb == " ":
            up = n.parent
            while up is not None:
                if left(up):
                    return True
                up = up.parent
            return False
        row = n.siblings()
        at = next(i for i, x in enumerate(row) if x is n)
        return at > 0 and left(row[at - 1]) if comb == "+" else any(left(x) for x in row[:at])

    return test


@lru_cache(maxsize=4096)
def compile(css: str) -> tuple[Test, ...]:
    """One test for each selector of a comma list."""
    found: list[Test] = []
    left: Test | None = None
    comb: str | None = None
    tests: list[Test] = []
    css = css.strip()
    if not css:
        raise SelectorError("empty selector")

    def step() -> None:
        nonlocal left, comb, tests
        if not tests:
            raise SelectorError(f"can't read {css!r}")
        mine = tuple(tests)
        one: Test = mine[0] if len(mine) == 1 else lambda n: all(t(n) for t in mine)
        left = one if left is None else _related(left, comb or " ", one)
        comb, tests = None, []

    at = 0
    while at < len(css):
        m = _TOKEN.match(css, at)
        if not m or m.end() == at:
            raise SelectorError(f"can't read {css!r} from {at}")
        at = m.end()
        if m["comb"] == ",":
            step()
            found.append(left)
            left = None
        elif m["comb"]:
            step()
            comb = m["comb"]
        elif m["space"]:
            if tests:
                step()
                comb = " "
        elif m["id"]:
            tests.append(lambda n, v=_plain(m["id"]): n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=_plain(m["cls"]): v in n.classes)
        elif m["attr"]:
            tests.append(_attribute(m))
        elif m["pseudo"]:
            arg = None
            if at < len(css) and css[at] == "(":
                arg, at = _argument(css, at + 1)
            tests.append(_pseudo(m["pseudo"].lower(), arg))
        else:
            if tests:
                raise SelectorError(f"can't read {css!r}")
            tests.append((lambda n: True) if m["tag"] == "*" else lambda n, v=_plain(m["tag"]).lower(): n.tag == v)
    step()
    return (*found, left)


def select(root: Node, css: str) -> list[Node]:
    """Matching elements below ``root`` in document order. Ancestors of ``root`` count for combinators."""
    tests = compile(css)
    return [n for n in root.walk() if any(t(n) for t in tests)]
