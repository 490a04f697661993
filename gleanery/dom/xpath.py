"""The part of XPath 1.0 that scraping uses: the main axes, ``//``, name and node tests, predicates with positions,
comparisons, ``and``, ``or`` and the functions contains, starts-with, ends-with, normalize-space, text, not, last,
position, count, string-length, string, concat and translate."""

from __future__ import annotations

import re
from functools import lru_cache

from gleanery.dom.css import SelectorError
from gleanery.dom.tree import Node

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<op>//|\.\.|::|!=|<=|>=|[/.@()\[\],|=<>*+-])|(?P<name>[A-Za-z_][\w.-]*))""", re.X
)
_AXES = {
    "ancestor", "ancestor-or-self", "attribute", "child", "descendant", "descendant-or-self", "following", "following-sibling", "parent",
    "preceding", "preceding-sibling", "self",
}


class _Text(str):
    """A text node's string with its parent, so that ``text()/..`` works."""

    parent: Node | None = None


def _lex(path: str) -> list[tuple[str, str]]:
    out, at = [], 0
    path = path.strip()
    while at < len(path):
        m = _TOKEN.match(path, at)
        if not m or m.end() == at:
            raise SelectorError(f"can't read {path!r} from {at}")
        at = m.end()
        kind = m.lastgroup
        out.append(("str", m[kind]) if kind in ("dq", "sq") else (kind, m[kind]))
    return out


class _Parser:
    def __init__(self, tokens):
        self.t, self.i = tokens, 0

    def peek(self, k=0):
        return self.t[self.i + k] if self.i + k < len(self.t) else ("end", "")

    def take(self, value=None):
        tok = self.peek()
        if value is not None and tok[1] != value or tok[0] == "end":
            raise SelectorError(f"expected {value or 'more'}, found {tok[1]!r}")
        self.i += 1
        return tok

    def at(self, *values):
        return self.peek()[0] in ("op", "name") and self.peek()[1] in values

    def chain(self, part, *ops):
        left = part()
        while self.at(*ops) and self.peek()[0] != "str":
            left = ("bin", self.take()[1], left, part())
        return left

    def expr(self):
        return self.chain(self.conj, "or")

    def conj(self):
        return self.chain(self.equal, "and")

    def equal(self):
        return self.chain(self.order, "=", "!=")

    def order(self):
        return self.chain(self.add, "<", "<=", ">", ">=")

    def add(self):
        return self.chain(self.union, "+", "-")

    def union(self):
        return self.chain(self.primary, "|")

    def primary(self):
        kind, value = self.peek()
        if kind == "num":
            self.take()
            return ("num", float(value))
        if kind == "str":
            self.take()
            return ("str", value)
        if value == "-" and kind == "op":
            self.take()
            return ("bin", "-", ("num", 0.0), self.primary())
        if value == "(":
            self.take()
            inner = self.expr()
            self.take(")")
            return self.rest(self.predicates(inner))
        if kind == "name" and self.peek(1)[1] == "(" and value not in ("text", "node", "comment"):
            name = self.take()[1]
            self.take("(")
            args = []
            while not self.at(")"):
                args.append(self.expr())
                if self.at(","):
                    self.take()
            self.take(")")
            return ("call", name, args)
        return self.path()

    def predicates(self, inner):
        found = []
        while self.at("["):
            self.take()
            found.append(self.expr())
            self.take("]")
        return ("filter", inner, found) if found else inner

    def rest(self, start):
        steps = []
        while self.at("/", "//"):
            if self.take()[1] == "//":
                steps.append(("descendant-or-self", "node()", []))
            steps.append(self.step())
        return ("path", start, steps) if steps else start

    def path(self):
        steps, start = [], "here"
        if self.at("/", "//"):
            start = "root"
            if self.take()[1] == "//":
                steps.append(("descendant-or-self", "node()", []))
            elif self.peek()[0] == "end":
                return ("path", start, steps)
        steps.append(self.step())
        more = self.rest(None)
        return ("path", start, steps + (more[2] if more else []))

    def step(self):
        axis = "child"
        if self.at(".", ".."):
            return ("self" if self.take()[1] == "." else "parent", "node()", [])
        if self.at("@"):
            self.take()
            axis = "attribute"
        elif self.peek()[0] == "name" and self.peek(1)[1] == "::":
            axis = self.take()[1]
            if axis not in _AXES:
                raise SelectorError(f"unknown axis {axis}")
            self.take()
        kind, name = self.take()
        if kind not in ("name", "op") or kind == "op" and name != "*":
            raise SelectorError(f"can't read {name!r}")
        if self.at("(") and name in ("text", "node"):
            self.take()
            self.take(")")
            name += "()"
        inner = self.predicates(None)
        return (axis, name.lower() if axis != "attribute" else name.lower(), inner[2] if inner else [])


@lru_cache(maxsize=2048)
def compile(path: str):
    parser = _Parser(_lex(path))
    tree = parser.expr()
    if parser.i != len(parser.t):
        raise SelectorError(f"can't read the end of {path!r}")
    return tree


def _texts(n: Node) -> list[_Text]:
    out = []
    for c in n.children:
        if isinstance(c, str):
            t = _Text(c)
            t.parent = n
            out.append(t)
    return out


def _axis(n, axis: str, test: str) -> list:
    if not isinstance(n, Node):
        return [n] if axis == "self" and test == "node()" else [n.parent] if axis == "parent" and n.parent else []
    if axis == "attribute":
        names = n.attrs if test == "*" else [test] if test in n.attrs else []
        out = []
        for name in names:
            t = _Text(n.attrs[name])
            t.parent = n
            out.append(t)
        return out
    if test == "text()":
        if axis == "child":
            return _texts(n)
        inside = [n, *n.walk()] if axis.startswith("descendant") else []
        return [t for m in inside for t in _texts(m)]
    if axis == "child":
        found = n.elements
    elif axis == "descendant":
        found = list(n.walk())
    elif axis == "descendant-or-self":
        found = [n, *n.walk()]
    elif axis == "self":
        found = [n]
    elif axis == "parent":
        found = [n.parent] if n.parent else []
    elif axis.startswith("ancestor"):
        found, up = ([n] if axis.endswith("self") else []), n.parent
        while up is not None:
            found.append(up)
            up = up.parent
    else:
        row = n.siblings()
        at = next(i for i, x in enumerate(row) if x is n)
        found = row[at + 1 :] if axis.startswith("following") else row[:at][::-1]
        if axis in ("following", "preceding"):
            found = [y for x in found for y in (x, *x.walk())]
    return [m for m in found if test in ("*", "node()") or m.tag == test]


def _string(v) -> str:
    if isinstance(v, list):
        return _string(v[0]) if v else ""
    if isinstance(v, Node):
        return v.content()
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else str(v)
    return str(v)


def _number(v) -> float:
    if isinstance(v, (float, bool)):
        return float(v)
    try:
        return float(_string(v).strip())
    except ValueError:
        return float("nan")


def _truth(v) -> bool:
    return bool(v)


def _compare(op: str, a, b) -> bool:
    for x in a if isinstance(a, list) else [a]:
        for y in b if isinstance(b, list) else [b]:
            if op in ("=", "!="):
                number = isinstance(x, float) or isinstance(y, float)
                same = _number(x) == _number(y) if number else _truth(x) == _truth(y) if isinstance(x, bool) or isinstance(y, bool) else _string(x) == _string(y)
                if same == (op == "="):
                    return True
            else:
                p, q = _number(x), _number(y)
                if p < q if op == "<" else p <= q if op == "<=" else p > q if op == ">" else p >= q:
                    return True
    return False


def _call(name: str, args: list, here, pos: int, size: int):
    if name == "last":
        return float(size)
    if name == "position":
        return float(pos)
    if name == "not":
        return not _truth(args[0])
    if name in ("true", "false"):
        return name == "true"
    if name == "count":
        return float(len(args[0]))
    words = [_string(a) for a in args] or [_string(here)]
    if name == "contains":
        return words[1] in words[0]
    if name == "starts-with":
        return words[0].startswith(words[1])
    if name == "ends-with":
        return words[0].endswith(words[1])
    if name == "normalize-space":
        return " ".join(words[0].split())
    if name == "string-length":
        return float(len(words[0]))
    if name == "string":
        return words[0]
    if name == "concat":
        return "".join(words)
    if name == "translate":
        return words[0].translate({ord(c): (words[2][i] if i < len(words[2]) else None) for i, c in reversed(list(enumerate(words[1])))})
    if name in ("name", "local-name"):
        node = args[0][0] if args and args[0] else here
        return node.tag if isinstance(node, Node) else ""
    if name == "number":
        return _number(args[0] if args else here)
    raise SelectorError(f"unknown function {name}")


def _keep(nodes: list, predicates) -> list:
    for p in predicates:
        kept = []
        for i, n in enumerate(nodes):
            v = _eval(p, n, i + 1, len(nodes))
            if v == i + 1 if isinstance(v, float) else _truth(v):
                kept.append(n)
        nodes = kept
    return nodes


def _unique(nodes: list) -> list:
    seen: set[int] = set()
    out = []
    for n in nodes:
        if not isinstance(n, Node) or id(n) not in seen:
            seen.add(id(n))
            out.append(n)
    return out


def _eval(tree, here, pos: int = 1, size: int = 1):
    kind = tree[0]
    if kind in ("num", "str"):
        return tree[1]
    if kind == "call":
        return _call(tree[1], [_eval(a, here, pos, size) for a in tree[2]], here, pos, size)
    if kind == "filter":
        return _keep(_eval(tree[1], here, pos, size), tree[2])
    if kind == "bin":
        op, a, b = tree[1:]
        if op == "or":
            return _truth(_eval(a, here, pos, size)) or _truth(_eval(b, here, pos, size))
        if op == "and":
            return _truth(_eval(a, here, pos, size)) and _truth(_eval(b, here, pos, size))
        x, y = _eval(a, here, pos, size), _eval(b, here, pos, size)
        if op == "|":
            return _unique(x + y)
        if op in ("+", "-"):
            return _number(x) + _number(y) * (1 if op == "+" else -1)
        return _compare(op, x, y)
    start, steps = tree[1], tree[2]
    if start == "here":
        nodes = [here]
    elif start == "root":
        top = here
        while top.parent is not None:
            top = top.parent
        document = Node("#document")
        document.children = [top]
        nodes = [document]
    else:
        nodes = _eval(start, here, pos, size)
    for axis, test, predicates in steps:
        nodes = _unique([m for n in nodes for m in _keep(_axis(n, axis, test), predicates)])
    return [n for n in nodes if not isinstance(n, Node) or n.tag != "#document"]


def select(root: Node, path: str) -> list:
    """Elements, and strings for attributes and text. ``//`` searches below ``root`` only, as a scoped search does."""
    path = path.strip()
    if path.startswith("/"):
        path = "." + path if path.startswith("//") else path
    got = _eval(compile(path), root)
    if not isinstance(got, list):
        raise SelectorError(f"{path!r} selects no nodes")
    return got
