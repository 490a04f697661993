"""Names of the columns that the engine keeps beside an item's fields.

They begin with a mark that no field may begin with (``Blueprint.validate`` and the runs refuse it), so fields may
have any other name: ``total``, ``page_url``, ``item_ord``.
"""

from __future__ import annotations

MARK = "~"
SOURCE, PAGE, ITEM, PAGE_URL = "~source", "~page", "~item", "~page_url"
ORDER = (SOURCE, PAGE, ITEM)
FIRST, KEPT = "~first", "~kept"
TOTAL, DOC, LINK, FOUND, DETAIL, SEEN, HTML = "~total", "~doc", "~link", "~found", "~d", "~seen", "~html"
#: columns that aren't an item's
INNER = frozenset((*ORDER, PAGE_URL, FIRST, KEPT, TOTAL))


def refuse(names) -> None:
    """A ValueError if a field's name begins with the mark."""
    bad = sorted(n for n in names if n.startswith(MARK))
    if bad:
        raise ValueError(f"field names can't begin with {MARK!r}: {', '.join(bad)}")
