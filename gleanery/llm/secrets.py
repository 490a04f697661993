"""Secret scan by structural confirmation: a candidate is reported only if what it decodes to is built like a key.

Candidates are runs of at least 16 characters of base64, base64url or hexadecimal. They are decoded, and
one of these structures must be there to the last byte:

``jwt``                 three base64url parts, the first a JSON object with ``alg``, the second a JSON object
``pkcs8_key``           DER: SEQUENCE { INTEGER 0 or 1, SEQUENCE { OID .. }, OCTET STRING .. }
``rsa_key``             DER: SEQUENCE of INTEGER 0 or 1 and at least eight INTEGERs
``ec_key``              DER: SEQUENCE { INTEGER 1, OCTET STRING of 16 to 80 bytes .. }
``dsa_key``             DER: SEQUENCE of INTEGER 0 and the five INTEGERs p, q, g, y, x, p of 64 bytes and q of 20 or more
``encrypted_key``       DER: SEQUENCE { SEQUENCE { OID of a password-based scheme .. }, OCTET STRING }
``openssh_key``         ``openssh-key-v1``, then strings whose lengths fill the key
``checked_token``       ``ghp_`` and the like: 30 characters and the base62 CRC-32 of them
``access_key_id``       AKIA / ASIA and 16 characters of base32, six different ones at least
``assigned_key``        hexadecimal or base64 of key length and high diversity, assigned to a name such as
                        token, secret, password or api_key

DER and OpenSSH keys may be wrapped over lines, line ends being real or written as ``\\n``, and lines may be quoted
(``>``, ``#``, ``//``, ``*``, ``|``). Public keys, hashes and other encodings that aren't assigned to such a name are left alone.

Two kinds have no inner structure to parse: what an ``access_key_id`` decodes to is any 10 bytes, so its prefix and its
alphabet are all that can be checked, and an ``assigned_key`` is raw bytes, so the name in the 48 bytes before it decides
once it decodes.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_schema, flat, slices, tidied

LEAST = 16
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-=."]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True

_PART = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
_JWT = re.compile(rb"(?<![A-Za-z0-9_.-])(e[A-Za-z0-9_-]{9,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_CHECKED = re.compile(rb"(?<![A-Za-z0-9])gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_ACCESS = re.compile(rb"(?<![A-Za-z0-9])A[KS]IA([A-Z2-7]{16})(?![A-Za-z0-9])")
_NAMED = re.compile(
    rb"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|auth|credentials?|bearer)"
    rb"[\"']?\s{0,3}(?:[:=]|=>|:=)\s{0,3}[\"']?$"
)
_BREAK = rb"(?:\r?\n|(?:\\r)?\\n)[ \t]*(?:(?:[>#*|]+|//)[ \t]*)?"
_BREAKS = re.compile(_BREAK)
_WRAP = re.compile(rb"(?:" + _BREAK + rb"[A-Za-z0-9+/=]+)+")
#: OIDs of password-based encryption: PKCS #5 and PKCS #12
_SEALED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_HEX = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _b64(text: bytes) -> bytes | None:
    """Strict base64 of either alphabet, padding optional."""
    body = text.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER value at ``at``, which must end by ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All values that fill [at, end) exactly."""
    found = []
    while at < end:
        one = _der(data, at, end)
        if one is None:
            return None
        found.append(one)
        at = one[2]
    return found


def der_key(data: bytes) -> str | None:
    """The kind of private key that ``data`` is, all nested lengths agreeing."""
    outer = _der(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return None
    parts = _children(data, outer[1], outer[2])
    if not parts or len(parts) < 2:
        return None
    if [p[0] for p in parts] == [0x30, 0x04]:
        inner = _children(data, parts[0][1], parts[0][2])
        sealed = inner and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(_SEALED)
        return "encrypted_key" if sealed and parts[1][2] - parts[1][1] >= 16 else None
    if parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return None
    version = data[parts[0][1]]
    tags = [p[0] for p in parts]
    if len(parts) >= 9 and set(tags[:9]) == {0x02} and version in (0, 1):
        return "rsa_key"
    if tags == [0x02] * 6 and version == 0 and parts[1][2] - parts[1][1] >= 64 and parts[2][2] - parts[2][1] >= 20:
        return "dsa_key"
    if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and version in (0, 1):
        inner = _children(data, parts[1][1], parts[1][2])
        return "pkcs8_key" if inner and inner[0][0] == 0x06 else None
    if tags[1] == 0x04 and version == 1 and 16 <= parts[1][2] - parts[1][1] <= 80 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec_key"
    return None


def openssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key: magic, three strings, a key count, that many public keys and the private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string(at: int) -> int:
        if at + 4 > len(data):
            return -1
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else -1

    for _ in range(3):
        at = string(at)
        if at < 0:
            return False
    if at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return False
    for _ in range(keys + 1):
        at = string(at)
        if at < 0:
            return False
    return at == len(data)


def _object(part: bytes) -> dict | None:
    data = _b64(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _base62(n: int) -> bytes:
    out = b""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r : r + 1] + out
    return out.rjust(6, b"0")


def _raw_key(value: bytes) -> bool:
    """Whether an assigned value is a key: hexadecimal of 8 bytes or more, or base64 of 16 or more, not of few symbols."""
    if _HEX.match(value):
        data = bytes.fromhex(value.decode()) if len(value) % 2 == 0 else b""
        return len(data) >= 8 and len(set(value)) >= 6 and any(c < 58 for c in value) and any(c > 58 for c in value)
    data = _b64(value)
    mixed = sum(any(c in s for c in value) for s in (range(48, 58), range(65, 91), range(97, 123)))
    return data is not None and len(data) >= 16 and mixed == 3 and len(set(data)) >= 0.6 * min(len(data), 64)


def confirm(data: bytes, start: int, end: int, low: int, high: int) -> list[tuple[int, int, str]]:
    """Secrets in the run ``data[start:end]`` of a text that is ``data[low:high]``, as (start, end, kind)."""
    found = []
    run = data[start:end]

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in found)

    for m in _JWT.finditer(run):
        head = _object(m[1])
        if head is not None and isinstance(head.get("alg"), str) and _object(m[2]) is not None:
            found.append((start + m.start(), start + m.end(), "jwt"))
    for m in _CHECKED.finditer(run):
        if _base62(binascii.crc32(m[1])) == m[2]:
            found.append((start + m.start(), start + m.end(), "checked_token"))
    for m in _ACCESS.finditer(run):
        if len(set(m[1])) >= 6:
            found.append((start + m.start(), start + m.end(), "access_key_id"))
    for m in _PART.finditer(run):
        a, b, value = start + m.start(), start + m.end(), m[0]
        if a > low and data[a - 1 : a] == b"\\" and value[:1] in (b"n", b"r", b"t"):
            # the letter belongs to an escape before the value
            a, value = a + 1, value[1:]
        if not free(a, b):
            continue
        kind = None
        if value[:1] == b"M" or value.startswith(b"b3Bl"):
            # the rest of a key that is wrapped over lines
            wrapped = _WRAP.match(data, b, high) if b == end else None
            for stop in ([wrapped.end()] if wrapped else []) + [b]:
                raw = _b64(_BREAKS.sub(b"", data[a:stop]))
                kind = raw and (der_key(raw) or ("openssh_key" if openssh_key(raw) else None))
                if kind:
                    b = stop
                    break
        if not kind and _HEX.match(value) and len(value) % 2 == 0 and value[:2] == b"30":
            kind = der_key(bytes.fromhex(value.decode()))
        if not kind and _NAMED.search(data[max(low, a - 48) : a]) and _raw_key(value):
            kind = "assigned_key"
        if kind:
            found.append((a, b, kind))
    return sorted(found)


def _within(hit: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each run are hits."""
    at = np.flatnonzero(hit)
    return np.searchsorted(at, ends) - np.searchsorted(at, begins)


def scan(col: pa.Array) -> list[tuple[int, int, int, str]]:
    """(text, start byte, end byte, kind) of every secret of a string array, in order."""
    found = []
    for first, count in slices(col):
        data, offsets = flat(col.slice(first, count))
        n = len(data)
        if n < LEAST:
            continue
        inside = _TOKEN[data]
        begins = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
        # a run doesn't reach from one text into the next: those that do are cut
        cuts = offsets[1:-1]
        owner = np.searchsorted(offsets, begins, "right") - 1
        last = np.searchsorted(offsets, ends, "left") - 1
        if (owner != last).any():
            cut = np.unique(cuts[(cuts > 0) & (cuts < n)])
            cut = cut[inside[cut] & inside[cut - 1]]
            begins, ends = np.sort(np.append(begins, cut)), np.sort(np.append(ends, cut))
        long = ends - begins >= LEAST
        begins, ends = begins[long], ends[long]
        digits, upper, lower = (_within(t[data], begins, ends) for t in (_DIGIT, _UPPER, _LOWER))
        likely = (digits > 0) | ((upper > 1) & (lower > 0)) | (upper >= 20)
        begins, ends = begins[likely], ends[likely]
        if not len(begins):
            continue
        raw = data.tobytes()
        owner = np.searchsorted(offsets, begins, "right") - 1
        done = 0
        for a, b, doc in zip(begins.tolist(), ends.tolist(), owner.tolist()):
            if a < done:
                continue
            low, high = int(offsets[doc]), int(offsets[doc + 1])
            for x, y, kind in confirm(raw, a, b, low, high):
                found.append((first + doc, x - low, y - low, kind))
                done = y
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, start, end, kind)`` of every secret, in characters of the text, ``end`` exclusive.

    Null and empty texts have none. Repeated rows are each reported, null ids as null. Texts are read
    whole whatever their length. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    schema, out = arrow_schema(f"doc_id {docs.schema[id_col].dataType.simpleString()}, start bigint, end bigint, kind string")

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            hits = scan(col)
            if not hits:
                continue
            at = pa.array([h[0] for h in hits])
            spans, last, chars = [], -1, None
            for i, a, b, _ in hits:
                if i != last:
                    raw, last = np.frombuffer(col[i].as_buffer(), np.uint8), i
                    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                spans.append((int(chars[a]), int(chars[b])))
            cols = [batch.column(0).take(at), pa.array([s[0] for s in spans]), pa.array([s[1] for s in spans]), pa.array([h[3] for h in hits])]
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(tidied(run), schema)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``; all rows and columns stay, in their order and types.

    ``n_chars``, if there is such a column, is the new length of texts that were changed. Null and empty texts
    stay as they are, repeated rows are each redacted, texts are read whole whatever their length. Columns of any
    other name pass through; an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    at = docs.columns.index(text)
    count = docs.columns.index(n_chars) if n_chars in docs.columns else None
    out = to_arrow_schema(docs.schema)

    def run(batches):
        for batch in batches:
            cols = list(batch.columns)
            by: dict[int, list] = {}
            for i, a, b, kind in scan(cols[at]):
                by.setdefault(i, []).append((a, b, kind))
            if by:
                rows = np.array(sorted(by))
                new = []
                for i in rows.tolist():
                    raw, parts, last = cols[at][i].as_py().encode(), [], 0
                    for a, b, kind in by[i]:
                        parts += [raw[last:a], f"[{kind}]".encode()]
                        last = b
                    new.append(b"".join([*parts, raw[last:]]).decode())
                mask = np.zeros(batch.num_rows, bool)
                mask[rows] = True
                where = pa.array(mask)
                cols[at] = pc.replace_with_mask(cols[at], where, pa.array(new, cols[at].type))
                if count is not None:
                    cols[count] = pc.replace_with_mask(cols[count], where, pa.array([len(x) for x in new]).cast(cols[count].type))
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return docs.mapInArrow(tidied(run), docs.schema)
