"""Which addresses may be fetched: web schemes only and, if private hosts are blocked, hosts that lie on the public network."""

from __future__ import annotations

import ipaddress
import re
import socket
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def literal(host: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that a host is written as, None for a name: dotted, short (``127.1``), one number, octal or
    hexadecimal parts, IPv6 with or without brackets and zone; an IPv4 address inside an IPv6 one counts as itself."""
    name = unicodedata.normalize("NFKC", host).strip().rstrip(".")
    bare = name.strip("[]").partition("%")[0]
    if ":" in bare:
        try:
            ip = ipaddress.IPv6Address(bare)
        except ValueError:
            return None
        inner = ip.ipv4_mapped or ip.sixtofour or (ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF) if int(ip) >> 32 in (0, 0x64FF9B << 64) and int(ip) > 1 else None)
        return inner or ip
    if not re.fullmatch(r"(?:0[xX][0-9A-Fa-f]*|[0-9]+)(?:\.(?:0[xX][0-9A-Fa-f]*|[0-9]+)){0,3}", bare):
        return None
    try:
        return ipaddress.IPv4Address(socket.inet_aton(bare))
    except OSError:
        return None


def is_private(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    """Loopback, link-local, private, reserved, shared and multicast ranges."""
    return not ip.is_global or ip.is_multicast


@lru_cache(1 << 16)
def private_literal(host: str) -> str | None:
    """The private address that a host is, without asking anyone: a literal one, or the name of the machine itself."""
    name = host.lower().rstrip(".")
    if name == "localhost" or name.endswith(".localhost"):
        return "127.0.0.1"
    ip = literal(host)
    return str(ip) if ip is not None and is_private(ip) else None


@lru_cache(1 << 16)
def private_address(host: str) -> str | None:
    """``private_literal``, or the first private address that the name resolves to; a name that resolves to none passes.

    Asked once a host in each worker.
    """
    known = private_literal(host)
    if known or literal(host) is not None:
        return known
    try:
        found = [r[4][0] for r in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)]
    except (OSError, UnicodeError):
        return None
    return next((str(ip) for ip in map(literal, found) if ip is not None and is_private(ip)), None)


def reason(url: str | None, block_private: bool = False, allow: tuple[str, ...] = (), resolve: bool = True) -> str | None:
    """Why an address may not be fetched, None if it may."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url or "")
    scheme = m[1].lower() if m else ""
    if scheme not in ("http", "https"):
        return f"not a web address (scheme '{scheme}')"
    if not block_private:
        return None
    m = re.match(_HOST, url or "")
    host = m[1].lower() if m else ""
    if not host:
        return "no host"
    if host in {a.lower() for a in allow}:
        return None
    found = (private_address if resolve else private_literal)(host)
    return f"private address {found}" if found else None


def refused(url: Column, block_private: bool = False, allow: tuple[str, ...] = ()) -> Column:
    """``reason`` as a column, by what the address itself says; names are looked up only where they are fetched."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    web = F.coalesce(scheme.isin("http", "https"), F.lit(False))
    bad = F.when(~web, F.concat(F.lit("not a web address (scheme '"), F.coalesce(scheme, F.lit("")), F.lit("')")))
    if not block_private:
        return bad

    @pandas_udf("string")
    def private(host: pd.Series) -> pd.Series:
        return host.map({h: private_literal(h) for h in host.dropna().unique()})

    host = F.lower(F.regexp_extract(url, _HOST, 1))
    listed = host.isin(*[a.lower() for a in allow]) if allow else F.lit(False)
    ip = private(host)
    return bad.when(host == "", "no host").when(listed, F.lit(None).cast("string")).when(ip.isNotNull(), F.concat(F.lit("private address "), ip))
