"""URLs: one normal form for each."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "yclid", "_ga"]
_ABSOLUTE = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_PORTS = {"http": 80, "https": 443, "ftp": 21}


def normalize(href: str | None, base: str | None) -> str | None:
    """href joined to base, without fragment and tracking parameters, host in lower case, parameters sorted by name; null where base or the result is no URL.

    Of parameters with equal names the last stays.
    """
    if href is None or base is None:
        return None
    try:
        b = urlsplit(base.strip())
        if not b.scheme or not b.netloc:
            return None
        u = urlsplit(urljoin(base.strip(), href.strip()))
        if not u.scheme or (u.scheme in _PORTS and not u.hostname):
            return None
        port = u.port
    except ValueError:
        return None
    scheme, host = u.scheme.lower(), (u.hostname or "").lower()
    try:
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    host = f"[{host}]" if ":" in host else host
    login = u.netloc.rpartition("@")[0]
    netloc = (f"{login}@" if login else "") + host + (f":{port}" if port and port != _PORTS.get(scheme) else "")
    kept = {k: v for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING}
    path = quote(u.path or "/", safe="/%:@!$&'()*+,;=~-._")
    return urlunsplit((scheme, netloc, path, urlencode(sorted(kept.items())), ""))


def _normalize(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normalize(h, b) for h, b in zip(href, base)], dtype=object)


#: Absolute URLs that the JVM's form covers: plain hosts and paths, parameters that need no coding.
_PLAIN = r"^https?://[a-z0-9][a-z0-9.-]*(?:/[A-Za-z0-9_~-][A-Za-z0-9_~.-]*)*/?(?:\?[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*(?:&[A-Za-z0-9_.~-]+=[A-Za-z0-9_.~-]*)*)?(?:#.*)?$"


def normalize_url(href: Column, base: Column) -> Column:
    """normalize() of links: plain absolute ones in the JVM, so that Python sees the others only."""
    plain = href.rlike(_PLAIN) & base.rlike(_PLAIN)
    other = F.when(~F.coalesce(plain, F.lit(False)), href)
    return F.when(plain, normalize_absolute(href)).otherwise(F.pandas_udf(_normalize, "string")(other, base))


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _ABSOLUTE, k)


def normalize_absolute(url: Column) -> Column:
    """The same for absolute URLs that need no percent coding, in the JVM; null for others."""
    pairs = F.transform(F.filter(F.split(part(url, 4), "&"), lambda p: p != ""), lambda p, i: F.struct(F.split(p, "=", 2)[0].alias("k"), i.alias("i"), F.regexp_replace(p, "^[^=]*=?", "").alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING))
    last = let(kept, lambda a: F.filter(a, lambda p: ~F.exists(a, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"]))))
    query = F.array_join(F.transform(F.array_sort(last), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    whole = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.rlike(_ABSOLUTE) & (part(url, 2) != ""), whole)


def domain(url: Column) -> Column:
    return F.lower(part(url, 2))


def domain_hash(d: Column) -> Column:
    return F.xxhash64(d)
