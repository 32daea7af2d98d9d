"""URL functions of the ingestion path: canonical form, relative links, post ids, public addresses."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the reader, host names of one site, sources whose items share a URL.
TRACKING = frozenset("fbclid gclid ref source utm_campaign utm_content utm_medium utm_source utm_term".split())
SAME_HOST = {"twitter.com": "x.com", "www.twitter.com": "x.com"}
SHARED_URL_SOURCES = ("gdelt",)

_POST = r"^https://x\.com/[A-Za-z0-9_]{1,15}/status/([0-9]{1,19})/?(?:\?[^\s#]*)?$"


def _tracks(pair: str) -> bool:
    return unquote_plus(pair.partition("=")[0]).lower() in TRACKING


def canonical(url: str | None) -> str | None:
    """Scheme and host in lower case, no user, fragment, tracking parameter or slash at the end of the path.

    An explicit port stays, parameters keep their encoding.  Null stays null; what is no URL stays as it is.
    """
    if url is None:
        return None
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url
    host = SAME_HOST.get(host, host)
    site = (f"[{host}]" if ":" in host else host) + (f":{port}" if port else "")
    kept = [p for p in u.query.split("&") if p and not _tracks(p)]
    head = f"{u.scheme}://{site}" if site else (f"{u.scheme}:" if u.scheme else "")
    return head + u.path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def url_canonical(url: Column) -> Column:
    """URL-F1 as a column."""
    return F.pandas_udf(lambda s: s.map(canonical, na_action="ignore"), "string")(url)


def joined(base: str | None, link: str | None) -> str | None:
    """Link seen from base; null when either is null or link is no URL."""
    try:
        return urljoin(base, link) if isinstance(base, str) and isinstance(link, str) else None
    except ValueError:
        return None


def url_join(base: Column, link: Column) -> Column:
    """URL-F2 as a column."""

    def run(b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([joined(*p) for p in zip(b, x, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(base, link)


def post_id(link: Column) -> Column:
    """FLT-11: the id in a link to a post, null for any other text."""
    return F.nullif(F.regexp_extract(F.trim(link), _POST, 1), F.lit(""))


def is_public(addresses: list[str]) -> bool:
    """URL-F3: there are addresses and all of them are global."""
    try:
        found = [ipaddress.ip_address(a) for a in addresses]
    except ValueError:
        return False
    return bool(found) and all(a.is_global for a in found)


def handle_key(handle: str) -> str:
    """A configured handle as it is compared: no leading @, no case."""
    return re.sub(r"^@+", "", handle.strip()).casefold()
