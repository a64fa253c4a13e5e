"""Canonical URLs.

Absolute http(s) URLs in ASCII without escapes, dot segments or user, the bulk of any table, are
rewritten by native expressions; ``canonical_url`` sends only the others through Arrow batches.
"""

from __future__ import annotations

import posixpath
import re
import unicodedata
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track.
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "gbraid", "wbraid", "dclid",
    "fbclid", "msclkid", "ttclid", "yclid", "igshid", "li_fat_id", "mc_cid", "mc_eid", "_ga", "_gl",
)
#: Characters that stand for themselves; an escape of one is needless.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
DEFAULT_PORTS = {"http": "80", "https": "443"}
#: The one spelling of every escape, by its digits in upper case.
_SPELLING = {f"%{byte:02X}": chr(byte) if chr(byte) in UNRESERVED else f"%{byte:02X}" for byte in range(256)}
_ESCAPE = re.compile("%[0-9A-Fa-f]{2}")
_NOWHERE = re.compile(r"\s*(?:#|$|(?:javascript|data):)", re.I)
_OPAQUE = re.compile(r"\s*(mailto|tel):", re.I)
_LOCATED = re.compile(
    r"(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*)://(?P<place>(?P<user>[^/?#]*@)?(?P<host>\[[^\]/?#]*\]|[^:/?#]*):?(?P<port>[^/?#]*))"
    r"(?P<path>/[^?#]*)?(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?",
    re.S,
)


def respell(text: str) -> str:
    """Escapes of unreserved characters decoded, all others in upper case."""
    return _ESCAPE.sub(lambda found: _SPELLING[found[0].upper()], text) if "%" in text else text


def _ascii_host(host: str) -> str | None:
    """A host as it is looked up; None where compatibility forms hide a separator."""
    host = host.lower().rstrip(".")
    if host.isascii():
        return host
    if set("/?#@:") & set(unicodedata.normalize("NFKC", host)):
        return None
    try:
        return host.encode("idna").decode("ascii")
    except UnicodeError:
        return host


def canonical(href: str | None, base: str | None = None) -> str | None:
    """One spelling of a reference, or None where it leads nowhere.

    None: null, empty, a bare fragment, ``javascript:``, ``data:``, or relative without a base.
    ``mailto:`` and ``tel:`` keep everything behind the scheme. Otherwise scheme and host are
    lower case, default ports go, dot segments and empty segments are resolved, escapes of
    unreserved characters are decoded and others upper case, tracking keys go and the rest of
    the query is sorted, trailing slashes go except for the root; the fragment stays.
    """
    if href is None or _NOWHERE.match(href):
        return None
    if opaque := _OPAQUE.match(href):
        return f"{opaque[1].lower()}:{href[opaque.end():].rstrip()}"
    # line breaks and tabs inside a reference count for nothing
    written = href.strip().translate({9: None, 10: None, 13: None})
    try:
        found = _LOCATED.fullmatch(urljoin(base, written) if base else written)
    except ValueError:
        return None
    if found is None or not found["place"] or ("[" in found["place"]) != ("]" in found["place"]):
        return None
    scheme, host, port = found["scheme"].lower(), _ascii_host(found["host"]), found["port"]
    if host is None:
        return None
    # the standard library's path rules are those of dot and empty segments
    path = "/" + posixpath.normpath("/" + respell(found["path"] or "")).lstrip("/")
    items = [item for item in map(respell, (found["query"] or "").split("&")) if item and item.partition("=")[0].lower() not in TRACKING_KEYS]
    items.sort(key=lambda item: item.partition("=")[::2])
    return "".join(
        [
            scheme, "://", found["user"] or "", host, f":{port}" if port and port != DEFAULT_PORTS.get(scheme) else "", path,
            "?" * bool(items), "&".join(items), "#" * bool(found["fragment"]), respell(found["fragment"] or ""),
        ]
    )


#: URLs that ``plain_http_url`` spells as ``canonical`` does.
_PLAIN_URL = r"^\s*(?i:https?)://(?!-)[A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?(?:/(?!\.{1,2}(?:[/?#\s]|$))[!$&-.0-;=@-Z_a-z~]*)*(?:\?[!$&-.0-;=@-Z_a-z~/?]*)?(?:#[!$&-.0-;=?@-Z_a-z~/]*)?\s*$"


def canonical_url(href: Column, base: str | None = None) -> Column:
    """``canonical`` over a column; Python sees only what is not plain."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical(t if isinstance(t, str) else None, base)).astype(object)

    plain = F.coalesce(href.rlike(_PLAIN_URL), F.lit(False))
    return F.when(plain, plain_http_url(href)).otherwise(convert(F.when(plain, F.lit(None)).otherwise(href)))


def query_without_tracking(query: Column) -> Column:
    """The query's items without tracking keys, sorted; native."""
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(*TRACKING_KEYS))
    pairs = F.array_sort(F.transform(kept, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), x.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), "&")


def plain_http_url(url: Column) -> Column:
    """``canonical`` for absolute http(s) URLs in ASCII without escapes, dot segments or userinfo; native."""
    text = F.trim(url)
    rest = F.substring_index(text, "#", 1)
    scheme = F.lower(F.regexp_extract(rest, r"^([A-Za-z]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[A-Za-z]+://([^/?]*)", 1)), r"\.(?=:|$)", "")
    host = F.when((scheme == "http"), F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[A-Za-z]+://[^/?]*([^?]*)", 1), "/+", "/"), "/$", "")
    query = query_without_tracking(F.regexp_extract(rest, r"\?(.*)$", 1))
    tail = F.regexp_extract(text, r"(#.*)$", 1)
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), F.when(tail == "#", "").otherwise(tail))


def citation(uri: Column, scope: Column, status: Column, parent: Column, image_scope: str = "image_descriptions") -> Column:
    """The public https link of a piece of evidence: its own, or an image's confirmed parent; else null."""
    own = F.when(uri.startswith("https://"), uri)
    through = F.when((status == "confirmed") & parent.startswith("https://"), parent)
    return F.when(scope == image_scope, through).otherwise(own)
