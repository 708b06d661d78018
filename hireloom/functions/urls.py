"""URL functions as column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Endings of paths that never hold a posting.
BINARY_SUFFIXES = (
    "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "tiff", "css", "js", "woff", "woff2", "ttf", "zip", "exe", "dmg", "pdf", "mp3", "mp4", "wav", "avi", "flv", "pptx", "xlsx", "docx",
)
# Query parameters that only track, and hosts of applicant-tracking APIs.
TRACKING_PREFIXES = ("utm_", "gh_")
API_HOSTS = ("boards-api.greenhouse.io", "api.lever.co", "api.ashbyhq.com")
API_SUFFIX = ".myworkdayjobs.com"

#: scheme, authority, path, query, fragment (RFC 3986, appendix B); works for URLs that a strict parser refuses.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def part(url: Column, name: str) -> Column:
    return F.regexp_extract(url, PARTS, {"scheme": 1, "authority": 3, "path": 4, "query": 6, "fragment": 8}[name])


def canonical_url(url: Column, keep_params: tuple[str, ...] = ()) -> Column:
    """Scheme and authority in lower case, tracking parameters and empty ones left out in place, no fragment; null stays null.

    ``keep_params`` names parameters that are kept although they look like tracking.
    """
    scheme, authority, query = F.lower(part(url, "scheme")), F.lower(part(url, "authority")), part(url, "query")
    tracks = lambda p: (p.startswith(TRACKING_PREFIXES[0]) | p.startswith(TRACKING_PREFIXES[1])) & ~F.split(p, "=")[0].isin(list(keep_params) or ["\x00"])
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~tracks(p)), "&")
    path = part(url, "path")
    path = F.when((authority != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def host(url: Column) -> Column:
    """Host in lower case without user, port and brackets; empty where there is none."""
    bare = F.regexp_replace(part(url, "authority"), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r":\d*$", ""), r"^\[|\]$", ""))


def normalize_host(url: Column) -> Column:
    """Host without one leading "www."."""
    return F.regexp_replace(host(url), r"^www\.", "")


def is_binary_url(url: Column) -> Column:
    return F.lower(part(url, "path")).rlike(r"\.(?:" + "|".join(BINARY_SUFFIXES) + r")\z")


def is_ats_api(url: Column) -> Column:
    return host(url).isin(*API_HOSTS) | host(url).endswith(API_SUFFIX)


def url_path(url: Column) -> Column:
    """Percent-decoded path with its query, "/" if empty: what crawl rules are written against. A plus sign stays one."""
    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    path, query = part(decoded, "path"), part(decoded, "query")
    whole = F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(whole == "", "/").otherwise(whole)


@F.pandas_udf(T.BooleanType())
def is_private_literal(hosts: pd.Series) -> pd.Series:
    """Whether a host is an IP literal outside the public internet; names are never resolved."""

    def private(h: str | None) -> bool:
        try:
            return h is not None and not ipaddress.ip_address(h).is_global
        except ValueError:
            return False

    return hosts.map(private)


def blocked_reason(url: Column) -> Column:
    """Why a URL may not be fetched: 'scheme', 'credentials', 'host' or 'private'; null where it may."""
    return (
        F.when(~F.lower(part(url, "scheme")).isin("http", "https"), "scheme")
        .when(part(url, "authority").contains("@"), "credentials")
        .when(host(url) == "", "host")
        .when(is_private_literal(host(url)), "private")
    )
