"""URL functions as Column expressions (a splitter that never fails), and a resolver for relative references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

SPLIT = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
# Parameters that do not change what a URL names, and those that make it untidy.
TRACKING = r"(?i)^(utm_|gclid($|=)|fbclid($|=)|mc_|_ga($|=)|ref($|=)|source($|=)|yclid($|=)|msclkid($|=))"
UNTIDY = r"(?i)[?&](utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid|sid)="
# Files that are no pages.
NON_PAGE = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|pdf|zip|gz|mp4|webm|css|js|json|xml|txt)$"
INFRA = r"(?i)^/cdn-cgi/"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, SPLIT, group)


def scheme(url: Column) -> Column:
    return part(url, 1)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    p = part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    return F.regexp_replace(part(url, 4), r"^\?", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def canonical_identity(url: Column) -> Column:
    """Without fragment, tracking parameters and one final slash."""
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    p = path(url)
    short = F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)
    return F.when(scheme(url) == "", url).otherwise(F.concat(origin(url), short, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def is_content_path(p: Column) -> Column:
    return ~p.rlike(INFRA) & ~p.rlike(NON_PAGE)


def depth(p: Column) -> Column:
    return F.size(F.filter(F.split(p, "/"), lambda x: x != ""))


def url_issues(url: Column) -> Column:
    p = path(url)
    found = F.array(
        F.when(F.length(url) > 115, "too long"), F.when(p.rlike("[A-Z]"), "uppercase"), F.when(F.contains(p, F.lit("_")), "underscore"), F.when(depth(p) > 4, "too deep"), F.when(url.rlike(UNTIDY), "tracking parameter"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def page_number(url: Column) -> Column:
    """From ?page=N or /page/N; null otherwise."""
    n = F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]page=([0-9]{1,6})", 1), F.lit("")), F.nullif(F.regexp_extract(path(url), r"/page/([0-9]{1,6})", 1), F.lit("")))
    return n.try_cast("int")


def is_local_host(h: Column) -> Column:
    return h.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.0\.0\.0|\[?::1)") | h.rlike(r"\.(local|localhost|internal|test)(:[0-9]+)?$")


@F.pandas_udf(StringType())
def resolve(href: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute http(s) URL of each reference; null where there is none."""
    from ..sources.dom import resolve as one

    return pd.Series([one(h, b) for h, b in zip(href, base, strict=True)])


@F.pandas_udf(BooleanType())
def is_blocked_address(address: pd.Series) -> pd.Series:
    """Whether an IP address must not be fetched: private, loopback, link-local, reserved, multicast and mapped forms of these. Anything that is no address is blocked."""
    from ipaddress import IPv6Address, ip_address, ip_network

    shared = ip_network("100.64.0.0/10")

    def one(x: str | None) -> bool:
        try:
            ip = ip_address((x or "").strip("[]").partition("%")[0])
        except ValueError:
            return True
        if isinstance(ip, IPv6Address):
            inner = ip.ipv4_mapped or ip.sixtofour or (ip_address(int(ip) & 0xFFFFFFFF) if ip in ip_network("64:ff9b::/96") else None)
            ip = inner or ip
        return not ip.is_global or ip.is_multicast or (ip.version == 4 and ip in shared)

    return address.map(one)
