"""URL expressions: canonical form, domains, search queries, paths. Plain Column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query keys that only track; fixed values. Keys that start with utm_ are tracking too.
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "mkt_tok", "ref", "ref_src", "si", "spm", "source", "sourceid")
#: Suffixes under which a registrable domain has three labels; fixed values.
LONG_SUFFIXES = ("co.jp", "co.kr", "co.uk", "com.au", "com.cn", "com.hk", "com.sg", "com.tr", "com.tw", "net.cn", "org.cn")
#: Keys that search engines put the query in, and the domains whose queries are read; fixed values.
SEARCH_KEYS = ("q", "query", "query_text", "search_query", "p", "wd", "word", "text", "keyword", "k")
SEARCH_DOMAINS = ("baidu.com", "bing.com", "brave.com", "duckduckgo.com", "google.com", "sogou.com", "so.com", "yahoo.com", "yandex.ru")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dots."""
    raw = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"^.*@", ""), r":\d*$", ""), r"\.+$", "")


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def is_tracking(key: Column) -> Column:
    return F.startswith(key, F.lit("utm_")) | key.isin(*TRACKING)


def decode(part: Column) -> Column:
    """Form decoding; what isn't valid stays as it is."""
    return F.coalesce(F.try_url_decode(part), part)


def params(url: Column) -> Column:
    """All parameters of the query, in order, decoded: array of (key, value), white space of values collapsed."""
    value = lambda x: F.trim(F.regexp_replace(F.replace(decode(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1)), F.lit("+"), F.lit(" ")), r"\s+", " "))
    return F.transform(F.filter(F.split(query(url), "&"), lambda x: x != ""), lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("key"), value(x).alias("value")))


def kept_params(url: Column) -> Column:
    """The query's parameters that don't track, in order."""
    return F.filter(params(url), lambda p: ~is_tracking(F.lower(p.key)))


def tracking_params(url: Column) -> Column:
    return F.filter(params(url), lambda p: is_tracking(F.lower(p.key)))


def query_value(url: Column | Parts, key: str | Column) -> Column:
    """The value of the first parameter of that name, in any case; null if there is none."""
    name = F.lit(key) if isinstance(key, str) else key
    return F.get(F.filter(parse(url).params, lambda p: F.lower(p.key) == F.lower(name)), F.lit(0)).value


def normalize(url: Column | Parts) -> Column:
    """Lower-cased scheme and host, no trailing dot, parameters that don't track decoded and encoded again; the fragment stays. Null unless absolute."""
    u = parse(url)
    kept = F.array_join(F.transform(u.kept, lambda p: F.concat(F.url_encode(p.key), F.lit("="), F.url_encode(p.value))), "&")
    tail = F.concat(F.when(F.size(u.kept) > 0, F.concat(F.lit("?"), kept)).otherwise(""), F.when(fragment(u.url) != "", F.concat(F.lit("#"), fragment(u.url))).otherwise(""))
    return F.when(u.host != "", F.concat(scheme(u.url), F.lit("://"), u.host, u.path, tail))


def registrable_domain(hostname: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    """The last two labels, or three under one of the suffixes of two; a single label as it is."""
    labels = F.split(hostname, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(last(2).isin(*suffixes), last(3)).otherwise(last(2))


def subdomain(hostname: Column) -> Column:
    domain = registrable_domain(hostname)
    return F.when(hostname == domain, "").otherwise(F.substring(hostname, F.lit(1), F.length(hostname) - F.length(domain) - 1))


def path_prefix(url: Column) -> Column:
    """The first segment of the path that isn't empty; '' if there is none."""
    return F.regexp_extract(path(url), r"^/+([^/]+)", 1)


def is_search_host(hostname: Column) -> Column:
    """Built-in engines, whose URLs tell the query."""
    return registrable_domain(hostname).isin(*SEARCH_DOMAINS) | F.startswith(hostname, F.lit("www.google."))


def search_query(url: Column | Parts) -> Column:
    """On an engine's host, the value of the first parameter in the URL that is a search key and isn't empty; else null."""
    u = parse(url)
    found = F.filter(u.kept, lambda p: F.lower(p.key).isin(*SEARCH_KEYS) & (p.value != ""))
    return F.when(u.domain.isin(*SEARCH_DOMAINS) | F.startswith(u.host, F.lit("www.google.")), F.get(found, F.lit(0)).value)


@dataclass(frozen=True)
class Parts:
    """A URL with what many rules ask of it."""

    url: Column
    host: Column
    domain: Column
    path: Column
    params: Column
    kept: Column


def parse(url: Column | Parts) -> Parts:
    if isinstance(url, Parts):
        return url
    return Parts(url, host(url), registrable_domain(host(url)), path(url), params(url), kept_params(url))


def with_parts(df: DataFrame, url_col: str) -> tuple[DataFrame, Parts]:
    """df with the parts of a URL as columns (_host, _domain, _path, _params, _kept), so that they are worked out once a row."""
    url = F.col(url_col)
    first = df.withColumns({"_host": host(url), "_path": path(url), "_params": params(url)})
    second = first.withColumns({"_domain": registrable_domain(F.col("_host")), "_kept": F.filter("_params", lambda p: ~is_tracking(F.lower(p.key)))})
    return second, Parts(url, *[F.col(c) for c in ("_host", "_domain", "_path", "_params", "_kept")])
