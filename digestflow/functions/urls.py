"""URL columns, in Spark's functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

#: Query parameters that only track, and their prefix.
TRACKERS = ("fbclid", "gclid", "mc_cid", "mc_eid", "yclid")
TRACKER_PREFIX = "utm_"
#: Hosts of channel links.
CHANNEL_HOSTS = ("t.me", "www.t.me", "telegram.me", "www.telegram.me")

_CHANNEL_URL = r"(?i)^https?://(?:" + "|".join(h.replace(".", r"\.") for h in CHANNEL_HOSTS) + r")(?:[/?#]|$)"


#: Scheme, authority, path and query of a URL with an authority; the fragment is left.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(path: Column) -> Column:
    """The names on a path once . and .. are carried out: array<string>."""

    def walked(done: Column, name: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))
        return F.when(name.isin("", "."), done).when(name == "..", up).otherwise(F.array_append(done, name))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), walked)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    # form encoding as RFC 3986 has it: the tilde stands for itself, the asterisk doesn't
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _kept_query(query: Column) -> Column:
    """?query -> its parameters without trackers, sorted and encoded anew."""

    def pair(text: Column) -> Column:
        key = F.substring_index(text, "=", 1)
        return F.struct(_decoded(key).alias("k"), _decoded(F.substr(text, F.char_length(key) + 2)).alias("v"))

    given = F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda x: x != "")
    pairs = F.filter(F.transform(given, pair), lambda p: ~(F.lower(p["k"]).isin(*TRACKERS) | F.lower(p["k"]).startswith(TRACKER_PREFIX)))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.when(F.coalesce(query, F.lit("")) == "", "").otherwise(F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))


def canonicalize_url(url: Column) -> Column:
    """The identity of a URL: lower-case scheme and host, no default port, clean path, sorted query without trackers, no
    fragment; null for anything but an absolute http(s) URL without user info."""
    given = stripped(url)
    scheme, place = F.lower(_part(given, 1)), F.lower(_part(given, 2))
    host = F.regexp_extract(place, r"^(\[[^\]]*\]|[^:@\[\]]*)(?::[0-9]*)?$", 1)
    port = F.regexp_extract(place, r":([0-9]+)$", 1).try_cast("int")
    usual = F.when(scheme == "http", 80).otherwise(443)
    shown = F.when(port.isNull() | (port == usual), "").otherwise(F.concat(F.lit(":"), port.cast("string")))
    valid = scheme.isin("http", "https") & (host != "") & (F.coalesce(port, F.lit(0)) <= 65535) & (F.char_length(F.regexp_extract(place, r":([0-9]+)$", 1)) < 9)
    path = F.concat(F.lit("/"), F.array_join(_steps(_part(given, 3)), "/"))
    return F.when(valid, F.concat(scheme, F.lit("://"), host, shown, path, _kept_query(_part(given, 4))))


def absolute_url(base: Column, href: Column) -> Column:
    """href against base; keeps the query's order and a trailing slash, drops the fragment."""

    def resolved(h: Column) -> Column:
        root = F.concat(F.lower(_part(base, 1)), F.lit("://"), F.lower(_part(base, 2)))
        query, own = F.regexp_extract(h, r"(\?.*)$", 1), F.regexp_extract(h, r"^([^?]*)", 1)
        folder = F.regexp_extract(_part(base, 3), "^(.*/)", 1)
        path = F.when(own == "", _part(base, 3)).when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
        relative = F.concat(root, _clean(path), F.when((own == "") & (query == ""), _part(base, 4)).otherwise(query))
        beside = F.concat(F.lower(_part(base, 1)), F.lit(":"), h)
        whole = F.when(h.startswith("//"), beside).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        with_host = _let(whole, lambda u: F.concat(F.lower(_part(u, 1)), F.lit("://"), F.lower(_part(u, 2)), _clean(_part(u, 3)), _part(u, 4)))
        return F.when(whole.isNull(), relative).when(whole.rlike("^[^:]+://"), with_host).otherwise(whole)

    return F.when(base.isNotNull(), _let(F.regexp_replace(stripped(href), "#.*$", ""), resolved))


def _clean(path: Column) -> Column:
    slash = F.when(path.rlike(r"(^|/)\.{0,2}$") & (F.size(_steps(path)) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(_steps(path), "/"), slash)


def is_channel(locator: Column) -> Column:
    return stripped(locator).startswith("@") | stripped(locator).rlike(_CHANNEL_URL)


def channel_handle(locator: Column) -> Column:
    """The handle of an @handle or a channel's URL: a letter, then 3 to 31 letters, digits or underscores; else null."""
    given = stripped(locator)
    path = F.regexp_extract(given, r"^[^:]+://[^/?#]*(/[^?#]*)", 1)
    named = F.when(given.startswith("@"), F.substring(given, 2, 1000)).otherwise(F.regexp_extract(path, r"^/(?:s/)?/*([^/]*)", 1))
    return F.when(is_channel(locator) & named.rlike("^[A-Za-z][A-Za-z0-9_]{3,31}$"), named)


def normalize_locator(locator: Column) -> Column:
    """@handle in lower case for channels, the canonical URL for others, null for neither."""
    return F.when(is_channel(locator), F.concat(F.lit("@"), F.lower(channel_handle(locator)))).otherwise(canonicalize_url(locator))


def infer_collector(locator: Column) -> Column:
    """web_preview for channels, native_rss for what looks like a feed, universal_scraper for other pages; null if invalid."""
    normal = normalize_locator(locator)
    path = F.lower(F.regexp_extract(normal, r"^[^:]+://[^/?#]*([^?#]*)", 1))
    feed = path.rlike(r"\.(rss|xml|atom)$") | path.contains("/feed")
    return F.when(normal.isNull(), None).when(is_channel(locator), "web_preview").when(feed, "native_rss").otherwise("universal_scraper")


def link_label(url: Column) -> Column:
    """The host without www., or t.me/<handle> for a channel's link; the URL itself if it has no host."""
    host = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    handle = F.regexp_extract(F.regexp_replace(path, "^s/", ""), "^[^/]*", 0)
    return F.when(host.isin("t.me", "telegram.me") & (handle != ""), F.concat(F.lit("t.me/"), handle)).when(host != "", host).otherwise(url)
