"""URL parsing, relative resolution and address policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks import fixed


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without user information or port; empty when there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def last_segment(url: Column, fallback: str = "unknown") -> Column:
    tail = F.regexp_extract(path(url), r"([^/]*)$", 1)
    return F.when(tail == "", F.lit(fallback)).otherwise(tail)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, or empty. A leading dot starts no extension."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]*)$", 1))


def remove_dot_segments(url: Column) -> Column:
    """Fold ``.`` and ``..`` path segments of an absolute URL."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^?#]*(.*)$", 1)
    segments = F.split(F.regexp_replace(path(url), "^/", ""), "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, piece: F.when(piece == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(piece == ".", kept)
        .otherwise(F.concat(kept, F.array(piece))),
    )
    closing = F.when(path(url).rlike(r"/\.{1,2}$") & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit(""))
    clean = F.concat(root, F.lit("/"), F.array_join(folded, "/"), closing, tail)
    return F.when(path(url).rlike(r"/\.{1,2}(/|$)"), clean).otherwise(url)


def joined(href: Column, base: Column) -> Column:
    """``href`` read against ``base``, dot segments not yet folded."""
    base_root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_page = F.regexp_extract(base, r"^([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"^([^#]*)", 1)
    base_folder = F.when(path(base) == "", F.concat(base_root, F.lit("/"))).otherwise(
        F.regexp_replace(base_page, r"[^/]*$", "")
    )
    absolute = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base_root, href))
        .when(href.startswith("#"), F.concat(base_query, href))
        .when(href.startswith("?"), F.concat(base_page, href))
        .when(href == "", base_query)
        .otherwise(F.concat(base_folder, href))
    )
    return F.regexp_replace(absolute, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)([?#]|$)", "$1/$2")


def resolve(href: Column, base: Column) -> Column:
    """``href`` as an absolute URL, read against ``base``."""
    return remove_dot_segments(joined(href, base))


def normal(url: Column) -> Column:
    """Scheme and host in lower case, without the scheme's own port."""
    kind = scheme(url)
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    user = F.regexp_extract(place, r"^(.*@)", 1)
    where = F.lower(F.substring(place, F.length(user) + 1, F.length(place)))
    own = F.when(kind == "http", F.regexp_replace(where, ":(80)?$", "")).when(kind == "https", F.regexp_replace(where, ":(443)?$", "")).otherwise(where)
    tail = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?s)(.*)$", 1)
    return F.when(place == "", url).otherwise(F.concat(kind, F.lit("://"), user, own, tail))


def is_http(url: Column) -> Column:
    return url.rlike(fixed.HTTP_URL)


def is_blocked_host(name: Column) -> Column:
    return name.rlike(fixed.BLOCKED_HOST)


def is_allowed(url: Column, https_only: bool = False) -> Column:
    """Well-formed http(s) address outside local and private ranges."""
    schemes = ["https"] if https_only else ["http", "https"]
    allowed = scheme(url).isin(*schemes) & (host(url) != "") & ~is_blocked_host(host(url))
    return F.coalesce(allowed, F.lit(False))
