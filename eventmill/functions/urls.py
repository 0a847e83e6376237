"""Addresses made absolute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventmill.functions.once import let

# Scheme, host part, path, query, fragment: the pattern of RFC 3986, appendix B.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Schemes whose addresses have paths that others are relative to.
HIERARCHICAL = ["", "http", "https", "ftp", "sftp", "file", "ws", "wss"]


def _parts(url: Column) -> Column:
    def group(n: int, name: str) -> Column:
        return F.regexp_extract(url, _PARTS, n).alias(name)

    has_host = url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//").alias("has_host")
    return F.struct(F.lower(F.regexp_extract(url, _PARTS, 1)).alias("scheme"), group(2, "host"), has_host, group(3, "path"), group(4, "query"), group(5, "fragment"))


def _without_dots(segments: Column) -> Column:
    """`.` goes, `..` takes the segment before it away, as far as there is one; either at the end leaves a `/`."""

    def step(taken: Column, segment: Column) -> Column:
        shorter = F.slice(taken, F.lit(1), F.greatest(F.size(taken) - 1, F.lit(0)))
        return F.when(segment == "..", shorter).when(segment == ".", taken).otherwise(F.concat(taken, F.array(segment)))

    resolved = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return let(F.array_join(F.concat(resolved, ends), "/"), lambda path: F.when(path == "", "/").otherwise(path))


def _path(base: Column, path: Column) -> Column:
    absolute = F.split(path, "/")
    folder = F.split(F.regexp_replace(base, r"(?s)[^/]*$", ""), "/")
    # what is behind the last slash of the base gives way; the first and the last segment may be empty, others not
    relative = F.concat(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - 1, F.lit(0))), absolute)

    def joined(all_: Column) -> Column:
        inner = F.filter(F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 2, F.lit(0))), lambda s: s != "")
        return F.when(F.size(all_) < 2, all_).otherwise(F.concat(F.slice(all_, 1, 1), inner, F.slice(all_, -1, 1)))

    segments = F.when(path.startswith("/"), absolute).otherwise(let(relative, joined))
    return let(segments, _without_dots)


def _url(scheme: Column, host: Column, path: Column, query: Column, fragment: Column) -> Column:
    # only what has a scheme or a host gets the two slashes, and then a path begins with one
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    with_host = F.when((host != "") | ((scheme != "") & scheme.isin(HIERARCHICAL) & ~path.startswith("//")), F.concat(F.lit("//"), host, rooted))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.coalesce(with_host, path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def resolve_url(base: Column, url: Column) -> Column:
    """The address that `url` stands for on a page at `base`: RFC 3986, dot segments included.

    Without a base the address stays as it is; an empty one stands for the page; one with a scheme of its own, or under a
    base without paths, stays. NULL gives NULL.
    """

    def join(p: Column) -> Column:
        b, u = p["b"], p["u"]
        scheme = F.when(u["scheme"] == "", b["scheme"]).otherwise(u["scheme"])
        other = (scheme != b["scheme"]) | ~scheme.isin(HIERARCHICAL)
        bare = u["path"] == ""
        return (
            F.when(other, url)
            .when(u["host"] != "", _url(scheme, u["host"], u["path"], u["query"], u["fragment"]))
            .when(bare, _url(scheme, b["host"], b["path"], F.when(u["query"] == "", b["query"]).otherwise(u["query"]), u["fragment"]))
            .otherwise(_url(scheme, b["host"], _path(b["path"], u["path"]), u["query"], u["fragment"]))
        )

    joined = let(F.struct(_parts(base).alias("b"), _parts(url).alias("u")), join)
    return F.when(url.isNull() | base.isNull() | (base == ""), url).when(url == "", base).otherwise(joined)
