"""Scalar functions over URLs and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from conform.functions.text import normalize_path


def is_remote(uri: Column) -> Column:
    return uri.rlike("^https?://")


def base_of(ref: Column) -> Column:
    return F.split_part(ref, F.lit("#"), F.lit(1))


def fragment_of(ref: Column) -> Column:
    """What follows the first ``#``; null without one."""
    return F.when(ref.contains("#"), F.substring(ref, F.length(base_of(ref)) + 2, F.length(ref)))


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """The path of a URL, ``/`` if it has none; null for a text that is no URL."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(origin_of(url) != "", F.when(path == "", F.lit("/")).otherwise(path))


def url_join(base: Column, ref: Column) -> Column:
    """A reference resolved against a base URL."""
    origin, folder = origin_of(base), F.regexp_replace(url_path(base), r"[^/]*$", "")
    path = base_of(ref)
    tail = F.when(ref.contains("#"), F.concat(F.lit("#"), fragment_of(ref))).otherwise(F.lit(""))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    joined = F.concat(origin, normalize_path(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), F.when(path.rlike(r"(^|/)\.{0,2}$|/$") & (path != ""), F.lit("/")).otherwise(F.lit("")), tail)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(path == "", F.concat(base_of(base), tail))
        .otherwise(joined)
    )


def filename_of(url: Column) -> Column:
    """The last part of a URL's path with ``.json`` at its end; the host where the path has none."""
    last = F.substring_index(url_path(url), "/", -1)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(last == "", F.concat(host, F.lit(".json"))).when(F.lower(last).endswith(".json"), last).otherwise(F.concat(last, F.lit(".json")))


def _page(url: Column, base: str, end: str) -> Column:
    rest = F.regexp_replace(F.substring(url, F.lit(len(base) + 1), F.length(url)), end, "")
    return F.when(url.startswith(base), F.when(rest.endswith("/") | (rest == ""), rest).otherwise(F.concat(rest, F.lit("/"))))


def schema_page_url(url: Column, base: str) -> Column:
    """The page of a schema's latest version under a base URL; null outside of it."""
    return _page(url, base, r"latest\.json$")


def version_page_url(url: Column, base: str) -> Column:
    """The page of a version under a base URL; null outside of it."""
    return _page(url, base, r"\.json$")


def expand_registry(url: Column) -> Column:
    """The URLs to try for a registry: ``github:org/repo[/branch]`` is a short form, ``main`` is tried before ``master``."""
    parts = F.split(F.substring(url, F.lit(8), F.length(url)), "/")
    raw = lambda branch: F.concat(F.lit("https://raw.githubusercontent.com/"), F.get(parts, 0), F.lit("/"), F.get(parts, 1), F.lit("/"), branch, F.lit("/catalog.json"))
    return F.when(url.startswith("github:"), F.when(F.size(parts) > 2, F.array(raw(F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/")))).otherwise(F.array(raw(F.lit("main")), raw(F.lit("master"))))).otherwise(F.array(url))
