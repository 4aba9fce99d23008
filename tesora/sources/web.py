"""Links to published files inside fetched pages."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extensions of official publications.
OFFICIAL_EXTENSIONS = (".xls", ".xlsx", ".docx")

_ANCHOR = r"(?is)(<a\b[^>]*\bhref\s*=[^>]*>.*?</a\s*>)"
_HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
_REFERENCE = re.compile("&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All character references that end in a semicolon as characters."""
    return texts.map(lambda t: t if t is None or "&" not in t else _REFERENCE.sub(lambda m: entities.unescape(m[0]), t))


def _href_and_title(anchor: Column) -> Column:
    # the three quoting forms are exclusive, so joining the groups gives the one that matched
    href = F.concat(*[F.regexp_extract(anchor, _HREF, i) for i in (1, 2, 3)])
    inner = F.regexp_replace(F.regexp_replace(anchor, r"(?is)^<a\b[^>]*>", ""), r"(?is)<[^>]*>", " ")
    return F.struct(href.alias("href"), inner.alias("title"))


def anchors(pages: DataFrame, *, page: str = "url", html: str = "html") -> DataFrame:
    """(page, href, title), one row per anchor with a target, character references resolved."""
    found = F.transform(F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), F.lit(1)), _href_and_title)
    raw = pages.select(F.col(page).alias("page"), F.inline(found))
    plain = raw.select("page", unescape("href").alias("href"), unescape("title").alias("title"))
    title = F.trim(F.regexp_replace("title", r"[\s\u00a0]+", " "))
    return plain.select("page", F.trim("href").alias("href"), title.alias("title")).where("href <> ''")


def _without_dots(url: Column) -> Column:
    """``.`` and ``..`` folder names resolved, however many there are; the site is never left."""
    site = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    rest = F.substring(url, F.length(site) + F.length(path) + 1, F.length(url))
    names = F.split(path, "/")
    kept = F.aggregate(
        F.slice(names, 2, F.size(names)),
        F.array(F.lit("")),
        lambda out, name: F.when(name == ".", out)
        .when(name == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1))))
        .otherwise(F.concat(out, F.array(name))),
    )
    ends = F.when(F.element_at(names, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.contains("/."), F.concat(site, F.array_join(F.concat(kept, ends), "/"), rest)).otherwise(url)


def absolute_url(page: Column | str, href: Column | str) -> Column:
    """Target against the page address: absolute, scheme-relative, root-relative or relative to the folder."""
    page = F.col(page) if isinstance(page, str) else page
    href = F.col(href) if isinstance(href, str) else href
    site = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(page, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    bare = F.regexp_replace(page, r"#.*$", "")
    joined = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("#"), F.concat(bare, href))
        .when(href.startswith("?"), F.concat(site, path, href))
        .otherwise(F.concat(site, folder, href))
    )
    return joined


def extension(url: Column | str) -> Column:
    """Lower-cased extension of the last path segment, with its dot; empty without one."""
    url = F.col(url) if isinstance(url, str) else url
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def host(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_allowed(url: Column | str, hosts: Sequence[str]) -> Column:
    """https and a listed host; subdomains are not implied."""
    url = F.col(url) if isinstance(url, str) else url
    return url.rlike(r"^[hH][tT][tT][pP][sS]://") & host(url).isin(*[h.lower() for h in hosts])


def discover_links(
    pages: DataFrame,
    *,
    extensions: Sequence[str] | None = OFFICIAL_EXTENSIONS,
    hosts: Sequence[str] | None = None,
    page: str = "url",
    html: str = "html",
) -> DataFrame:
    """One row per linked file with its longest title. ``extensions=None`` keeps every link.

    Links repeated on a third of all pages are collapsed before the shuffle.
    """
    found = anchors(pages, page=page, html=html)
    links = found.select(absolute_url("page", "href").alias("url"), "title")
    links = links.withColumn("url", _without_dots(F.col("url"))).withColumn("extension", extension("url"))
    if extensions is not None:
        links = links.where(F.col("extension").isin(*[e.lower() for e in extensions]))
    if hosts is not None:
        links = links.where(is_allowed("url", hosts))
    # longest title first, alphabetical order among equally long ones
    best = links.groupBy("url", "extension").agg(
        F.min(F.struct((-F.length("title")).alias("n"), F.col("title"))).alias("best"),
        F.count(F.lit(1)).alias("occurrences"),
    )
    return best.select("url", F.col("best.title").alias("title"), "extension", "occurrences")
