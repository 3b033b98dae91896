"""URL expressions: host, resolving, link classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import let

# Link prefixes that are no pages.
SKIPPED_PREFIXES = ["mailto:", "tel:", "javascript:", "#"]

# Endings that mark an article when found anywhere in the URL.
ARTICLE_MARKS = [".html", ".htm", ".amp"]

# A section URL has at most this many "/"-pieces after its "https://host".
SECTION_PIECES = 3


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)


def authority(url: Column) -> Column:
    """Host with its port, if any. A pattern, since strict URI parsing rejects real-world links."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """Third "/"-piece when the URL has "//", else the whole text."""
    return F.when(F.contains(url, F.lit("//")), F.split_part(url, F.lit("/"), F.lit(3))).otherwise(url)


def is_page_link(href: Column) -> Column:
    keep = F.lit(True)
    for prefix in SKIPPED_PREFIXES:
        keep = keep & ~F.startswith(href, F.lit(prefix))
    return keep


def _without_dot_segments(path: Column) -> Column:
    """Remove "." and ".." pieces; the last piece keeps its role as a directory when it was one of them."""
    pieces = F.split(path, "/")
    kept = F.aggregate(
        pieces,
        F.array().cast("array<string>"),
        lambda done, piece: F.when(piece == ".", done)
        .when(piece == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(piece))),
    )
    closing = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), closing)


def seen_from(page_url: Column) -> Column:
    """The parts of a page's address that its links are resolved with."""
    bare = F.regexp_replace(page_url, r"[?#].*$", "")
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    return F.struct(
        scheme(page_url).alias("scheme"),
        F.concat(scheme(page_url), F.lit("://"), authority(page_url)).alias("site"),
        F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")).alias("folder"),
        bare.alias("bare"),
        F.regexp_replace(page_url, "#.*$", "").alias("whole"),
    )


def resolve_from(page: Column, href: Column) -> Column:
    """Absolute form of ``href`` as seen from a page (``seen_from``)."""
    link_path = F.regexp_replace(href, r"[?#].*$", "")
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    joined = F.when(F.startswith(href, F.lit("/")), link_path).otherwise(F.concat(page["folder"], link_path))
    flat = let(joined, lambda path: F.when(path.rlike(r"(^|/)\.\.?(/|$)"), _without_dot_segments(path)).otherwise(path))
    return (
        F.when(href == "", page["whole"])
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(page["scheme"], F.lit(":"), href))
        .when(F.startswith(href, F.lit("?")), F.concat(page["bare"], href))
        .when(F.startswith(href, F.lit("#")), F.concat(page["whole"], href))
        .otherwise(F.concat(page["site"], flat, tail))
    )


def resolve(page_url: Column, href: Column) -> Column:
    """Absolute form of ``href`` as seen from ``page_url``."""
    return let(seen_from(page_url), lambda page: resolve_from(page, href))


def on_site(host: Column, full_url: Column) -> Column:
    return F.contains(full_url, host)


def same_site(page_url: Column, full_url: Column) -> Column:
    """The page's host occurs anywhere in the link, so subdomains and redirect links count too."""
    return on_site(authority(page_url), full_url)


def kind_on(host: Column, full_url: Column) -> Column:
    """``article``, ``section`` or NULL. Only "https://host" is cut off before counting pieces."""
    is_article = F.lit(False)
    for mark in ARTICLE_MARKS:
        is_article = is_article | F.contains(full_url, F.lit(mark))
    rest = F.replace(full_url, F.concat(F.lit("https://"), host), F.lit(""))
    return F.when(is_article, F.lit("article")).when(
        F.size(F.split(rest, "/")) <= SECTION_PIECES, F.lit("section")
    )


def link_kind(page_url: Column, full_url: Column) -> Column:
    return kind_on(authority(page_url), full_url)
