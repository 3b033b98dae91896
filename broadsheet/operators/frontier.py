"""Breadth-first walk over section links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import html, urls
from broadsheet.functions.text import let
from broadsheet.operators.merging import not_yet_in
from broadsheet.operators.page_parser import parse
from broadsheet.session import stage

DEPTH_LIMIT = 5


def links(pages: DataFrame) -> DataFrame:
    """Every link of every page: page_id, url, base (the address that links start from), position, href."""
    read = pages.select("page_id", "url", parse(F.col("html")).alias("page"))
    based = read.select("page_id", "url", "page", html.base(F.col("url")).alias("base"))
    return based.select("page_id", "url", "base", F.posexplode(html.hrefs()).alias("position", "href"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links that stay on the site, as absolute URL with their kind: page_id, url, base, position, href, target, kind; others are dropped.

    A page's links are resolved and judged inside its list, each once, and only those
    that stay become rows; as columns, the optimizer would write the rules into every
    filter on them.
    """
    read = pages.select("page_id", "url", parse(F.col("html")).alias("page"))

    def judged(page: Column) -> Column:
        listed = F.transform(html.hrefs(), lambda href, i: F.struct(i.alias("position"), href.alias("href")))
        resolved = F.transform(
            F.filter(listed, lambda link: urls.is_page_link(link["href"])),
            lambda link: F.struct(
                page["base"].alias("base"), link["position"].alias("position"), link["href"].alias("href"),
                urls.resolve_from(page["seen"], link["href"]).alias("target")))
        kinds = F.transform(resolved, lambda link: F.struct(
            *[link[c].alias(c) for c in ("base", "position", "href", "target")],
            F.when(urls.on_site(page["host"], link["target"]), urls.kind_on(page["host"], link["target"])).alias("kind")))
        return F.filter(kinds, lambda link: link["kind"].isNotNull())

    page = let(html.base(F.col("url")), lambda base: F.struct(
        base.alias("base"), urls.authority(F.col("url")).alias("host"), urls.seen_from(base).alias("seen")))
    return read.select("page_id", "url", F.inline(let(page, judged)))


def walk(edges: DataFrame, seeds: DataFrame, depth_limit: int = DEPTH_LIMIT) -> DataFrame:
    """URLs reached from ``seeds`` (url) along ``edges`` (url, target, kind), each once with its depth.

    Sections are followed, articles are not. The edges and each level are written
    once, so pages are not parsed again and the plan does not grow with the depth.
    """
    edges = stage(edges.select("url", "target", "kind"), "edges")
    seen = stage(seeds.select("url").distinct().select("url", F.lit("section").alias("kind"), F.lit(0).alias("depth")), "frontier")
    level = seen
    for depth in range(1, depth_limit + 1):
        sources = level.filter("kind = 'section'").select("url")
        found = (
            edges.join(sources, "url").groupBy(F.col("target").alias("url")).agg(F.min("kind").alias("kind"))
            .withColumn("depth", F.lit(depth))
        )
        level = stage(not_yet_in(found, seen, ["url"]), "frontier")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
