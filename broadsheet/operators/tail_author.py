"""Byline in the last paragraphs of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.authors import is_valid_author
from broadsheet.functions.html import all_of, any_of, attr, both, each, having, holding, inside, keep, let, quoted, tag, whole_text, within
from broadsheet.functions.text import strip

# Where the article body is, and how many nodes at its end are looked at.
AREA = any_of(
    tag("article"), having("post-body"), having("detail-content"), having("main-content"),
    holding("class", "content", "div"), holding("id", "content", "div"))
LAST_NODES = 15
_LOOKS = ("class", "style", "align")
_LAST = any_of(tag("p"), all_of(tag("div"), any_of(holding("class", "author"), *[holding(name, "right") for name in _LOOKS])))

# Fixed value: how a source is named.
SOURCE_LABEL = r"(?iu)(?:Nguồn|Theo|Source)\s*:?\s*(.+)"


def last_nodes(page: str = "page") -> Column:
    """Text and emphasis of the last paragraphs and byline-like blocks, the very last one first."""
    def aligned(row: str) -> str:
        marks = [*((name, "right") for name in _LOOKS), ("class", "t-a-r")]
        return " OR ".join(f"contains(lower({attr(row, name)}), {quoted(mark)})" for name, mark in marks)

    def rule(nodes: str, words: str) -> str:
        def node(row: str, strong: str) -> str:
            text = f"trim(regexp_replace({whole_text(words, row)}, {quoted('[ \t\r\n]+')}, ' '))"
            marked = f"size({keep(strong, lambda s: within(s, row))}) > 0"
            return f"named_struct('text', {text}, 'strong', {aligned(row)} OR {marked})"

        def chosen(areas: str) -> str:
            body = keep(nodes, all_of(_LAST, lambda row: f"(size({areas}) = 0 OR {inside(row, areas)})"))
            return f"slice(reverse({body}), 1, {LAST_NODES})"

        return let(keep(nodes, tag("strong", "b", "em")), lambda strong: each(
            let(keep(nodes, AREA), chosen), lambda row: node(row, strong)))

    return F.expr(both(page, rule))


def tail_author(page: str = "page") -> Column:
    """First byline among the last nodes of a parsed page, the very last node first."""

    def pick(node: Column) -> Column:
        text = strip(F.regexp_replace(node["text"], '["“”]', ""))
        named = strip(F.regexp_extract(text, SOURCE_LABEL, 1))
        short = F.length(text).between(2, 100)
        return (
            F.when(short & (named != "") & is_valid_author(named), named)
            .when(short & node["strong"] & is_valid_author(text), text)
        )

    return F.get(F.filter(F.transform(last_nodes(page), pick), lambda name: name.isNotNull()), F.lit(0))
