"""Rules on the rows of a page (``operators.page_parser``): which elements are meant, their texts, the page's title, text and links.

The rules are SQL expressions put together as text, since there are many of them
and they nest: a ``page`` is the name of its column (or any expression for it), a row
the variable of a lambda. Only what a job selects is made a Column.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions import text as plain
from broadsheet.functions import urls
from broadsheet.operators.page_parser import TEXT

_BLOCKS = ["br", "p", "div", "li", "ul", "ol", "h2", "h3", "h4", "h5", "h6", "tr"]
_HIDDEN = ["script", "style", "h1"]

Test = Callable[[str], str]

_numbers = count()


def quoted(value: str) -> str:
    """``value`` as a SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lambda(body: Callable[[str], str]) -> str:
    name = f"v{next(_numbers)}"
    return f"{name} -> {body(name)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body(value)`` with ``value`` computed once."""
    return f"get(transform(array({value}), {_lambda(body)}), 0)"


def keep(items: str, test: Test) -> str:
    return f"filter({items}, {_lambda(test)})"


def each(items: str, body: Callable[[str], str]) -> str:
    return f"transform({items}, {_lambda(body)})"


def first(items: str) -> str:
    return f"get({items}, 0)"


def first_shown(items: str) -> str:
    return first(keep(items, lambda value: f"{value} IS NOT NULL"))


def strip(text: str) -> str:
    return f"regexp_replace({text}, {quoted(rf'{plain.SPACE}+\z|\A{plain.SPACE}+')}, '')"


def squeezed(text: str) -> str:
    return strip(f"regexp_replace({text}, {quoted(plain.SPACE + '+')}, ' ')")


def attr(row: str, name: str) -> str:
    """An attribute's value, empty where it is absent."""
    return f"coalesce({row}.attrs[{quoted(name)}], '')"


# Tests on a row.


def element(row: str) -> str:
    return f"{row}.`close` IS NOT NULL"


def tag(*names: str) -> Test:
    return lambda row: f"{row}.tag IN ({', '.join(map(quoted, names))})"


def having(*names: str, of: str | None = None) -> Test:
    """All of these classes, on an element ``of`` this tag if given."""
    return all_of(*_of(of), *[lambda row, n=name: f"array_contains({row}.classes, {quoted(n)})" for name in names])


def equal(name: str, value: str, of: str | None = None) -> Test:
    return all_of(*_of(of), lambda row: f"{attr(row, name)} = {quoted(value)}")


def holding(name: str, part: str, of: str | None = None) -> Test:
    return all_of(*_of(of), lambda row: f"contains({attr(row, name)}, {quoted(part)})")


def _of(name: str | None) -> list[Test]:
    return [tag(name)] if name else []


def all_of(*tests: Test) -> Test:
    return lambda row: "(" + " AND ".join(test(row) for test in tests) + ")"


def any_of(*tests: Test) -> Test:
    return lambda row: "(" + " OR ".join(test(row) for test in tests) + ")"


def within(row: str, area: str) -> str:
    """Whether a row lies inside an element: a comparison of numbers."""
    return f"({area}.`at` < {row}.`at` AND {row}.`at` < {area}.`close`)"


def inside(row: str, areas: str) -> str:
    return f"exists({areas}, {_lambda(lambda area: within(row, area))})"


def matching(nodes: str, test: Test, area: Test | None = None) -> str:
    """Elements that pass ``test``, in page order; only those inside an element that passes ``area``, if given."""
    if area is None:
        return keep(nodes, test)
    return let(keep(nodes, area), lambda areas: keep(nodes, all_of(test, lambda row: inside(row, areas))))


def own_texts(words: str, row: str) -> str:
    """Texts directly inside an element."""
    return each(keep(words, lambda t: f"{t}.owner = {row}.`at`"), lambda t: f"{t}.text")


def whole_text(words: str, row: str) -> str:
    """All texts below an element, in order."""
    return f"array_join({each(keep(words, lambda t: within(t, row)), lambda t: f'{t}.text')}, '')"


def taken(nodes: str, words: str, what: str, test: Test, area: Test | None = None) -> str:
    """What is taken at a place: ``all`` own texts of all matches, the first own ``text`` of one, or the first attribute of that name."""
    found = matching(nodes, test, area)
    if what == "all":
        shown = f"flatten({each(found, lambda row: each(own_texts(words, row), strip))})"
        return f"array_join({keep(shown, lambda t: f'{t} <> {quoted('')}')}, ' ')"
    if what == "text":
        return first_shown(each(found, lambda row: first(own_texts(words, row))))
    return first_shown(each(found, lambda row: f"{row}.attrs[{quoted(what)}]"))


def both(page: str, rule: Callable[[str, str], str]) -> str:
    """``rule(elements, texts)`` of a page."""
    return let(keep(page, element), lambda nodes: let(keep(page, tag(TEXT)), lambda words: rule(nodes, words)))


# What a job selects.


def hrefs(page: str = "page") -> Column:
    """Targets of every link in page order, references decoded; links in comments and scripts do not count."""
    return F.expr(each(keep(page, all_of(tag("a"), lambda row: f"{row}.attrs['href'] IS NOT NULL")), lambda row: f"{row}.attrs['href']"))


def base(url: Column, page: str = "page") -> Column:
    """The address that links start from: the page's own declaration, seen from its address, else its address."""
    declared = F.expr(first(keep(page, all_of(tag("base"), lambda row: f"{attr(row, 'href')} <> ''"))) + ".attrs['href']")
    return plain.let(declared, lambda href: F.when(href.isNotNull(), urls.resolve(url, href)).otherwise(url))


def page_title(page: str = "page") -> Column:
    """The first heading, else the document title."""
    def rule(nodes: str, words: str) -> str:
        def named(name: str) -> str:
            return let(first(keep(nodes, tag(name))), lambda row: squeezed(f"coalesce({whole_text(words, row)}, '')"))

        return let(named("h1"), lambda heading: f"CASE WHEN {heading} <> '' THEN {heading} ELSE {named('title')} END")

    return F.expr(both(page, rule))


def page_text(page: str = "page") -> Column:
    """Body text: the outermost article areas (else the body) without scripts, styles, comments and headings; blocks are set apart."""
    blocks = ", ".join(quoted(mark + name) for name in _BLOCKS for mark in ("", "/"))

    def areas(nodes: str) -> str:
        return let(keep(nodes, tag("article")), lambda articles: (
            f"CASE WHEN size({articles}) > 0 THEN {keep(articles, lambda row: f'NOT {inside(row, articles)}')} "
            f"ELSE slice({keep(nodes, tag('body'))}, 1, 1) END"))

    def shown(row: str) -> str:
        return f"CASE WHEN {tag(TEXT)(row)} THEN {row}.text WHEN {row}.tag IN ({blocks}) THEN ' ' ELSE '' END"

    def of_area(area: str, hidden: str) -> str:
        rows = f"slice({page}, {area}.`at` + 2, greatest({area}.`close` - {area}.`at` - 1, 0))"
        return f"array_join({each(keep(rows, lambda row: f'NOT {inside(row, hidden)}'), shown)}, '')"

    def rule(nodes: str) -> str:
        return let(areas(nodes), lambda found: let(keep(nodes, tag(*_HIDDEN)), lambda hidden: squeezed(
            f"array_join({each(found, lambda area: of_area(area, hidden))}, ' ')")))

    return F.expr(let(keep(page, element), rule))
