"""Where a page's byline and date may be, and which of the candidates is taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions import authors, dates
from broadsheet.functions.html import (
    TEXT, Test, all_of, any_of, attr, both, each, equal, first_shown, having, holding, keep, let, quoted, strip, tag, taken, whole_text,
)
from broadsheet.functions import text as plain

# Fixed value: a page with less text is no article.
MIN_TEXT = 100

# A calendar day alone, in the page's own declarations and in addresses.
DAY = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
DAY_IN_URL = r"/(20\d\d)/(\d{1,2})/(\d{1,2})(?:/|$)"

# A place: what is taken, the test of its element, and of an element around it.
Place = tuple[str, Test] | tuple[str, Test, Test]

_TAC_GIA = holding("href", "tac-gia", "a")
_STRONG = tag("strong")


def _any(row: str) -> str:
    return "true"


# The places of a byline, most trusted first, as (what is taken, element, area around it): the texts of all
# matches, the first text, or an attribute. A place that would repeat an earlier one is left out.
BYLINE_PLACES: list[Place] = [
    ("all", _TAC_GIA),
    ("all", equal("rel", "author", "a")),
    ("text", having("news-detail-project")),
    ("all", _any, having("news-detail-project")),
    ("text", having("relative", "font-medium", of="div")),
    ("text", equal("rel", "author")),
    ("text", _TAC_GIA, having("name", of="div")),
    ("title", _TAC_GIA, having("name", of="div")),
    ("text", _TAC_GIA),
    ("title", _TAC_GIA),
    ("text", all_of(tag("span"), any_of(*[having(f"t{i}") for i in range(1, 7)]))),
    ("text", having("name"), having("author-info")),
    ("text", having("author-name")),
    ("text", tag("a"), having("author-name")),
    ("text", having("detail-author")),
    ("text", having("tacgia")),
    ("text", having("tac-gia")),
    ("text", having("post-author")),
    ("text", having("article-author")),
    ("text", having("author")),
    ("text", equal("itemprop", "name"), equal("itemprop", "author")),
    ("text", _STRONG, holding("style", "text-align:right", "p")),
    ("text", _STRONG, holding("style", "text-align: right", "p")),
    ("text", _STRONG, holding("style", "text-align: right", "div")),
    ("text", _STRONG, having("t-a-r", of="p")),
    ("text", tag("b"), having("t-a-r", of="p")),
]

# The places of a publication date, most trusted first.
DATE_PLACES: list[Place] = [
    ("content", equal("property", "article:published_time", "meta")),
    ("datetime", tag("time")),
    ("text", tag("time")),
    ("content", equal("name", "pubdate", "meta")),
    ("text", having("publish-date")),
    ("text", having("bread-crumb-detail__time")),
    ("text", tag("p"), having("bread-crumb__detail-time")),
    ("text", having("bread-crumb__detail-time")),
    ("text", equal("data-role", "publishdate")),
    ("text", tag("div"), having("detail-time")),
    ("text", having("detail-time")),
    ("text", having("date", of="span")),
    ("text", having("time-now")),
]

# What a page declares about itself, by a rule of our own.
OWN_PLACES: list[Place] = [
    ("content", all_of(tag("meta"), lambda row: f"lower({attr(row, 'name')}) IN ('byl', 'byline', 'dc.creator')")),
    ("text", having("byline")),
]
META_PLACES: list[Place] = [("content", equal("name", "author", "meta")), ("content", equal("property", "article:author", "meta"))]


def _named(row: str) -> str:
    """What a declaration is about: the first of its three names that is not empty."""
    return "lower(coalesce(" + ", ".join(f"nullif({attr(row, name)}, '')" for name in ("itemprop", "name", "property")) + ", ''))"


MORE_DATES: list[Place] = [
    ("content", all_of(tag("meta"), lambda row: (
        f"{_named(row)} IN ('datepublished', 'date', 'dc.date', 'dcterms.created', 'publish-date', 'og:published_time')"))),
]
LINKED_DATE = r'"datePublished"\s*:\s*"([^"]*)"'


def _at(page: str, places: list[Place]) -> str:
    """What is found at each place, null where there is nothing."""
    return both(page, lambda nodes, words: f"array({', '.join(taken(nodes, words, *place) for place in places)})")


def own_byline(page: str = "page") -> Column:
    """What the page itself declares as its byline; tried before the other places."""
    return F.expr(strip(first_shown(_at(page, OWN_PLACES))))


def cascade(page: str = "page") -> Column:
    """First place whose cleaned text can be a byline; later places are not cleaned."""

    def next_one(found: Column, raw: Column) -> Column:
        def judged(name: Column) -> Column:
            return F.when((name != "") & (name != "Unknown"), plain.let(
                authors.clean_candidate(name), lambda clean: F.when(authors.is_valid_author(clean), clean)))

        return F.when(found.isNotNull() | raw.isNull(), found).otherwise(plain.let(plain.strip(raw), judged))

    return F.aggregate(F.expr(_at(page, BYLINE_PLACES)), F.lit(None).cast("string"), next_one)


def meta_author(page: str = "page") -> Column:
    named = F.expr(strip(first_shown(_at(page, META_PLACES))))
    return plain.let(named, lambda found: F.when(authors.is_valid_author(found), found))


def date_candidates(page: str = "page") -> Column:
    """Texts at the places of a publication date, most trusted first, NULL where there is none."""
    return F.expr(_at(page, DATE_PLACES))


def _linked_dates(page: str) -> str:
    """Publication dates named in linked data."""
    scripts = keep(page, all_of(tag("script"), lambda row: f"lower({attr(row, 'type')}) = 'application/ld+json'"))
    return let(keep(page, tag(TEXT)), lambda words: (
        f"flatten({each(scripts, lambda row: f'regexp_extract_all({whole_text(words, row)}, {quoted(LINKED_DATE)}, 1)')})"))


def _day(text: Column, pattern: str) -> Column:
    year, month, day = (F.regexp_extract(text, pattern, g).try_cast("int") for g in (1, 2, 3))
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))


def publish_date(url: Column, page: str = "page") -> Column:
    """First real date at the known places; else one from linked data and further declarations, else the day in the address."""
    named = F.expr(f"concat({_linked_dates(page)}, {_at(page, MORE_DATES)})")
    more = F.transform(named, lambda raw: F.coalesce(dates.parse_date(raw), _day(raw, DAY)))
    declared = F.get(F.filter(more, lambda stamp: stamp.isNotNull()), F.lit(0))
    return F.coalesce(dates.first_date(date_candidates(page)), declared, _day(url, DAY_IN_URL))
