"""Publication dates: formats, parsing, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import collapse_space, let, strip

# The four accepted forms, tried in this order, with the group numbers of
# year, month, day, hour and minute (0 = absent).
DATE_FORMS = [
    (r"(\d{4})-(\d{1,2})-(\d{1,2})(?:T|\s+)(\d{1,2}):(\d{1,2})", (1, 2, 3, 4, 5)),
    (r"(\d{1,2})[/-](\d{1,2})[/-](\d{4}).*?(\d{1,2}):(\d{1,2})", (3, 2, 1, 4, 5)),
    (r"(\d{1,2}):(\d{1,2}).*?(\d{1,2})[/-](\d{1,2})[/-](\d{4})", (5, 4, 3, 1, 2)),
    (r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", (3, 2, 1, 0, 0)),
]

# Fixed value: the one form the warehouse load accepts.
DATE_KEY_FORM = r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):([0-5]?\d)$"

# Fixed value: how dates travel as text.
DATE_TEXT = "yyyy-MM-dd HH:mm:ss"


def parse_date(raw: Column) -> Column:
    """Timestamp in the first form that matches; NULL if none does or the date is impossible.

    A zone offset, seconds or AM/PM after the minute are ignored.
    """

    def stamp(text: Column, groups: tuple[int, ...], pattern: str) -> Column:
        year, month, day, hour, minute = (
            F.regexp_extract(text, pattern, g).try_cast("int") if g else F.lit(0) for g in groups
        )
        return F.try_make_timestamp(year, month, day, hour, minute, F.lit(0).cast("decimal(16,6)"))

    def by_form(text: Column) -> Column:
        return F.coalesce(*[
            F.when(text.rlike(pattern), F.struct(stamp(text, groups, pattern).alias("stamp")))
            for pattern, groups in DATE_FORMS
        ])["stamp"]

    return let(strip(collapse_space(raw)), by_form)


def first_date(candidates: Column) -> Column:
    """First of an array of texts that gives a real date."""
    stamps = F.transform(candidates, parse_date)
    return F.get(F.filter(stamps, lambda stamp: stamp.isNotNull()), F.lit(0))


def render_date(stamp: Column) -> Column:
    return F.coalesce(F.date_format(stamp, DATE_TEXT), F.lit("Unknown"))


def date_key(text: Column) -> Column:
    """Calendar date of a ``year-month-day hour:minute:second`` text; NULL when it is not one."""
    part = [F.regexp_extract(text, DATE_KEY_FORM, g).try_cast("int") for g in range(1, 7)]
    return F.try_make_timestamp(*part[:5], part[5].cast("decimal(16,6)")).cast("date")


def publish_seconds(date_text: Column) -> Column:
    """Unix seconds of the text's day at midnight UTC; 0 when unknown or malformed."""
    day = F.try_to_timestamp(F.left(date_text, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.unix_date(day).cast("bigint") * 86400, F.lit(0).cast("bigint"))
