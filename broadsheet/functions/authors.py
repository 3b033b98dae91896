"""Byline rules: validity, house names, cleaning and splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import SPACE, let, strip

# A name holding one of these is no byline (found by substring, after lower-casing).
BANNED_WORDS = [
    "thứ hai", "thứ ba", "thứ tư", "thứ năm", "thứ sáu", "thứ bảy", "chủ nhật",
    "ngày", "tháng", "năm", "phút trước", "giờ trước",
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
    "ảnh:", "video:", "xem thêm", "bản quyền", "chia sẻ", "liên hệ", "hotline", "sđt", "thông tin", "fax", "telephone",
]

# Newsroom names that count as a byline only when nothing better is found.
HOUSE_NAMES = [
    "vietnamnet news", "vietnamnet", "ban biên tập",
    "giảm nghèo bền vững", "dân trí", "thời sự", "kinh tế", "bnvsba",
]

# Words that may open the long name of an organisation.
ORGANISATION_WORDS = ["theo", "nguồn", "báo", "tạp chí", "đài", "ban", "ủy ban", "sở", "bộ"]

# Fixed value: a phone number with its optional label.
PHONE = r"(?:hotline|liên hệ|sđt|đt)?\s*:?\s*(?:0|\+84)[\d\s.-]{8,12}"

# Fixed value: day/month, day-month or hour:minute.
DATE_OR_TIME = r"\d{1,2}[/-]\d{1,2}|\d{1,2}:\d{1,2}"

# A list number in front, and the bounds of a name's length, digits and words.
LIST_NUMBER = r"^\d+[.\-)]"
NAME_LENGTH = (2, 100)
MAX_DIGITS = 6
MAX_WORDS = 6


def any_of(words: list[str]) -> str:
    """Alternation of plain words; none of the fixed lists holds a pattern character."""
    return "(" + "|".join(words) + ")"


def is_valid_author(name: Column) -> Column:
    """True when ``name`` can be a byline; NULL names are not."""
    bare = strip(name)
    lowered = F.lower(name)
    many_words = F.size(F.split(bare, SPACE + "+")) > MAX_WORDS
    joined = lowered.rlike("[,&-]|và")
    organisation = bare.rlike("(?iu)^" + any_of(ORGANISATION_WORDS))
    good = (
        ~bare.rlike(LIST_NUMBER)
        & ~bare.rlike("[?!]")
        & F.length(name).between(*NAME_LENGTH)
        & (F.regexp_count(name, F.lit(r"\d")) <= MAX_DIGITS)
        & ~name.rlike(DATE_OR_TIME)
        & (~many_words | joined | organisation)
        & ~lowered.rlike(any_of(BANNED_WORDS))
    )
    return F.coalesce(good, F.lit(False))


def is_house_name(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(any_of(HOUSE_NAMES)), F.lit(False))


def demoted(byline: Column) -> Column:
    """True when a byline may serve as fallback only."""
    return F.coalesce(byline != "", F.lit(False)) & (is_house_name(byline) | ~is_valid_author(byline))


def clean_candidate(text: Column) -> Column:
    """Cut at the bullet, drop phone numbers, strip one dash at either edge."""
    head = strip(F.split_part(text, F.lit("•"), F.lit(1)))
    no_phone = F.regexp_replace(head, "(?iuU)" + PHONE, "")
    return strip(F.regexp_replace(no_phone, "^-|-$", ""))


def split_authors(raw: Column) -> Column:
    """Author names in one byline text; ``["Unknown"]`` when nothing is left."""
    no_brackets = F.regexp_replace(raw, r"\(.*?\)", "")
    first = F.get(F.split(no_brackets, rf"(?iu){SPACE}+và{SPACE}+", 2), F.lit(0))
    parts = F.transform(F.split(first, rf",|{SPACE}*-{SPACE}*"), strip)
    names = F.filter(parts, lambda part: part != "")
    return let(names, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Unknown"))))


def author_list(raw: Column) -> Column:
    """Names of one item: a JSON list is taken as it is, a text is split."""
    as_list = F.from_json(F.when(F.startswith(raw, F.lit("[")), raw), "array<string>")
    named = F.transform(as_list, lambda name: F.when(F.coalesce(name, F.lit("")) == "", F.lit("Unknown")).otherwise(name))
    return F.coalesce(named, split_authors(raw))
