"""Text, hashing and rounding expressions, all native Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space as the cleaning rules understand it (Unicode spaces and the four separators 1C-1F).
SPACE = r"(?U)[\s\x1c-\x1f]"

# Boiler-plate removed from article text, applied in this order, ignoring case.
JUNK_PATTERNS = [
    "Chia sẻ bài viết qua email",
    r"Ảnh:.*?\.",
    r"Video:.*?\.",
    r"Độc giả.*?\.",
    "Bản quyền thuộc về.*",
    "Hãy gửi câu hỏi về.*",
]

# Fixed value: the name space of DNS identifiers used for version-5 UUIDs.
UUID_DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

# Fixed value: size of the token id space.
TOKEN_SPACE = 262144


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is computed anew for every element; as a
    lambda variable it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides (``trim`` removes only U+0020)."""
    return F.regexp_replace(text, rf"{SPACE}+\z|\A{SPACE}+", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", " ")


def clean_text(text: Column) -> Column:
    """Collapse white space, drop the boiler-plate, trim. NULL becomes the empty text."""
    out = collapse_space(F.coalesce(text, F.lit("")))
    for pattern in JUNK_PATTERNS:
        out = F.regexp_replace(out, "(?iu)" + pattern, "")
    return strip(out)


def missing(text: Column) -> Column:
    """True when a required field is absent: NULL, empty or the word ``Unknown``."""
    return text.isNull() | (text == "") | (text == "Unknown")


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits, in reading order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hex_to_long(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def id_of(digest: Column) -> Column:
    """Token id from the token's md5."""
    return hex_to_long(F.substring(digest, 1, 8)) % F.lit(TOKEN_SPACE)


def sign_of(digest: Column) -> Column:
    """+1 or -1 from the parity of the ninth hex digit of the token's md5: the odd digits are known by their looks."""
    odd = F.substring(digest, 9, 1).isin(*"13579bdf")
    return F.when(odd, -1).otherwise(1)


def token_id(token: Column) -> Column:
    return id_of(F.md5(token))


def token_sign(token: Column) -> Column:
    return sign_of(F.md5(token))


def uuid5(name: Column) -> Column:
    """Version-5 UUID of ``name`` in the DNS name space, as lower-case text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(hex_to_long(F.substring(digest, 17, 1)).bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def point_id(article_id: Column, chunk_index: Column) -> Column:
    """Stable id of a chunk in the vector table."""
    return uuid5(F.concat(F.lit("article_"), article_id.cast("string"), F.lit("_chunk_"), chunk_index.cast("string")))


def half_up(part: Column, whole: Column, scale: int) -> Column:
    """``part / whole`` times ``scale``, rounded half up in whole numbers, as bigint; 0 when ``whole`` is 0."""
    part, whole = part.cast("bigint"), whole.cast("bigint")
    rounded = F.call_function("div", F.lit(2 * scale) * part + whole, F.lit(2) * whole)
    return F.when(whole > 0, rounded).otherwise(F.lit(0).cast("bigint"))


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole`` rounded half up to ``digits`` decimals, 0 when there is nothing to divide by."""
    return half_up(part, whole, 10 ** digits) / F.lit(float(10 ** digits))


def percent(part: Column, whole: Column) -> Column:
    """Share of ``whole`` in percent with one decimal."""
    return half_up(part, whole, 1000) / F.lit(10.0)
