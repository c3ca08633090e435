"""Column helpers for landed values: numbers, prices, times, JSON lists, CSV text.

Everything here is a composition of built-in functions, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number text (underscores only between digits), zone suffix of an
# instant, the leading characters a spreadsheet would run as a formula.
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER_TEXT = rf"^\s*([+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)\s*$"
INSTANT_TEXT = (
    r"^(\d{4})-?(\d{2})-?(\d{2}).(\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d{1,6})\d*)?"
    r"(Z|[+-]\d{2}(?::?\d{2})?)$"
)
FORMULA_LEAD = r"^[=+\-@\t\r]"
MONEY = "decimal(28,18)"


def number(text: Column) -> Column:
    """Landed text to double; null for blanks, words, hex, NaN and overflow.

    The text is referred to once only, so that uses of this inside other expressions do not
    multiply the parse.
    """
    parsed = F.replace(F.regexp_extract(text.cast("string"), NUMBER_TEXT, 1), F.lit("_"), F.lit("")).try_cast("double")
    infinite = float("inf")
    return F.get(F.array_remove(F.array_remove(F.array(parsed), infinite), -infinite), 0)


def finite(value: Column) -> Column:
    """A double column that is neither NaN nor infinite, else null."""
    value = value.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def valid_probability(value: Column) -> Column:
    """Keep a double column inside [0, 1]."""
    value = value.cast("double")
    return F.when((value >= 0.0) & (value <= 1.0), value)


def probability(text: Column) -> Column:
    """Landed text to a double inside [0, 1], else null."""
    return valid_probability(number(text))


def exact(value: Column) -> Column:
    """Double or text to decimal; a double goes through its shortest decimal form."""
    return value.try_cast(MONEY)


def cents(value: Column) -> Column:
    """Integer-cent price to dollars, divided in decimal."""
    return (exact(value) * F.lit("0.01").cast("decimal(3,2)")).cast("double")


def midpoint(bid: Column, ask: Column) -> Column:
    return ((exact(bid) + exact(ask)) * F.lit("0.5").cast("decimal(2,1)")).cast("double")


def first_present(*columns: Column) -> Column:
    """First non-null; zero, false and empty text count as present."""
    return F.coalesce(*columns)


def truthy(text: Column) -> Column:
    """Non-empty text, else null."""
    return F.nullif(text, F.lit(""))


def json_list(text: Column) -> Column:
    """JSON array text to ``array<string>``; anything else is an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_objects(text: Column) -> Column:
    """The object elements of a JSON array, as JSON text."""
    return F.filter(json_list(text), lambda item: item.startswith("{"))


def sorted_set(*flags: Column) -> Column:
    """Sorted distinct array of the flags that are not null."""
    return F.sort_array(F.array_except(F.array(*flags), F.array(F.lit(None).cast("string"))))


def book_flags(bid: Column, ask: Column) -> tuple[Column, Column]:
    """(spread, flag): a spread only for an uncrossed two-sided book, else the reason."""
    flag = (
        F.when(bid.isNull() & ask.isNull(), F.lit("missing_orderbook"))
        .when(bid.isNull() | ask.isNull(), F.lit("one_sided_orderbook"))
        .when(bid > ask, F.lit("crossed_orderbook"))
    )
    spread = F.when(bid <= ask, (exact(ask) - exact(bid)).cast("double"))
    return spread, flag


def instant(text: Column) -> Column:
    """ISO text with an explicit zone to TIMESTAMP; zone-less or bad text is null."""
    text = text.cast("string")
    part = lambda i: F.regexp_extract(text, INSTANT_TEXT, i)
    two = lambda i: F.when(part(i) == "", F.lit("00")).otherwise(part(i))
    zone = F.regexp_replace(F.regexp_replace(part(8), r"^([+-]\d{2})(\d{2})$", "$1:$2"), r"^([+-]\d{2})$", "$1:00")
    canonical = F.concat(
        part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), two(5), F.lit(":"), two(6),
        F.lit("."), F.rpad(part(7), 6, "0"), zone,
    )
    common = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(common), F.try_to_timestamp(text)).when(
        text.rlike(INSTANT_TEXT), F.try_to_timestamp(canonical)
    )


def to_epoch(text: Column) -> Column:
    """Epoch seconds from digits, a number or zoned ISO text; null where none applies."""
    text = text.cast("string")
    return (
        F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))
        .when(text.rlike(NUMBER_TEXT), number(text).try_cast("bigint"))
        .otherwise(F.unix_seconds(instant(text)))
    )


def strict_epoch(text: Column) -> Column:
    """As :func:`to_epoch`, but text that is present and not an instant stops the job."""
    value = to_epoch(text)
    refuse = F.raise_error(F.concat(F.lit("Timestamps must include a timezone: "), text.cast("string"))).cast("bigint")
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(refuse)


def canonical_json(text: Column) -> Column:
    """A JSON object with its top-level keys sorted, or the text itself for anything else.

    Values pass through VARIANT, which already keeps nested object keys sorted.
    """
    entries = F.from_json(text, "map<string,variant>")
    ordered = F.map_from_entries(F.array_sort(F.map_entries(entries), _by_key))
    return F.coalesce(F.to_json(ordered), F.to_json(F.try_parse_json(text)), text)


def _by_key(left: Column, right: Column) -> Column:
    return F.when(left["key"] < right["key"], -1).when(left["key"] > right["key"], 1).otherwise(0)


def fingerprint(text: Column) -> Column:
    """SHA-256 of key-sorted JSON, an equality key for records without an id."""
    return F.sha2(canonical_json(text), 256)


def csv_safe_column(text: Column) -> Column:
    """Prefix formula-leading text with an apostrophe."""
    return F.when(text.rlike(FORMULA_LEAD), F.concat(F.lit("'"), text)).otherwise(text)
