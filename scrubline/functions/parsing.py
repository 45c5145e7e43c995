"""Boolean, numeric and date parsing of text cells as native expressions.

All functions take a stripped text column and give NULL when the text does not parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.binding import let

# Accepted spellings of booleans, any case.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

# ASCII digits, single underscores allowed between them.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^([+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)%?$"

# What the last character of a decorated number can be.
_LAST_OF_NUMBER = tuple("0123456789.%),")

_CLOCK = r"[0-9]{1,2}:[0-9]{1,2}:[0-5]?[0-9]"
_YEAR = r"(?!0000)[0-9]{4}"
_YEAR_FIRST = rf"^{_YEAR}([-/.])[0-9]{{1,2}}\1 ?[0-9]{{1,2}}$"
_YEAR_FIRST_CLOCK = rf"^({_YEAR})([-/])([0-9]{{1,2}})\2 ?([0-9]{{1,2}})\s+({_CLOCK})$"
_YEAR_LAST = rf"^([0-9]{{1,2}})([-/])([0-9]{{1,2}})\2({_YEAR})$"
_YEAR_LAST_CLOCK = rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/({_YEAR})\s+({_CLOCK})$"
_ISO = (
    rf"^({_YEAR})(-?)([0-9]{{2}})\2([0-9]{{2}})"
    r"(?s:.)([0-9]{2})(?:(:?)([0-9]{2})(?:\6([0-5][0-9])(?:[.,]([0-9]+))?)?)?"
    r"(?:Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:\.[0-9]+)?)?)?)?$"
)
# What every date starts with: digits and a separator, or eight digits.
_DATE_START = "^[0-9]{1,4}[-/.][0-9]|^[0-9]{8}"
_BASIC_DATE = rf"^({_YEAR})([0-9]{{2}})([0-9]{{2}})$"


def parse_boolean(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def numeric_text(text: Column) -> Column:
    """The bare number inside a decorated one: ``(1,200)`` -> ``-1200``, ``25%`` -> ``25``.

    Empty or NULL when the cell is not a number. Cells that cannot end a number are turned away by their
    last character, without a pattern match. ``text`` should be a plain column.
    """
    signed = F.when(
        text.startswith("("), F.regexp_replace(text, r"(?s)^\((.*)\)$", "-$1")
    ).otherwise(text)
    body = F.replace(F.replace(signed, F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    bare = F.replace(F.regexp_extract(body, _NUMBER, 1), F.lit("_"), F.lit(""))
    possible = F.substring(text, -1, 1).isin(*_LAST_OF_NUMBER)
    return F.when(possible, bare)


def number_of(bare: Column) -> Column:
    """Double of a bare number, possibly infinite; a negative zero becomes zero."""
    return F.when(bare != "", bare.try_cast("double") + F.lit(0.0))


def finite(number: Column) -> Column:
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def numeric_value(text: Column) -> Column:
    """The finite number in a cell as a double."""
    return let(text, lambda t: let(number_of(numeric_text(t)), finite))


def is_whole(value: Column) -> Column:
    return F.rint(value) == value


def whole_text(bare: Column, number: Column) -> Column:
    """Canonical digits of a whole number; NULL when not whole.

    ``bare`` is its ``numeric_text`` and ``number`` its double. Plain digits may be of any length;
    whole numbers in float notation reach to 38 digits, beyond that NULL.
    """
    exact = bare.try_cast("decimal(38,0)").cast("string")
    longer = F.when(
        F.length(bare) > 38, F.regexp_extract(bare, r"^\+?(-?)0*([0-9]+)$", 0)
    )
    return F.when(is_whole(number), F.coalesce(exact, _without_padding(longer)))


def _without_padding(digits: Column) -> Column:
    return F.nullif(F.regexp_replace(digits, r"^\+?(-?)0*(?=[0-9])", "$1"), F.lit(""))


def integer_text(text: Column) -> Column:
    """Canonical digits of the whole number in a cell."""

    def of_bare(bare: Column) -> Column:
        return let(number_of(bare), lambda number: whole_text(bare, number))

    return let(text, lambda t: let(numeric_text(t), of_bare))


def _stamp(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _dashed(text: Column) -> Column:
    for mark, put in (("/", "-"), (".", "-"), (" ", "")):
        text = F.replace(text, F.lit(mark), F.lit(put))
    return text


def _iso_stamp(text: Column) -> Column:
    spread = F.regexp_replace(text, _ISO, "$1-$3-$4 $5:$7:$8.$9")
    return _stamp(F.regexp_replace(F.regexp_replace(spread, ":(?=[:.])", ":00"), r"\.$", ""))


def parse_timestamp(text: Column) -> Column:
    """Date or date-time of a cell, decided cell by cell; an offset is dropped, not applied.

    Each branch is guarded by the cell's shape, so at most two casts run per cell. Ambiguous
    day and month are day-first in plain dates and month-first in date-times.

    The chain of patterns runs as a function over the cell (``let``). Inlined into the stage's
    generated loop it would push that loop past the size the JVM compiles.
    """
    return let(text, _timestamp_of)


def _timestamp_of(text: Column) -> Column:
    def turned(pattern: str, form: str) -> Column:
        return _stamp(F.regexp_replace(text, pattern, form))

    return (
        F.when((F.length(text) < 8) | ~text.rlike(_DATE_START), F.lit(None).cast("timestamp_ntz"))
        .when(text.rlike(_YEAR_FIRST), _stamp(_dashed(text)))
        .when(
            text.rlike(_YEAR_LAST),
            F.coalesce(turned(_YEAR_LAST, "$4-$3-$1"), turned(_YEAR_LAST, "$4-$1-$3")),
        )
        .when(text.rlike(_YEAR_FIRST_CLOCK), turned(_YEAR_FIRST_CLOCK, "$1-$3-$4 $5"))
        .when(
            text.rlike(_YEAR_LAST_CLOCK),
            F.coalesce(
                turned(_YEAR_LAST_CLOCK, "$3-$1-$2 $4"), turned(_YEAR_LAST_CLOCK, "$3-$2-$1 $4")
            ),
        )
        .when(text.rlike(_BASIC_DATE), turned(_BASIC_DATE, "$1-$2-$3"))
        .when(text.rlike(_ISO), _iso_stamp(text))
    )
