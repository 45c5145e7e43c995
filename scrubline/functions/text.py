"""Whitespace and missing-value expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.binding import let

# Texts that mean "no value", compared after stripping and lowercasing.
NA_TOKENS = ("", "na", "n/a", "null", "none", "#n/a", "-", "?", "nan")

# Unicode whitespace plus the four ASCII separators U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f]"
# A run is rewritten only when it is more than one plain space, so clean text passes untouched.
# The look-ahead lets printable ASCII fail on one cheap test before any Unicode class is tried.
_MESSY_RUN = rf"(?U)(?=[^!-~])(?:[\s\x1c-\x1f&&[^ ]]{_SPACE}*| {_SPACE}+)"
_OUTER = rf"(?U)^{_SPACE}+|{_SPACE}+$"


def normalize_whitespace(c: Column) -> Column:
    """Turn every run of whitespace into one space and strip both ends."""
    return F.trim(F.regexp_replace(c, _MESSY_RUN, " "))


def strip_whitespace(c: Column) -> Column:
    """Strip whitespace of any kind from both ends, leaving the inside alone."""
    return F.regexp_replace(c, _OUTER, "")


def na_set(extra: Iterable[str] = ()) -> list[str]:
    return sorted({*NA_TOKENS, *(str(t).strip().lower() for t in extra if t is not None)})


def is_missing(stripped: Column, tokens: Iterable[str] = ()) -> Column:
    """Whether a stripped cell carries no value."""
    return stripped.isNull() | F.lower(stripped).isin(na_set(tokens))


def is_missing_cell(c: Column, trim: bool = True, tokens: Iterable[str] = ()) -> Column:
    """Whether a raw cell carries no value; names the cell once, so it is cheap to push down."""
    stripped = normalize_whitespace(c) if trim else strip_whitespace(c)
    return F.coalesce(F.lower(stripped).isin(na_set(tokens)), F.lit(True))


def blank_to_null(stripped: Column, tokens: Iterable[str] = ()) -> Column:
    return F.when(~is_missing(stripped, tokens), stripped)


def clean_text(c: Column, trim: bool = True, tokens: Iterable[str] = ()) -> Column:
    """Whitespace normalization, then NULL for missing cells.

    With ``trim`` off a cell is kept as it is and only the test strips.
    """
    tokens = tuple(tokens)
    if trim:
        return let(normalize_whitespace(c), lambda text: blank_to_null(text, tokens))
    return let(strip_whitespace(c), lambda text: F.when(~is_missing(text, tokens), c))


#: Columns up to which cleaning is written into the stage's generated loop. Beyond it the loop
#: would outgrow what the JVM compiles, and cells are cleaned through bound values instead.
INLINE_COLUMNS = 8


def with_clean_text(
    df: DataFrame, columns: list[str], trim: bool = True, tokens: Iterable[str] = ()
) -> DataFrame:
    """``clean_text`` of the given columns in place."""
    tokens = tuple(tokens)
    if trim and len(columns) <= INLINE_COLUMNS:
        spaced = df.withColumns({c: normalize_whitespace(F.col(c)) for c in columns})
        return spaced.withColumns({c: blank_to_null(F.col(c), tokens) for c in columns})
    return df.withColumns({c: clean_text(F.col(c), trim, tokens) for c in columns})
