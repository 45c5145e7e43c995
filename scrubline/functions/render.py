"""Text forms of typed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.binding import let

# English names used by %b, %B, %a and %A.
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def float_text(value: Column) -> Column:
    """Shortest text of a double: positional from 1e-4 up to 1e16, else ``1e+16`` style."""
    return let(value, lambda v: let(v.cast("string"), lambda plain: _float_text(v, plain)))


def _float_text(value: Column, plain: Column) -> Column:
    positional = F.regexp_replace(
        plain.try_cast("decimal(38,20)").cast("string"), r"^(.*\.[0-9]+?)0*$", "$1"
    )
    scientific = plain
    for found, put in ((".0E", "E"), ("E", "e+"), ("e+-", "e-")):
        scientific = F.replace(scientific, F.lit(found), F.lit(put))
    scientific = F.regexp_replace(scientific, "([-+])([0-9])$", "$10$2")
    size = F.abs(value)
    return (
        F.when((size >= 1e-3) & (size < 1e7) | (size == 0), plain)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(scientific)
    )


def _padded(part: Callable[[Column], Column], width: int) -> Callable[[Column], Column]:
    return lambda ts: F.lpad(part(ts).cast("string"), width, "0")


def _name(names: tuple[str, ...], part: Callable[[Column], Column], width: int | None = None):
    table = F.array(*[F.lit(n[:width]) for n in names])
    return lambda ts: F.get(table, part(ts))


def _hour12(ts: Column) -> Column:
    return F.pmod(F.hour(ts) + 11, F.lit(12)) + 1


def _micros(ts: Column) -> Column:
    return F.pmod((F.date_part(F.lit("second"), ts) * 1000000).cast("bigint"), F.lit(1000000))


def _directives() -> dict[str, Callable[[Column], Column]]:
    return {
        "Y": _padded(F.year, 4),
        "y": _padded(lambda ts: F.pmod(F.year(ts), F.lit(100)), 2),
        "m": _padded(F.month, 2),
        "d": _padded(F.dayofmonth, 2),
        "H": _padded(F.hour, 2),
        "I": _padded(_hour12, 2),
        "M": _padded(F.minute, 2),
        "S": _padded(F.second, 2),
        "f": _padded(_micros, 6),
        "j": _padded(F.dayofyear, 3),
        "p": lambda ts: F.when(F.hour(ts) < 12, F.lit("AM")).otherwise(F.lit("PM")),
        "b": _name(MONTHS, lambda ts: F.month(ts) - 1, 3),
        "B": _name(MONTHS, lambda ts: F.month(ts) - 1),
        "a": _name(WEEKDAYS, F.weekday, 3),
        "A": _name(WEEKDAYS, F.weekday),
        "%": lambda ts: F.lit("%"),
    }


def format_timestamp(ts: Column, pattern: str) -> Column:
    """Render a zone-free timestamp with a strftime pattern, field by field, so no zone applies.

    ``ts`` should be a plain column or a bound value, since it is named once per field.
    """
    if pattern == "%Y-%m-%d":
        return ts.cast("date").cast("string")
    known = _directives()
    parts: list[Column] = []
    literal = ""
    chars = iter(pattern)
    for ch in chars:
        if ch != "%":
            literal += ch
            continue
        code = next(chars, "")
        if code not in known:
            raise ValueError(f"unsupported date directive %{code} in {pattern!r}")
        if literal:
            parts.append(F.lit(literal))
            literal = ""
        parts.append(known[code](ts))
    if literal or not parts:
        parts.append(F.lit(literal))
    return F.when(ts.isNotNull(), F.concat(*parts))
