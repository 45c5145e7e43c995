"""Cells of a decided type, as text or as typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.binding import let
from scrubline.functions.parsing import integer_text, numeric_value, parse_boolean, parse_timestamp
from scrubline.functions.render import float_text, format_timestamp
from scrubline.functions.text import strip_whitespace


def canonical_text(text: Column, kind: str, date_format: str) -> Column:
    """Canonical text of a stripped cell of one type; NULL when the cell does not conform."""
    if kind == "integer":
        return integer_text(text)
    if kind == "float":
        return float_text(numeric_value(text))
    if kind == "boolean":
        return parse_boolean(text).cast("string")
    if kind == "date":
        return let(parse_timestamp(text), lambda ts: format_timestamp(ts, date_format))
    return text


KINDS = ("integer", "float", "boolean", "date")


def converted_text(
    cell: Column,
    kind: str | Column,
    date_format: str,
    stripped: bool,
    kinds: tuple[str, ...] = KINDS,
) -> Column:
    """Canonical text, or the cell as it is where it does not conform.

    The type may itself be a column, for many datasets in one frame; each row then runs only the
    conversion of its own type, of which ``kinds`` are possible.
    """
    text = cell if stripped else strip_whitespace(cell)
    if isinstance(kind, str):
        if kind == "string":
            return cell
        return F.coalesce(canonical_text(text, kind, date_format), cell)
    chosen = F.when(kind == "string", cell)
    for name in kinds:
        chosen = chosen.when(kind == name, canonical_text(text, name, date_format))
    return F.coalesce(chosen, cell)


def typed_value(cell: Column, sql_type: str, stripped: bool) -> Column:
    """Value of a cell in a Spark type; NULL when the cell does not conform."""
    text = cell if stripped else strip_whitespace(cell)
    if sql_type in ("bigint", "decimal(38,0)"):
        return integer_text(text).try_cast(sql_type)
    if sql_type == "double":
        return numeric_value(text)
    if sql_type == "boolean":
        return parse_boolean(text)
    if sql_type == "timestamp_ntz":
        return parse_timestamp(text)
    return cell
