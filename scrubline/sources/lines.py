"""What raw text lines say about a delimited file: delimiter, width, quoting, encoding.

All of these are aggregates over lines grouped by file, combined inside each task, so a file may
be split over any number of tasks and may be of any size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delimiters looked for, in order of preference on a tie.
DELIMITERS = (",", ";", "\t", "|")
FALLBACK = ","

# Bytes without a meaning in code page 1252.
_UNDEFINED_1252 = "^(?:..)*(?:81|8D|8F|90|9D)"
# The characters of code page 1252 in the range that Latin-1 leaves to controls.
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


# what a quoted cell holds: a quote in it is written twice
INSIDE = '[^"]*+(?:""[^"]*+)*+'


def unquoted(line: Column, delimiters: tuple[str, ...] = DELIMITERS) -> Column:
    """The line without its quoted stretches, so that delimiters in quotes do not count.

    A quote opens a stretch only at the start of a cell; one within a cell is a character like others.
    """
    at_start = "|".join(rf'{re.escape(d)}"' for d in delimiters)
    stretch = rf'"(?<=\A"|{at_start}){INSIDE}(?:"|\z)'
    return F.when(line.contains('"'), F.regexp_replace(line, stretch, "")).otherwise(line)


def _cells(delimiter: str) -> tuple[str, str]:
    """Patterns of the rest of a cell with its delimiter, and of any number of whole cells."""
    mark = re.escape(delimiter)
    other = f"[^{mark}]" if len(delimiter) == 1 else rf"(?:(?!{mark})[\s\S])"
    rest = f"{other}*+{mark}"
    return rest, f'(?:(?:"{INSIDE}"|(?!")){rest})*+'


def opens(line: Column, delimiter: str) -> Column:
    """Whether a cell is open at the end of a line that begins a record."""
    _, whole = _cells(delimiter)
    return line.contains('"') & line.rlike(rf'\A{whole}"{INSIDE}\z')


def stays_open(line: Column, delimiter: str) -> Column:
    """Whether a cell is open at the end of a line that begins inside a cell."""
    rest, whole = _cells(delimiter)
    again = rf'"{rest}{whole}"{INSIDE}\z'
    return ~line.contains('"') | line.rlike(rf"\A{INSIDE}(?:\z|{again})")


def occurrences(text: Column, mark: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, mark, F.lit("")))


def field_count(line: Column, delimiter: Column) -> Column:
    """Cells in a line; a blank line has none."""
    cells = occurrences(unquoted(line), delimiter) + 1
    return F.when(is_blank_line(line), F.lit(0)).otherwise(cells)


def is_blank_line(line: Column) -> Column:
    """Whether Spark's reader passes over the line: nothing in it but characters up to a space."""
    return line.rlike(r"^[\x00-\x20]*$")


def line_shapes(
    lines: DataFrame, file: list[str], line: str, delimiters: tuple[str, ...] = DELIMITERS
) -> DataFrame:
    """Lines grouped by their delimiter counts (``n0``, ``n1``, ...), of which there are few.

    ``open0``, ... say whether a cell goes on after any of the lines. If none does, no cell has a line break.
    """
    text = F.col(line)
    bare = F.col("_bare")
    counts = {f"n{i}": occurrences(bare, F.lit(d)) for i, d in enumerate(delimiters)}
    breaks = {f"open{i}": F.some(opens(text, d)) for i, d in enumerate(delimiters)}
    return (
        lines.withColumn("_bare", unquoted(text, delimiters))
        .withColumns(counts)
        .withColumn("blank", is_blank_line(text))
        .groupBy(*file, "blank", *counts)
        .agg(
            F.count(F.lit(1)).alias("lines"),
            *[c.alias(name) for name, c in breaks.items()],
            F.every(F.is_valid_utf8(text)).alias("all_utf8"),
            F.some(undefined_in_1252(text)).alias("undefined_1252"),
        )
    )


def vote_delimiter(
    shapes: DataFrame, file: list[str], delimiters: tuple[str, ...] = DELIMITERS
) -> DataFrame:
    """One delimiter per file: the one whose most common non-zero count the most lines share.

    Works on ``line_shapes``; ties go to the earlier delimiter. The fallback is taken only where none
    of the delimiters occurs, so a ragged file keeps its columns.
    """
    each = F.array(
        *[
            F.struct(F.lit(i).alias("rank"), F.lit(d).alias("delimiter"), F.col(f"n{i}").alias("n"))
            for i, d in enumerate(delimiters)
        ]
    )
    per_count = (
        shapes.filter(~F.col("blank"))
        .select(*file, "lines", F.inline(each))
        .groupBy(*file, "rank", "delimiter", "n")
        .agg(F.sum("lines").alias("lines"))
    )
    scored = per_count.groupBy(*file, "rank", "delimiter").agg(
        F.max(F.when(F.col("n") > 0, F.col("lines"))).alias("agree"),
        F.sum("lines").alias("lines"),
    )
    share = F.coalesce(F.col("agree"), F.lit(0)) / F.col("lines")
    best = F.max(F.struct(share.alias("share"), (-F.col("rank")).alias("r"), "delimiter", "lines"))
    winner = scored.groupBy(*file).agg(best.alias("best")).select(*file, "best.*").drop("r")
    occurs = F.col("share") > 0
    return winner.withColumn(
        "delimiter", F.when(occurs, F.col("delimiter")).otherwise(F.lit(FALLBACK))
    )


def encoding_of(all_utf8: Column, any_undefined: Column) -> Column:
    return (
        F.when(all_utf8, F.lit("utf-8"))
        .when(~any_undefined, F.lit("cp1252"))
        .otherwise(F.lit("latin-1"))
    )


def undefined_in_1252(line: Column) -> Column:
    """Whether a line that is not UTF-8 has a byte that code page 1252 does not define."""
    return ~F.is_valid_utf8(line) & F.hex(line.cast("binary")).rlike(_UNDEFINED_1252)


def latin1_to_cp1252(c: Column) -> Column:
    """Give text read as Latin-1 the characters code page 1252 has for the same bytes."""
    return F.translate(c, _CONTROLS, _CP1252)


def own_count(delimiter: Column, delimiters: tuple[str, ...] = DELIMITERS) -> Column:
    """Of ``line_shapes``: cells by the file's own delimiter."""
    own = F.lit(None).cast("int")
    for i, d in enumerate(delimiters):
        own = F.when(delimiter == d, F.col(f"n{i}") + 1).otherwise(own)
    return own


def widest(shapes: DataFrame, votes: DataFrame, file: list[str]) -> int:
    """The most cells that a line of any file has; one number."""
    cells = shapes.join(votes.select(*file, "delimiter"), file).agg(
        F.max(F.when(~F.col("blank"), own_count(F.col("delimiter"))))
    )
    return cells.first()[0] or 1


def parse_lines(
    df: DataFrame, line: str, delimiter: Column, width: int, into: str = "fields"
) -> DataFrame:
    """Cells of each line as an array, as many as the line has, by Spark's own CSV parser.

    ``width`` is the most cells any line has (see ``widest``). The parsed record goes through a
    generator: a filter over the cells then stays above it, and each line is parsed once.
    """
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = None
    for d in DELIMITERS:
        options = {"sep": d, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
        one = F.from_csv(F.col(line), schema, options)
        parsed = F.when(delimiter == d, one) if parsed is None else parsed.when(delimiter == d, one)
    cells = F.array(*[F.col("_parsed")[f"c{i}"] for i in range(width)])
    held = df.withColumn("_size", field_count(F.col(line), delimiter)).select(
        "*", F.explode(F.array(parsed)).alias("_parsed")
    )
    return held.withColumn(into, F.slice(cells, F.lit(1), F.col("_size"))).drop("_parsed", "_size")
