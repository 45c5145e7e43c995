"""Column-name rules, on a list of names and on names held in rows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions.text import normalize_whitespace


# a base and the number after it; none has more digits than a header can have columns
_NUMBERED = "^(.+)_([1-9][0-9]{0,8})$"


def snake_name(name: str) -> str:
    """Lowercase name with one underscore for every run of other characters; never empty."""
    letters = re.sub(r"[\W_]+", "_", str(name).lower())
    return letters.strip("_") or "column"


def unique_names(names: Iterable[str]) -> list[str]:
    """Sanitized names; a repeated one gets the next free suffix ``_2``, ``_3``, ..."""
    bases = [snake_name(n) for n in names]
    reserved = set(bases)
    used: set[str] = set()
    counts: dict[str, int] = {}
    out = []
    for base in bases:
        counts[base] = counts.get(base, 0) + 1
        chosen = base
        if base in used:
            chosen = f"{base}_{counts[base]}"
            while chosen in reserved or chosen in used:
                counts[base] += 1
                chosen = f"{base}_{counts[base]}"
        used.add(chosen)
        out.append(chosen)
    return out


def widen_names(names: list[str], width: int) -> list[str]:
    """Names for cells beyond the header: ``extra_1``, ``extra_2``, ..., skipping taken names."""
    out = list(names)
    number = 1
    while len(out) < width:
        name = f"extra_{number}"
        if name not in names:
            out.append(name)
        number += 1
    return out


def default_names(width: int) -> list[str]:
    return [f"column_{i}" for i in range(1, max(1, width) + 1)]


def snake_name_column(c: Column) -> Column:
    """``snake_name`` for names held in rows."""
    joined = F.regexp_replace(F.lower(normalize_whitespace(c)), r"[^\p{L}\p{N}]+", "_")
    base = F.regexp_replace(joined, "^_+|_+$", "")
    return F.when(base == "", F.lit("column")).otherwise(base)


def name_rows(df: DataFrame, dataset: str, position: str, raw: str) -> DataFrame:
    """Sanitize header names stored one per row; a repeated one gets the next free suffix.

    The rule is that of ``unique_names``, in closed form. Suffixed names of two bases never meet, so a
    base's suffixes have to miss only the header's own names of the form ``base_n``. With those
    numbers in order, the i-th leaves ``n - 2 - i`` free numbers below it; the j-th repetition comes
    after all with at most j free, which a running count in the order of free numbers tells. Sorting
    is all it takes, so a header of any width costs its own length.
    """
    rows = df.select(
        F.col(dataset).alias("set"), snake_name_column(F.col(raw)).alias("base"),
        F.col(position).alias("at"), F.struct("*").alias("row"),
    )
    earlier = F.row_number().over(Window.partitionBy("set", "base").orderBy("at", "row")) - 2
    rows = rows.select("set", "base", "row", earlier.cast("bigint").alias("free"), F.lit(1).alias("kind"))
    taken = rows.select("set", "base").distinct().select(
        "set",
        F.regexp_extract("base", _NUMBERED, 1).alias("base"),
        F.regexp_extract("base", _NUMBERED, 2).try_cast("bigint").alias("number"),
    ).where("number >= 2")
    before = F.row_number().over(Window.partitionBy("set", "base").orderBy("number")) - 1
    taken = taken.select(
        "set", "base", F.lit(None).cast(rows.schema["row"].dataType).alias("row"),
        (F.col("number") - 2 - before).cast("bigint").alias("free"), F.lit(0).alias("kind"),
    )
    so_far = Window.partitionBy("set", "base").orderBy("free", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    missed = F.sum(1 - F.col("kind")).over(so_far)
    both = rows.unionByName(taken).select("*", (F.col("free") + 2 + missed).alias("number"))
    name = F.when(F.col("free") < 0, F.col("base")).otherwise(F.concat_ws("_", "base", "number"))
    named = both.where("kind = 1").select("row", F.col("base").alias("base_name"), name.alias("name"))
    return named.select("row.*", "base_name", "name")
