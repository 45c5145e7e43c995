"""Spelling repair by dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.operators.lookup import lookup_join


def fix_spelling(
    df: DataFrame, column: str, dictionary: DataFrame, wrong: str = "wrong", right: str = "right"
) -> DataFrame:
    """Replace cells found in the dictionary; others stay as they are."""
    table = dictionary.groupBy(F.col(wrong).alias(column)).agg(F.min(right).alias("_right"))
    others = [c for c in df.columns if c != column]
    spread = F.struct(*others) if others else F.monotonically_increasing_id()
    joined = lookup_join(df, table, [column], spread)
    fixed = F.coalesce("_right", column).alias(column)
    return joined.select(*[fixed if c == column else F.col(c) for c in df.columns])


def merge_parts(*parts: str):
    """Join the non-empty parts of a name with one space."""
    stripped = [F.nullif(F.trim(F.col(p)), F.lit("")) for p in parts]
    return F.concat_ws(" ", *stripped)
