"""Duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_duplicate_rows(df: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Whole-row duplicates; ``ignore`` columns are carried from the smallest copy.

    A plain grouping: copies are combined inside each task, so a row with very many copies
    sends one row per task. Without ignored columns the copies are identical and none is "first".
    """
    if not ignore:
        return df.dropDuplicates()
    keys = [c for c in df.columns if c not in ignore]
    if len(ignore) == 1:
        # a single number keeps this a hash aggregate; a struct would sort every row
        return df.groupBy(*keys).agg(F.min(ignore[0]).alias(ignore[0])).select(*df.columns)
    first = F.min(F.struct(*ignore)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """First row per key in ``order``.

    The rank filter is pushed below the shuffle as a group limit, so each task sends at most one
    row per key and a hot key cannot fill a partition.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
