"""Repeatable defects for test and benchmark data: blanks, copies, typos, odd numbers, shuffling.

Which cells are hit is decided by a ``picker``: from a name and a rate to a Boolean column. The
default hashes the row's key; a picker by arithmetic lets another engine build the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Picker = Callable[[str, float], Column]
_STEPS = 1_000_000


def hash_picker(key: str, seed: int = 0) -> Picker:
    def pick(name: str, rate: float) -> Column:
        mixed = F.pmod(F.xxhash64(F.col(key), F.lit(name), F.lit(seed)), F.lit(_STEPS))
        return mixed < int(rate * _STEPS)

    return pick


def blank_cells(df: DataFrame, columns: list[str], rate: float, picker: Picker) -> DataFrame:
    """NULL in each listed column at the given rate, cell by cell."""
    return df.withColumns({c: F.when(~picker(c, rate), F.col(c)) for c in columns})


def add_copies(df: DataFrame, rate: float, picker: Picker) -> DataFrame:
    """The rows, followed by copies of the picked ones."""
    return df.unionByName(df.filter(picker("copy", rate)))


def misspell(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("a")), F.replace(c, F.lit("a"), F.lit("aaa"))).otherwise(
        F.concat(c, F.lit("111"))
    )


def misspell_cells(df: DataFrame, columns: list[str], rate: float, picker: Picker) -> DataFrame:
    return df.withColumns(
        {c: F.when(picker(c, rate), misspell(F.col(c))).otherwise(F.col(c)) for c in columns}
    )


def odd_numbers(
    df: DataFrame, column: str, outlier: Column, outlier_rate: float, negative_rate: float,
    picker: Picker,
) -> DataFrame:
    """Outliers and flipped signs in a numeric column."""
    value = F.col(column)
    hit = (
        F.when(picker(column + " outlier", outlier_rate), outlier)
        .when(picker(column + " sign", negative_rate), -value)
        .otherwise(value)
    )
    return df.withColumn(column, hit)


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """A repeatable random order."""
    return df.orderBy(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))


def sample_rows(df: DataFrame, rate: float, picker: Picker) -> DataFrame:
    return df.filter(picker("sample", rate))
