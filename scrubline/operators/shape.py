"""Uneven rows, empty rows and empty columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(fields: Column, names: list[str]) -> list[Column]:
    """One column per name from an array of cells; short rows give NULL cells."""
    return [F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(names)]


def truncated(fields: Column, names: list[str]) -> list[Column]:
    """As ``padded``, for rows cut to the header's width first."""
    return padded(F.slice(fields, F.lit(1), F.lit(len(names))), names)


def uneven_rows(df: DataFrame, cells: Column, width: Column) -> DataFrame:
    """Rows whose cell count differs from ``width``, with the reason; a count needs no parse."""
    return (
        df.withColumn("cells", cells)
        .withColumn("wanted", width)
        .filter(F.col("cells") != F.col("wanted"))
        .withColumn(
            "problem",
            F.when(F.col("cells") < F.col("wanted"), F.lit("short")).otherwise(F.lit("long")),
        )
    )


def is_empty_row(columns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]).isNull()


def filled_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with a non-empty cell in some row; one aggregate job for all of them."""
    counts = df.agg(*[F.count(F.nullif(F.col(c), F.lit(""))).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 0]
