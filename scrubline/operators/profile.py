"""Column profile, type decision, fill values and key candidates.

A profile works on cells, one row per cell, made by an in-task unpivot. The parse expressions
then appear once in the plan, whatever the table's width, and the counters are combined inside
each task before anything is shuffled: what crosses the network is one row per task and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.parsing import (
    finite,
    is_whole,
    number_of,
    numeric_text,
    parse_boolean,
    parse_timestamp,
)
from scrubline.functions.render import float_text
from scrubline.functions.text import with_clean_text
from scrubline.operators.selection import values_of_rank
from scrubline.options import CleanOptions

COLUMN, POSITION, RAW, TEXT = "column_name", "position", "raw_value", "cell"


def cells(
    df: DataFrame,
    columns: list[str],
    keep: list[str] = (),
    tokens: tuple[str, ...] = (),
    cleaned: bool = False,
) -> DataFrame:
    """One row per cell: kept columns, column name and normalized text, NULL when missing.

    ``cleaned`` says that the columns hold normalized text already.
    """
    pairs = [F.struct(F.lit(c).alias(COLUMN), F.col(c).alias(TEXT)) for c in columns]
    long = df.select(*keep, F.inline(F.array(*pairs)))
    return long if cleaned else with_clean_text(long, [TEXT], True, tokens)


def profile_cells(long: DataFrame, by: list[str] = (), dates: bool = True) -> DataFrame:
    """Counters per column: non-missing, numeric, whole, fractional, boolean, date; plus range."""
    text = F.col(TEXT)
    parsed = (
        long.select(
            *by,
            COLUMN,
            TEXT,
            numeric_text(text).alias("bare"),
            parse_boolean(text).isNotNull().alias("is_bool"),
            (parse_timestamp(text).isNotNull() if dates else F.lit(False)).alias("is_date"),
        )
        .withColumn("number", number_of(F.col("bare")))
        .withColumn("num", finite(F.col("number")))
    )
    num, whole = F.col("num"), is_whole(F.col("num"))
    return parsed.groupBy(*by, COLUMN).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(TEXT).alias("nonmissing"),
        F.count(num).alias("numeric"),
        F.count_if(whole).alias("whole"),
        F.count_if(~whole).alias("fractional"),
        F.count_if("is_bool").alias("boolean"),
        F.count_if("is_date").alias("dates"),
        F.avg(num).alias("mean"),
        F.min(num).alias("low"),
        F.max(num).alias("high"),
    )


def column_profile(
    df: DataFrame,
    columns: list[str],
    by: list[str] = (),
    dates: bool = True,
    tokens: tuple[str, ...] = (),
    cleaned: bool = False,
) -> DataFrame:
    return profile_cells(cells(df, columns, by, tokens, cleaned), by, dates)


def merge_profiles(profiles: DataFrame, by: list[str] = ()) -> DataFrame:
    """Profiles of parts of a dataset, one below the other, as the profile of the whole.

    Every counter is a sum, a least or a greatest value; the mean is weighed by its count, so it may
    differ from that of one pass in the last digit. Merging is associative: merged profiles merge on.
    """
    counters = ("total", "nonmissing", "numeric", "whole", "fractional", "boolean", "dates")
    weighed = F.sum(F.col("mean") * F.col("numeric")) / F.nullif(F.sum("numeric"), F.lit(0))
    return profiles.groupBy(*by, COLUMN).agg(
        *[F.sum(c).alias(c) for c in counters],
        weighed.alias("mean"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    ).select(*profiles.columns)


def decided_type(options: CleanOptions) -> Column:
    """Type of a profiled column: numeric first, then boolean, then date, else string."""
    share = lambda name: F.col(name) / F.col("nonmissing")
    enough = F.lit(options.type_threshold)
    decided = F.when(F.col("nonmissing") == 0, F.lit("string"))
    if options.infer_types:
        decided = decided.when(
            share("numeric") >= enough,
            F.when(F.col("fractional") > 0, F.lit("float")).otherwise(F.lit("integer")),
        ).when(share("boolean") >= enough, F.lit("boolean"))
    if options.parse_dates:
        decided = decided.when(share("dates") >= enough, F.lit("date"))
    return decided.otherwise(F.lit("string"))


def infer_types(profile: DataFrame, options: CleanOptions) -> DataFrame:
    return profile.withColumn("type", decided_type(options))


def _number_fill(value: Column, kind: Column) -> Column:
    whole = (kind == "integer") & (F.rint(value) == value) & (F.abs(value) < 9e15)
    return F.when(whole, value.try_cast("bigint").cast("string")).otherwise(float_text(value))


def with_fills(
    df: DataFrame,
    profile: DataFrame,
    columns: list[str],
    options: CleanOptions,
    by: list[str] = (),
    order: list[str] = (),
) -> DataFrame:
    """Add ``fill``, the text put into missing cells, to a typed profile; NULL means no fill.

    ``df`` is a prepared frame: with trimming on its cells are normalized already.
    """
    how = options.fill_missing
    number = F.col("type").isin("integer", "float")
    if how in ("none", "empty"):
        return profile.withColumn("fill", F.lit(None).cast("string"))
    if how == "constant":
        return profile.withColumn("fill", F.lit(options.fill_constant))
    if how == "zero":
        return profile.withColumn("fill", F.when(number, F.lit("0")))
    if how == "mean":
        return profile.withColumn(
            "fill", F.when(number, _number_fill(F.col("mean"), F.col("type")))
        )
    keys = [*by, COLUMN]
    # Missing cells are left in and never counted: a filter would be pushed below the cleaning
    # and run it twice.
    long = cells(df, columns, [*by, *order], options.na_tokens, cleaned=options.trim)
    if how == "mode":
        found = first_modes(long, keys, TEXT, order).withColumnRenamed("mode", "fill")
        return profile.join(found, keys, "left")
    # step by step, as in the profile
    values = long.select(*keys, numeric_text(F.col(TEXT)).alias("bare"))
    values = values.withColumn("num", number_of(F.col("bare"))).withColumn("num", finite(F.col("num")))
    found = exact_medians(values, keys, "num")
    return profile.join(found, keys, "left").withColumn(
        "fill", F.when(number, _number_fill(F.col("median"), F.col("type")))
    ).drop("median")


def first_modes(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Most frequent value per key; on a tie the one seen first in ``order``.

    Counting shuffles on (key, value) after combining in each task, so a hot key or value is
    one row per task. The second step ranks the distinct values only. A single numeric order
    column keeps the count a hash aggregate; several columns make it sort.
    """
    first = F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))
    counted = df.groupBy(*keys, value).agg(
        F.count(value).alias("_n"), first.alias("_first")
    )
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first"), F.col(value).alias("v")))
    return counted.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.col("_best.v").alias("mode")
    )


def exact_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median per key: the mean of the middle two, found by radix selection."""
    middle = values_of_rank(
        df, keys, value,
        lambda n: F.array(F.floor((n + 1) / 2).cast("bigint"), (F.floor(n / 2) + 1).cast("bigint")),
    )
    low, high = (F.max(F.when(F.col("which") == k, F.col("value"))) for k in (0, 1))
    return middle.groupBy(*keys).agg(
        F.when(low == high, low).otherwise((low + high) / 2).alias("median")
    )


#: relative error of the sketches of distinct values, and how many such errors a column is given
SKETCH_ERROR, BAND = 0.01, 6


def _as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [
        F.struct(
            F.lit(c).alias(COLUMN),
            F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(RAW),
        )
        for c in columns
    ]
    return df.select(F.inline(F.array(*pairs)))


def _sketched(long: DataFrame) -> DataFrame:
    return long.groupBy(COLUMN).agg(
        F.approx_count_distinct(RAW, SKETCH_ERROR).alias("distinct_values"),
        F.count(F.lit(1)).alias("total"),
    )


def possible_keys(df: DataFrame, columns: list[str], ratio: float, top: int) -> list[str]:
    """Columns that may be among the ``top`` key candidates, by sketches of their distinct values.

    A sketch's estimate is trusted within ``BAND`` standard errors. A column is ruled out where even
    the upper end is not above ``ratio``, or where ``top`` others are above it with their lower ends.
    One row per column comes to the driver.
    """
    spread = SKETCH_ERROR * BAND
    found = {r[COLUMN]: r for r in _sketched(_as_text(df, columns)).collect()}
    share = {c: r["distinct_values"] / r["total"] for c, r in found.items()}
    least = sorted((s / (1 + spread) for s in share.values()), reverse=True)
    bar = least[top - 1] if len(least) >= top else 0.0
    upper = {c: min(s / (1 - spread), 1.0) for c, s in share.items()}
    return [c for c in columns if c in upper and upper[c] > ratio and upper[c] >= bar]


def key_candidates(
    df: DataFrame,
    columns: list[str] | None = None,
    ratio: float = 0.9,
    top: int = 3,
    approximate: bool = False,
) -> DataFrame:
    """Columns whose distinct share exceeds ``ratio``, best first, ties in column order.

    Sketches, which shuffle one row per task and column, rule out the columns that cannot qualify. The
    distinct values of the others are counted by a shuffle on (column, value), combined in each task
    first. ``approximate`` takes the sketches' word and counts nothing.
    """
    columns = list(columns or df.columns)
    if approximate:
        counted = _sketched(_as_text(df, columns))
    else:
        chosen = possible_keys(df, columns, ratio, top)
        long = _as_text(df, chosen or columns[:1])
        if not chosen:
            long = long.limit(0)
        counted = (
            long.groupBy(COLUMN, RAW)
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy(COLUMN)
            .agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("total"))
        )
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(COLUMN)) - 1
    scored = counted.select(
        place.cast("int").alias(POSITION),
        COLUMN,
        "distinct_values",
        "total",
        (F.col("distinct_values") / F.col("total")).alias("ratio"),
    )
    return scored.filter(F.col("ratio") > ratio).orderBy(F.desc("ratio"), POSITION).limit(top)
