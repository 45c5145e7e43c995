"""Values of given rank by radix selection, without sorting or gathering a group.

A number's bits, read as a whole number, have its order. Each round counts the next sixteen bits of
the numbers that are still in question, one row per key and digit after combining in each task, and
the counts say in which digit the wanted rank lies. Four rounds settle 64 bits, whatever the number
of values and however they are spread or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.operators.lookup import lookup_join
from scrubline.session import cut_lineage, write_table

DIGIT_BITS = 16
SHIFTS = (48, 32, 16, 0)
_BIAS, _FRACTION = 1022, 52  # fixed values of the IEEE 754 double


def ordered_bits(number: Column) -> Column:
    """A whole number with the order of a double; both zeros give 0, infinities the ends.

    The exponent comes from a logarithm that may be off by one, which the scaled size shows; scaling
    by powers of two is exact, so equal bits mean equal numbers.
    """
    rough = _rough_power(number)
    return _bits_of(number, rough, _scaled(number, rough))


def _rough_power(number: Column) -> Column:
    power = F.greatest(F.least(F.floor(F.log2(F.abs(number))), F.lit(1023)), F.lit(-_BIAS))
    return F.when(number == 0, F.lit(-_BIAS)).otherwise(power).cast("int")


def _scaled(number: Column, rough: Column) -> Column:
    """The size over the rough power of two: from 0.5 up to 4, below that only for the tiniest."""
    size = F.abs(number)
    return F.when(size == float("inf"), F.lit(2.0)).otherwise(size / F.pow(F.lit(2.0), rough))


def _bits_of(number: Column, rough: Column, scaled: Column) -> Column:
    power = rough.cast("bigint") + _BIAS
    low, high = (scaled < 1) & (rough > -_BIAS), scaled >= 2
    shift = F.when(high, F.lit(1)).when(low, F.lit(-1)).otherwise(F.lit(0))
    unit = F.when(high, F.lit(0.5)).when(low, F.lit(2.0)).otherwise(F.lit(1.0)) * F.lit(2.0**_FRACTION)
    bits = (power + shift) * F.lit(1 << _FRACTION) + (scaled * unit).cast("bigint")
    return bits * F.when(number < 0, F.lit(-1)).otherwise(F.lit(1))


def _with_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """``ordered_bits`` as a column, one step of it after the other.

    Written out in one expression, each step would be repeated wherever it is used, and the stage's
    generated loop would outgrow what the JVM compiles.
    """
    number = F.when(~F.isnan(value), F.col(value))
    stepped = df.withColumn("_rough", _rough_power(number))
    stepped = stepped.withColumn("_scaled", _scaled(number, F.col("_rough")))
    return stepped.withColumn(name, _bits_of(number, F.col("_rough"), F.col("_scaled"))).drop("_rough", "_scaled")


def values_of_rank(df: DataFrame, keys: list[str], value: str, ranks) -> DataFrame:
    """``(*keys, which, value)``: for each key the values of the ranks that ``ranks(n)`` lists.

    ``ranks`` gives an array of ranks, from 1, for a count of values. Missing values and NaN do not
    count; a key without any other has no row.
    """
    numbers = df.select(*keys, F.col(value).cast("double").alias("_value"))
    # nothing is left out before the values are written: a filter would be pushed below what makes
    # them and run it twice
    rows = write_table(_with_bits(numbers, "_value", "_bits"), "ranked")
    rows = rows.where("_bits is not null")
    targets = None
    for shift in SHIFTS:
        by = list(keys)
        if targets is not None:
            by += ["_prefix"]
            told = F.shiftright("_bits", shift + DIGIT_BITS)
            # one row for each key; what lies under no wanted prefix goes here
            each = targets.groupBy(*keys).agg(F.collect_set("_prefix").alias("_prefixes"))
            near = lookup_join(rows, each, keys, F.col("_bits")).where(F.array_contains("_prefixes", told))
            rows = near.select(*keys, "_value", "_bits")
            if shift == SHIFTS[1]:  # the later rounds read what the first one left, not all values
                rows = write_table(rows, "near")
        prefixed = rows if targets is None else rows.withColumn("_prefix", told)
        counted = prefixed.groupBy(*by, F.shiftright("_bits", shift).alias("_digit")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_least")
        )
        # at most 65,536 digits for a key and prefix
        digits = F.array_sort(F.collect_list(F.struct("_digit", "_n", "_least"))).alias("_digits")
        gathered = counted.groupBy(*by).agg(digits)
        if targets is None:
            n = F.aggregate("_digits", F.lit(0).cast("bigint"), lambda s, d: s + d["_n"])
            gathered = gathered.withColumn("_n", n).select(
                *keys, "_digits", F.posexplode(ranks(F.col("_n"))).alias("_which", "_left")
            )
        else:
            gathered = targets.select(*by, "_which", "_left").join(gathered, by)
        found = gathered.select(*keys, "_which", _digit_of(F.col("_digits"), F.col("_left")).alias("_d"))
        targets = cut_lineage(
            found.select(
                *keys, "_which", F.col("_d.digit").alias("_prefix"), F.col("_d.rest").alias("_left"),
                F.col("_d.least").alias("_least"),
            )
        )
    return targets.select(*keys, F.col("_which").alias("which"), F.col("_least").alias("value"))


def _digit_of(digits: Column, rank: Column) -> Column:
    """The digit that holds the rank, the rank inside it, and its least value."""
    empty = F.struct(
        F.lit(None).cast("bigint").alias("digit"), rank.cast("bigint").alias("rest"),
        F.lit(None).cast("double").alias("least"),
    )

    def step(sofar, d):
        here = F.struct(d["_digit"].alias("digit"), sofar["rest"].alias("rest"), d["_least"].alias("least"))
        on = F.struct(
            F.lit(None).cast("bigint").alias("digit"), (sofar["rest"] - d["_n"]).alias("rest"),
            F.lit(None).cast("double").alias("least"),
        )
        return F.when(sofar["digit"].isNotNull(), sofar).when(sofar["rest"] <= d["_n"], here).otherwise(on)

    return F.aggregate(digits, empty, step)
