"""Business summaries: totals, pivots, top-k and series.

A join side that was measured to be small is broadcast. Otherwise joins come after pre-aggregation on
the join key: the fact table shuffles one partial row per key and task and a hot key is combined away.
Money is summed as exact decimals, so results do not depend on the order of addition.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.operators.lookup import fits_broadcast

OTHER = "other"


def money(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def exact_profit() -> Column:
    """Price after discount as an exact decimal."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return price * (F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)"))


def basic_stats(df: DataFrame, column: str) -> DataFrame:
    """Sum, average, minimum, maximum and count of a numeric column."""
    return df.agg(
        F.sum(column).alias("sum_value"),
        F.avg(column).alias("avg_value"),
        F.min(column).alias("min_value"),
        F.max(column).alias("max_value"),
        F.count(column).alias("count_value"),
    )


def total_by_group(df: DataFrame, group: str, amount: str, name: str = "total") -> DataFrame:
    """Totals per group, largest first."""
    return df.groupBy(group).agg(F.sum(amount).alias(name)).orderBy(F.desc(name), group)


def two_way(df: DataFrame, row: str, column: str, values: list[str], cell: Column) -> DataFrame:
    """Pivot with listed column values, so that no extra job looks for them; empty cells are 0.

    Whatever is not listed, NULL included, is counted in a column ``other``, so totals stay whole.
    """
    listed = F.when(F.col(column).isin(values), F.col(column)).otherwise(F.lit(OTHER))
    shown = df.withColumn("_listed", listed)
    return shown.groupBy(row).pivot("_listed", [*values, OTHER]).agg(cell).fillna(0)


def iso_day(ts: str) -> Column:
    return F.col(ts).cast("date").cast("string")


def iso_month(ts: str) -> Column:
    return F.substring(iso_day(ts), 1, 7)


def sums_by_model(
    lineitem: DataFrame, part: DataFrame, amount: Column, groups: dict[str, Column] | None = None
) -> DataFrame:
    """Sums of an amount per model and further groups, as column ``amount``.

    Where the part keys were measured to be small they are broadcast and one aggregation is left.
    Otherwise sales are first combined per part, so that a hot part is combined away before the
    join and the join reuses the aggregation's partitioning.
    """
    groups = groups or {}
    models = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model"))
    named = [c.alias(n) for n, c in groups.items()]
    sales = lineitem.select("l_partkey", *named, amount.alias("amount"))
    if fits_broadcast(models):
        joined = sales.join(F.broadcast(models), "l_partkey")
    else:
        per_part = sales.groupBy("l_partkey", *groups).agg(F.sum("amount").alias("amount"))
        joined = per_part.join(models, "l_partkey")
    return joined.groupBy(*groups, "model").agg(F.sum("amount").alias("amount"))


def quantity_by_dealer(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(F.col("l_suppkey").alias("dealer_id")).agg(
        F.sum("l_quantity").alias("quantity_sold")
    )


def quantity_by_model(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    sums = sums_by_model(lineitem, part, F.col("l_quantity"))
    return sums.withColumnRenamed("amount", "quantity_sold")


def profit_by_dealer(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(F.col("l_suppkey").alias("dealer_id")).agg(
        money(F.sum(exact_profit())).alias("profit")
    )


def profit_by_date_model(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    sums = sums_by_model(lineitem, part, exact_profit(), {"sale_date": iso_day("l_shipdate")})
    return sums.select("sale_date", "model", money(F.col("amount")).alias("profit"))


def profit_by_year_dealer(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(
        F.year("l_shipdate").alias("sale_year"), F.col("l_suppkey").alias("dealer_id")
    ).agg(money(F.sum(exact_profit())).alias("profit"))


def profit_one_model_by_dealer(lineitem: DataFrame, part: DataFrame, model: str) -> DataFrame:
    """Profit of one model per dealer; the model filter reaches the part scan.

    A small set of part keys is broadcast and filters the sales at the scan. A large one is met by
    sales combined per part and dealer, so that a hot part cannot fill a partition.
    """
    chosen = part.filter(F.col("p_brand") == model).select(F.col("p_partkey").alias("l_partkey"))
    sales = lineitem.select("l_partkey", "l_suppkey", exact_profit().alias("profit"))
    if fits_broadcast(chosen):
        sales = sales.join(F.broadcast(chosen), "l_partkey", "left_semi")
    else:
        combined = sales.groupBy("l_partkey", "l_suppkey").agg(F.sum("profit").alias("profit"))
        sales = combined.join(chosen, "l_partkey", "left_semi")
    return sales.groupBy(F.col("l_suppkey").alias("dealer_id")).agg(
        money(F.sum("profit")).alias("profit")
    )


def sales_kpis(lineitem: DataFrame) -> DataFrame:
    return lineitem.agg(
        money(F.sum(exact_profit())).alias("profit"),
        F.sum("l_quantity").alias("quantity_sold"),
        F.avg("l_quantity").alias("avg_quantity"),
    )


def monthly_sales_profit(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(iso_month("l_shipdate").alias("sale_month")).agg(
        money(F.sum(F.col("l_extendedprice").cast("decimal(12,2)"))).alias("sales"),
        money(F.sum(exact_profit())).alias("profit"),
    )


def count_per(df: DataFrame, *groups: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


def daily_series(
    df: DataFrame, ts: str, key: str, price: str, revenue: Column
) -> DataFrame:
    """Last price of each day and the day's revenue.

    Time and key are packed into one decimal, so that "last" is a hash aggregate without a sort.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)")
    place = micros * F.lit(Decimal(10**19)) + F.col(key)
    last = F.max_by(price, place)
    return df.groupBy(iso_day(ts).alias("day")).agg(
        last.alias("close"), money(F.sum(revenue.cast("decimal(18,2)"))).alias("revenue")
    )


def top_by_amount(rows: DataFrame, name: Column, amount: Column, top: int) -> DataFrame:
    """The ``top`` largest rows of extracted table cells: commas dropped, thousandths, 2 places.

    Rounding goes to the even neighbour after scaling, as array libraries do.
    """
    whole = F.replace(amount, F.lit(","), F.lit("")).try_cast("bigint")
    scaled = F.rint(whole / 1000 * 100) / 100
    return (
        rows.select(name.alias("country"), whole.alias("_amount"), scaled.alias("gdp_billion"))
        .orderBy(F.desc("_amount"), "country")
        .limit(top)
        .drop("_amount")
    )
