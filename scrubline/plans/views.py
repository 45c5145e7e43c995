"""Dirty views over clean tables.

Every defect follows from arithmetic on the row's key, so another engine can build the same rows.
All rows of the source table are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.render import format_timestamp
from scrubline.sources.lines import DELIMITERS
from scrubline.sources.tables import table

NBSP = " "
# Spellings cycled through by the views.
NA_CYCLE = ("", "na", "N/A", "NULL", "none", "#N/A", "-", "?", "NaN")
BOOL_CYCLE = ("true", "T", "Yes", "y", "TRUE", "false", "F", "no", "N", "FALSE")
HEADER_ENDINGS = (" Id", "-id", "&ID", "  id", " id ")
DATE_FORMS = (
    "%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d-%m-%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S",
)
UNPARSABLE_DATE = "%d %b %Y"

LINEITEM_KEY = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate",
]
LINES_PER_PAGE = 25


def lineitem_place() -> Column:
    """The line's keys in one number, for "first seen" as a hash aggregate."""
    place = F.col("l_orderkey").cast("decimal(38,0)")
    for key, digits in (("l_linenumber", 2), ("l_partkey", 11), ("l_suppkey", 10)):
        place = (place * F.lit(10**digits).cast("decimal(12,0)") + F.col(key)).cast("decimal(38,0)")
    return place


def _div(key: Column, by: int) -> Column:
    return ((key - key % by) / by).cast("bigint")


def _cycle(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def thousands(amount: Column) -> Column:
    return F.format_number(amount, 2)


def dirty_customer(
    spark: SparkSession, folder: str, source: DataFrame | None = None
) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    balance = _money("c_acctbal")
    plain = balance.cast("string")
    customers = source if source is not None else table(spark, folder, "customer")
    return customers.select(
        "c_custkey",
        F.when(key % 4 == 0, F.concat(F.lit("  "), name, F.lit("  ")))
        .when(key % 4 == 1, F.replace(name, F.lit("#"), F.lit(f"{NBSP}\t#")))
        .when(key % 4 == 2, F.concat(name, F.lit("\t")))
        .otherwise(name)
        .alias("name_raw"),
        F.when(key % 3 == 0, _cycle(NA_CYCLE, _div(key, 3)))
        .otherwise(F.col("c_mktsegment"))
        .alias("segment_raw"),
        F.when(balance < 0, F.concat(F.lit("("), thousands(-balance), F.lit(")")))
        .when(key % 5 == 0, F.lit(""))
        .when(key % 5 == 1, thousands(balance))
        .when(key % 5 == 2, plain)
        .when(key % 5 == 3, F.concat(plain, F.lit("%")))
        .otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))
        .alias("bal_raw"),
        _cycle(BOOL_CYCLE, key).alias("active_raw"),
        F.when(key % 2 == 0, F.lit("1")).otherwise(F.lit("0")).alias("flag01_raw"),
    )


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(key % 50 == 0, format_timestamp(day, UNPARSABLE_DATE))
    for i, form in enumerate(DATE_FORMS):
        raw = raw.when(key % 6 == i, format_timestamp(day, form))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        raw.alias("date_raw"),
        format_timestamp(day, "%m/%d/%Y %H:%M:%S").alias("us_ts_raw"),
    )


def dirty_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    spot = F.col("l_orderkey") + F.col("l_linenumber") + F.col("l_partkey")
    all_empty = (F.col("l_orderkey") + F.col("l_partkey")) % 100 == 7

    def gaps(value: Column, k: int) -> Column:
        return F.when(all_empty | ((spot + k) % 50 == 0), F.lit("")).otherwise(value)

    return table(spark, folder, "lineitem").select(
        *LINEITEM_KEY,
        gaps(_money("l_quantity").cast("string"), 0).alias("qty_raw"),
        gaps(_money("l_extendedprice").cast("string"), 1).alias("price_raw"),
        gaps(F.col("l_returnflag"), 2).alias("flag_raw"),
        F.lit("").alias("note_raw"),
    )


def dup_events(events: DataFrame) -> DataFrame:
    """Each event with its copies: 2% exact ones, 1% with the same key and another value.

    Copies are made in place by an explode, so the table is read once.
    """
    key = F.col("event_id")
    first = F.struct(F.lit(0).alias("copy_no"), F.lit(0.0).alias("_add"))
    exact = F.struct(F.lit(1).alias("copy_no"), F.lit(0.0).alias("_add"))
    changed = F.struct(F.lit(2).alias("copy_no"), F.lit(1.0).alias("_add"))
    copies = (
        F.when(key % 50 == 0, F.array(first, exact))
        .when(key % 100 == 1, F.array(first, changed))
        .otherwise(F.array(first))
    )
    return (
        events.select("*", F.inline(copies))
        .withColumn("value", F.col("value") + F.col("_add"))
        .drop("_add")
    )


def raw_headers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        _div(key, 10).alias("file_id"),
        (key % 10).cast("int").alias("position"),
        F.concat(F.col("p_type"), _cycle(HEADER_ENDINGS, key)).alias("name_raw"),
    )


def _html_row(tag: str, *cells: Column) -> Column:
    parts: list[Column] = [F.lit("<tr>")]
    for cell in cells:
        parts += [F.lit(f"<{tag}>"), cell, F.lit(f"</{tag}>")]
    return F.concat(*parts, F.lit("</tr>"))


def _page(header: Column, rows: Column) -> Column:
    return F.concat(
        F.lit("<html><body><table class='data'>\n"), header, rows, F.lit("\n</table></body></html>")
    )


def statement_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages with a table of 25 customers each: name, segment, balance with separators."""
    row = _html_row(
        "td",
        F.concat(F.lit("<b>"), F.col("c_name"), F.lit("</b>")),
        F.concat(F.col("c_mktsegment"), F.lit(" &amp; Co")),
        thousands(_money("c_acctbal")),
    )
    listed = (
        table(spark, folder, "customer")
        .select(_div(F.col("c_custkey"), LINES_PER_PAGE).alias("page_id"), "c_custkey", row.alias("r"))
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("c_custkey", "r"))).alias("rows"))
    )
    header = _html_row("th", F.lit("Name"), F.lit("Segment"), F.lit("Balance"))
    body = F.array_join(F.transform("rows", lambda r: r["r"]), "\n")
    return listed.select("page_id", _page(header, body).alias("html"))


def economy_page(spark: SparkSession, folder: str) -> DataFrame:
    """One page per region: nations with their customers' total balance in cents, largest first.

    The totals are summed before the join, so the pages are built from one row per nation.
    """
    totals = (
        table(spark, folder, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg((F.sum(_money("c_acctbal")) * 100).cast("bigint").alias("total"))
    )
    nation = table(spark, folder, "nation").join(totals, "n_nationkey")
    region = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    row = _html_row(
        "td", F.col("n_name"), F.col("r_name"), F.format_number("total", 0)
    )
    listed = (
        nation.join(region, "n_regionkey")
        .select(F.col("n_regionkey").alias("page_id"), (-F.col("total")).alias("o"), "n_name",
                row.alias("r"))
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("o", "n_name", "r"))).alias("rows"))
    )
    header = _html_row("th", F.lit("Country"), F.lit("Region"), F.lit("GDP"))
    body = F.array_join(F.transform("rows", lambda r: r["r"]), "")
    return listed.select("page_id", _page(header, body).alias("html"))


def csv_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Text lines of forty delimited files with four delimiters, quotes and uneven rows."""
    key = F.col("o_orderkey")
    file, turn = key % 40, _div(F.col("o_orderkey"), 40)
    d = F.get(F.array(*[F.lit(x) for x in DELIMITERS]), (file % 4).cast("int"))
    priority = F.when(
        turn % 10 == 5,
        F.concat(F.lit('"'), F.col("o_orderpriority"), d, F.lit(' ""x"""')),
    ).otherwise(F.col("o_orderpriority"))
    status = F.when(
        turn % 3 == 0, F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" "))
    ).otherwise(F.col("o_orderstatus"))
    price = _money("o_totalprice").cast("string")
    line = F.concat(key.cast("string"), d, priority, d, status)
    line = F.when(turn % 20 == 3, line).otherwise(F.concat(line, d, price))
    line = F.when(turn % 20 == 7, F.concat(line, d, F.lit("more"))).otherwise(line)
    return table(spark, folder, "orders").select(
        file.cast("int").alias("file_id"), "o_orderkey", line.alias("line")
    )
