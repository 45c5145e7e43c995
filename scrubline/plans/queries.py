"""The registered queries: one callable ``(spark, folder) -> DataFrame`` per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.names import name_rows, widen_names
from scrubline.functions.parsing import is_whole, numeric_value, parse_boolean, parse_timestamp
from scrubline.functions.render import format_timestamp
from scrubline.functions.text import blank_to_null, normalize_whitespace
from scrubline.operators import defects, html, profile, shape
from scrubline.operators.dedup import drop_duplicate_rows, keep_first
from scrubline.operators.lookup import lookup_join
from scrubline.operators.spelling import fix_spelling, merge_parts
from scrubline.options import CleanOptions
from scrubline.session import cut_lineage
from scrubline.plans import reports, views
from scrubline.plans.clean import audit_counts, name_columns, prepare
from scrubline.plans.clean import clean as clean_one
from scrubline.plans.clean import clean_many as clean_all
from scrubline.sources.lines import (
    field_count,
    line_shapes,
    own_count,
    parse_lines,
    vote_delimiter,
    widest,
)
from scrubline.sources.tables import table
from scrubline.streaming.streams import (
    clean_table_stream,
    distinct_table_stream,
    profile_table_stream,
)

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}

INFER = CleanOptions(infer_types=True)
KEY = views.LINEITEM_KEY
# Event types that get a column; the others share one.
EVENT_TYPES = ["click", "purchase", "signup", "view"]
MODEL = "Brand#12"
HEADER = ["id", "priority", "status", "price"]
# The tables may arrive as one file of one split.
clean, clean_many = partial(clean_one, spread=True), partial(clean_all, spread=True)


def query(fn: Query) -> Query:
    """Register under the function's name, less a suffix that keeps it off an imported name."""
    _registered[fn.__name__.removesuffix("_cells")] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_registered)


# --- cells -----------------------------------------------------------------------------------


@query
def normalize_whitespace_cells(spark, folder):
    names = views.dirty_customer(spark, folder).select(
        F.lit("customer").alias("src"), F.col("c_custkey").alias("id"),
        F.col("name_raw").alias("raw"),
    )
    texts = table(spark, folder, "documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("raw")
    )
    both = names.unionByName(texts)
    return both.select("src", "id", normalize_whitespace(F.col("raw")).alias("cleaned"))


@query
def na_normalize(spark, folder):
    dirty = views.dirty_customer(spark, folder)
    text = F.col("segment")
    return dirty.withColumn("segment", normalize_whitespace(F.col("segment_raw"))).select(
        "c_custkey", blank_to_null(text).alias("segment")
    )


@query
def parse_boolean_cells(spark, folder):
    dirty = views.dirty_customer(spark, folder)
    return dirty.select(
        "c_custkey",
        *[
            parse_boolean(normalize_whitespace(F.col(f"{c}_raw"))).alias(c)
            for c in ("active", "flag01", "segment")
        ],
    )


@query
def parse_numeric_cells(spark, folder):
    dirty = views.dirty_customer(spark, folder)
    value = F.col("value")
    kind = F.when(is_whole(value), F.lit("int")).when(value.isNotNull(), F.lit("float"))
    parsed = dirty.select(
        "c_custkey", numeric_value(normalize_whitespace(F.col("bal_raw"))).alias("value")
    )
    return parsed.select("c_custkey", "value", kind.alias("kind"))


@query
def parse_dates(spark, folder):
    dirty = views.dirty_orders(spark, folder)
    parsed = dirty.withColumn("d", parse_timestamp(F.col("date_raw"))).withColumn(
        "t", parse_timestamp(F.col("us_ts_raw"))
    )
    return parsed.select(
        "o_orderkey",
        format_timestamp(F.col("d"), "%Y-%m-%d").alias("order_day"),
        format_timestamp(F.col("t"), "%d.%m.%Y %H:%M:%S").alias("order_time"),
    )


# --- profile, types, fills -------------------------------------------------------------------


CUSTOMER_RAW = ["name_raw", "segment_raw", "bal_raw", "active_raw", "flag01_raw"]
ORDER_RAW = ["date_raw", "us_ts_raw"]


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    one = profile.column_profile(views.dirty_customer(spark, folder), CUSTOMER_RAW)
    two = profile.column_profile(views.dirty_orders(spark, folder), ORDER_RAW)
    return one.unionByName(two)


@query
def column_profile(spark, folder):
    return _profiles(spark, folder).select(
        "column_name", "total", "nonmissing", "numeric", "whole", "fractional", "boolean", "dates"
    )


@query
def infer_types(spark, folder):
    options = CleanOptions(infer_types=True, parse_dates=True)
    return profile.infer_types(_profiles(spark, folder), options).select("column_name", "type")


@query
def clean_typed(spark, folder):
    dirty = views.dirty_customer(spark, folder)
    return clean(dirty, INFER, ["c_custkey"], typed=True).frame


@query
def clean_text(spark, folder):
    dirty = views.dirty_customer(spark, folder)
    return clean(dirty, INFER, ["c_custkey"]).frame


@query
def clean_rejects(spark, folder):
    dirty = views.dirty_orders(spark, folder)
    options = CleanOptions(infer_types=True, parse_dates=True)
    return clean(dirty, options, ["o_orderkey"], typed=True).rejects()


def _filled(spark: SparkSession, folder: str, typed: bool, **options) -> DataFrame:
    dirty = views.dirty_lineitem(spark, folder)
    return clean(dirty, CleanOptions(**options), KEY, typed=typed).frame


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("qty_raw", "price_raw")})


@query
def fill_mean(spark, folder):
    return _rounded(_filled(spark, folder, True, infer_types=True, fill_missing="mean"))


@query
def fill_median(spark, folder):
    return _rounded(_filled(spark, folder, True, infer_types=True, fill_missing="median"))


@query
def fill_zero(spark, folder):
    return _rounded(_filled(spark, folder, True, infer_types=True, fill_missing="zero"))


@query
def fill_mode(spark, folder):
    dirty = views.dirty_lineitem(spark, folder).withColumn("row_place", views.lineitem_place())
    return clean(dirty.drop(*KEY), CleanOptions(fill_missing="mode"), ["row_place"]).frame.select(
        F.col("row_place").cast("string").alias("row_place"), "qty_raw", "price_raw", "flag_raw",
        "note_raw",
    )


@query
def fill_constant(spark, folder):
    return _filled(spark, folder, False, fill_missing="constant", fill_constant="X")


@query
def fill_per_file(spark, folder):
    lines, names = _parsed_lines(spark, folder)
    rows = lines.select("file_id", "o_orderkey", *shape.padded(F.col("fields"), names))
    options = CleanOptions(infer_types=True, fill_missing="mean")
    many = clean_many(rows, "file_id", options, ["o_orderkey"])
    price = F.round(F.col("price").cast("double"), 4)
    return many.frame.select("file_id", "o_orderkey", "priority", price.alias("price"))


@query
def fill_median_per_file(spark, folder):
    dirty = views.dirty_lineitem(spark, folder).withColumn("row_place", views.lineitem_place())
    options = CleanOptions(infer_types=True, fill_missing="median")
    tagged = dirty.withColumn("ship_year", F.year("l_shipdate")).drop(*KEY)
    many = clean_many(tagged, "ship_year", options, ["row_place"])
    value = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return many.frame.select(
        "ship_year", F.col("row_place").cast("string").alias("row_place"), value("qty_raw"),
        value("price_raw"),
    )


@query
def key_candidates(spark, folder):
    parts = [
        profile.key_candidates(table(spark, folder, t)).select(
            F.lit(t).alias("table_name"), "position", "column_name",
            F.round("ratio", 6).alias("ratio"),
        )
        for t in ("customer", "orders")
    ]
    return parts[0].unionByName(parts[1])


# --- rows, columns, names --------------------------------------------------------------------


@query
def drop_empty_rows(spark, folder):
    """Empty rows out, nothing converted."""
    return clean(views.dirty_lineitem(spark, folder), CleanOptions(), KEY).frame


@query
def remove_empty_columns(spark, folder):
    options = CleanOptions(remove_empty_columns=True, infer_types=True)
    return _rounded(clean(views.dirty_lineitem(spark, folder), options, KEY).frame)


@query
def sanitize_names(spark, folder):
    named = name_rows(views.raw_headers(spark, folder), "file_id", "position", "name_raw")
    return named.select("file_id", "position", "name_raw", "name")


@query
def merge_name_parts(spark, folder):
    part = table(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.lit(" "), F.col("p_brand")).alias("first_part"),
        F.when(F.col("p_partkey") % 10 == 0, F.lit(" ")).otherwise(F.col("p_type")).alias(
            "second_part"
        ),
    )
    return part.select("p_partkey", merge_parts("first_part", "second_part").alias("full_name"))


@query
def spelling_fix_join(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.lower("p_type").alias("kind"))
    words = part.select("kind").distinct()
    dictionary = words.select(defects.misspell(F.col("kind")).alias("wrong"), F.col("kind").alias("right"))
    picker = _by_arithmetic("p_partkey")
    typed_badly = defects.misspell_cells(part, ["kind"], 0.05, picker)
    return fix_spelling(typed_badly, "kind", dictionary)


# --- duplicates and defects ------------------------------------------------------------------


@query
def dedup_whole_row(spark, folder):
    events = views.dup_events(table(spark, folder, "events")).drop("copy_no")
    return _timed(drop_duplicate_rows(events))


@query
def dedup_by_keys(spark, folder):
    events = views.dup_events(table(spark, folder, "events"))
    kept = keep_first(events, ["user_id", "ts", "event_type"], ["copy_no", "event_id"])
    return _timed(kept)


def _timed(events: DataFrame) -> DataFrame:
    """Timestamps as text, so that engines compare alike."""
    return events.withColumn("ts", format_timestamp(F.col("ts"), "%Y-%m-%d %H:%M:%S.%f"))


def _by_arithmetic(key: str) -> defects.Picker:
    """Picks by the key's remainder, so that another engine can pick the same rows."""
    offsets = {"user_id": 3, "props": 4, "event_type": 5, "value outlier": 0, "value sign": 1}

    def pick(name: str, rate: float) -> Column:
        return F.col(key) % round(1 / rate) == offsets.get(name, 0)

    return pick


@query
def inject_defects(spark, folder):
    events = table(spark, folder, "events").drop("ts")
    pick = _by_arithmetic("event_id")
    outlier = F.lit(100000.0) + F.col("event_id") % 900000
    bad = defects.odd_numbers(events, "value", outlier, 0.001, 0.01, pick)
    bad = defects.misspell_cells(bad, ["event_type"], 0.01, pick)
    bad = defects.blank_cells(bad, ["user_id", "props"], 0.02, pick)
    bad = defects.add_copies(bad, 0.02, pick)
    return defects.shuffle_rows(bad, ["event_id"], seed=7)


# --- delimited lines -------------------------------------------------------------------------


def _voted(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    shapes = line_shapes(lines, ["file_id"], "line")
    return shapes, vote_delimiter(shapes, ["file_id"])


def _tagged_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Lines with their file's delimiter, and the most cells a line has.

    The vote, one row per file, is joined by ``lookup_join``.
    """
    lines = views.csv_lines(spark, folder)
    shapes, votes = _voted(lines)
    shapes = cut_lineage(shapes)
    votes = vote_delimiter(shapes, ["file_id"])
    tagged = lookup_join(
        lines, votes.select("file_id", "delimiter"), ["file_id"], F.col("o_orderkey")
    )
    return tagged, widest(shapes, votes, ["file_id"])


def _parsed_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Lines with their cells, and names for the widest of them."""
    tagged, width = _tagged_lines(spark, folder)
    return parse_lines(tagged, "line", F.col("delimiter"), width), widen_names(HEADER, width)


@query
def delimiter_vote(spark, folder):
    _, votes = _voted(views.csv_lines(spark, folder))
    return votes.select("file_id", "delimiter", F.round("share", 6).alias("share"), "lines")


@query
def file_width(spark, folder):
    shapes, votes = _voted(views.csv_lines(spark, folder))
    own = own_count(F.col("delimiter"))
    return (
        shapes.join(votes.select("file_id", "delimiter"), "file_id")
        .groupBy("file_id")
        .agg(F.max(own).alias("width"), F.min(own).alias("min_width"))
    )


@query
def clean_csv_lines(spark, folder):
    lines, names = _parsed_lines(spark, folder)
    rows = lines.select("file_id", "o_orderkey", *shape.padded(F.col("fields"), names))
    return clean(rows, CleanOptions(), ["file_id", "o_orderkey"]).frame


@query
def ragged_pad(spark, folder):
    lines, names = _parsed_lines(spark, folder)
    return lines.select("file_id", "o_orderkey", *shape.padded(F.col("fields"), names))


@query
def ragged_truncate(spark, folder):
    cells = shape.truncated(F.col("fields"), HEADER)
    lines, _ = _parsed_lines(spark, folder)
    return lines.select("file_id", "o_orderkey", *cells)


@query
def ragged_error_report(spark, folder):
    lines, _ = _tagged_lines(spark, folder)
    cells = field_count(F.col("line"), F.col("delimiter"))
    bad = shape.uneven_rows(lines, cells, F.lit(len(HEADER)))
    return bad.select("file_id", "o_orderkey", "cells", "wanted", "problem")


@query
def cleaning_audit(spark, folder):
    options = CleanOptions(drop_duplicates=True)
    dirty = views.dirty_lineitem(spark, folder).withColumn(
        "dataset", F.year("l_shipdate").cast("string")
    )
    raw, columns = name_columns(dirty.drop(*KEY), ["dataset"])
    lines = prepare(raw, columns, options)
    events = views.dup_events(table(spark, folder, "events")).select(
        F.col("event_type").alias("dataset"), F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").cast("string").alias("ts"), F.col("value").cast("string").alias("value"),
    )
    one = audit_counts(lines, columns, options, [], ["dataset"])
    by_key = audit_counts(
        events, ["user_id", "ts", "value"], options, ["user_id", "ts"], ["dataset"]
    )
    return one.unionByName(by_key)


# --- web pages -------------------------------------------------------------------------------


@query
def html_table_extract(spark, folder):
    rows = html.extract_tables(views.statement_pages(spark, folder))
    cell = [F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)]
    return rows.select("page_id", "table_no", "row_no", "is_header", *cell)


@query
def html_untidy_extract(spark, folder):
    rows = html.extract_untidy_tables(views.statement_pages(spark, folder))
    cell = [F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)]
    return rows.select("page_id", "table_no", "row_no", "is_header", *cell)


@query
def top_economies(spark, folder):
    rows = html.extract_tables(views.economy_page(spark, folder))
    body = rows.filter((F.col("table_no") == 0) & F.col("row_no").between(1, 10))
    return reports.top_by_amount(body, F.get("cells", F.lit(0)), F.get("cells", F.lit(2)), 10)


@query
def html_link_extract(spark, folder):
    return html.extract_links(table(spark, folder, "pages"))


# --- summaries -------------------------------------------------------------------------------


def _lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def _part(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part")


@query
def basic_stats(spark, folder):
    return reports.basic_stats(_lineitem(spark, folder), "l_quantity")


@query
def count_by_group(spark, folder):
    return reports.total_by_group(_lineitem(spark, folder), "l_returnflag", "l_quantity")


@query
def pivot_two_way(spark, folder):
    return reports.two_way(
        _lineitem(spark, folder), "l_returnflag", "l_linestatus", ["F", "O"], F.sum("l_quantity")
    )


@query
def heatmap_matrix(spark, folder):
    events = table(spark, folder, "events").withColumn("day", reports.iso_day("ts"))
    return reports.two_way(events, "day", "event_type", EVENT_TYPES, F.count(F.lit(1)))


@query
def quantity_by_dealer(spark, folder):
    return reports.quantity_by_dealer(_lineitem(spark, folder))


@query
def quantity_by_model(spark, folder):
    return reports.quantity_by_model(_lineitem(spark, folder), _part(spark, folder))


@query
def profit_by_dealer(spark, folder):
    return reports.profit_by_dealer(_lineitem(spark, folder))


@query
def profit_by_date_model(spark, folder):
    return reports.profit_by_date_model(_lineitem(spark, folder), _part(spark, folder))


@query
def profit_by_year_dealer(spark, folder):
    return reports.profit_by_year_dealer(_lineitem(spark, folder))


@query
def profit_one_model_by_dealer(spark, folder):
    return reports.profit_one_model_by_dealer(
        _lineitem(spark, folder), _part(spark, folder), MODEL
    )


@query
def sales_kpis(spark, folder):
    return reports.sales_kpis(_lineitem(spark, folder))


@query
def monthly_sales_profit(spark, folder):
    return reports.monthly_sales_profit(_lineitem(spark, folder))


@query
def events_per_type(spark, folder):
    return reports.count_per(table(spark, folder, "events"), "event_type")


@query
def count_two_level(spark, folder):
    return reports.count_per(table(spark, folder, "documents"), "lang", "source")


@query
def daily_series(spark, folder):
    events = table(spark, folder, "events")
    bought = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(F.lit(0.0))
    return reports.daily_series(events, "ts", "event_id", "value", bought)


# --- streams ---------------------------------------------------------------------------------


@query
def stream_dedup_events(spark, folder):
    return _timed(distinct_table_stream(spark, folder))


@query
def stream_clean_customers(spark, folder):
    return clean_table_stream(spark, folder)


@query
def stream_profile_customers(spark, folder):
    return profile_table_stream(spark, folder).select(
        "column_name", "total", "nonmissing", "numeric", "whole", "fractional", "boolean", "dates"
    )
