"""Cleaning delimited files end to end: inputs in, cleaned datasets and an audit table out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.names import unique_names
from scrubline.operators.lookup import lookup_join
from scrubline.options import CleanOptions
from scrubline.plans.clean import clean_many
from scrubline.session import cut_lineage, shared_dir
from scrubline.sources.delimited import (
    FILE,
    ORDER,
    Layout,
    find_layouts,
    layout_names,
    path_of,
    read_layout,
    resolve_inputs,
)
from scrubline.sources.sinks import (
    remove_folder,
    stage_path,
    store_of,
    swap_in,
    target_of,
    write_delimited,
    write_staged,
)


def keeps_blank_lines(options: CleanOptions) -> bool:
    """Whether a row without values can be part of the output."""
    return not options.drop_empty_rows or options.fill_missing != "none"


@dataclass
class LayoutResult:
    """Cleaned rows of one layout, held in the shared folder, and its audit counters per file."""

    layout: Layout
    rows: DataFrame
    audit: DataFrame
    folder: str


def clean_layout(spark: SparkSession, layout: Layout, options: CleanOptions) -> LayoutResult:
    """Clean all files of a layout in one plan and hold the result as Parquet.

    The conversion and the duplicate shuffle run once; the audit, the choice of kept columns and
    the final write all read the held result.
    """
    names = layout_names(layout, options.pad_rows)
    cleaned = clean_many(
        read_layout(spark, layout, options.pad_rows, keeps_blank_lines(options)),
        FILE, options, ORDER, names,
    )
    folder = stage_path(spark, shared_dir(spark))
    cleaned.frame.write.parquet(folder)
    rows = spark.read.parquet(folder)
    read = cleaned.rows_read().select(
        FILE, (F.col("rows") + 1).alias("rows_in"),
        F.col("empty_rows").alias("empty_rows_dropped"),
    )
    has = [F.count(F.nullif(F.col(c), F.lit(""))).alias(c) for c in cleaned.columns]
    written = rows.groupBy(FILE).agg(F.count(F.lit(1)).alias("rows_out"), *has)
    everything = F.array(*[F.lit(c) for c in cleaned.columns])
    kept = everything
    if options.remove_empty_columns:
        kept = F.array_compact(
            F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in cleaned.columns])
        )
    files = spark.createDataFrame(
        [(f, layout.own_width(i)) for i, f in enumerate(layout.files)], f"{FILE} string, _own int"
    )
    # a file's output ends where its own widest row does
    own = F.slice(everything, F.lit(1), F.col("_own"))
    audit = (
        files.join(read, FILE, "left")
        .join(written.select(FILE, "rows_out", kept.alias("header_out")), FILE, "left")
        .join(cleaned.column_types(), FILE, "left")
        .fillna({"rows_in": 1, "empty_rows_dropped": 0, "rows_out": 0})
        .withColumn("header_out", F.array_intersect(own, F.coalesce("header_out", everything)))
        .drop("_own")
        .withColumn(
            "duplicate_rows_dropped",
            F.col("rows_in") - 1 - F.col("empty_rows_dropped") - F.col("rows_out"),
        )
        .withColumn("header_in", F.array(*[F.lit(h) for h in layout.header]))
        .withColumn("_headed", F.lit(layout.has_header))
    )
    return LayoutResult(layout, rows, cut_lineage(audit), folder)


def audit_table(
    results: list[LayoutResult], scanned: DataFrame, outputs: DataFrame, options: CleanOptions
) -> DataFrame:
    """One row per file: paths, counters, headers, delimiter, encoding, options, column types.

    Where empty rows are dropped and nothing fills them, blank lines are not read as rows; they
    count as rows read and as empty rows dropped.
    """
    counts = results[0].audit
    for r in results[1:]:
        counts = counts.unionByName(r.audit)
    facts = scanned.select(FILE, "delimiter", "encoding", "blank_lines", "width")
    # without a header record the first blank line stands for it
    blanks = F.greatest(
        F.col("blank_lines") - F.when(F.col("_headed"), 0).otherwise(1), F.lit(0)
    )
    if keeps_blank_lines(options):  # they are rows like any other
        blanks = F.lit(0)
    return (
        facts.join(counts, FILE, "left")
        .join(outputs, FILE, "left")
        .select(
            "input_path",
            "output_path",
            F.when((F.col("width") == 0) & (F.col("blank_lines") == 0), F.lit(0))
            .otherwise(F.col("rows_in") + blanks)
            .alias("rows_in"),
            "rows_out",
            (F.col("empty_rows_dropped") + blanks).alias("empty_rows_dropped"),
            "duplicate_rows_dropped",
            "header_in",
            "header_out",
            "delimiter",
            F.col("encoding").alias("encoding_read"),
            F.lit(options.pad_rows).alias("pad_mode"),
            F.lit(options.infer_types).alias("infer_types"),
            F.lit(options.parse_dates).alias("parse_dates"),
            F.lit(options.date_format).alias("date_format"),
            F.lit(options.type_threshold).alias("type_threshold"),
            F.lit(options.fill_missing).alias("fill_missing"),
            F.map_filter(
                "column_types", lambda k, v: F.array_contains(F.col("header_out"), k)
            ).alias("column_types"),
        )
    )


def clean_files(
    spark: SparkSession,
    inputs: list[str],
    options: CleanOptions = CleanOptions(),
    output_dir: str | None = None,
    suffix: str = "_cleaned",
    inplace: bool = False,
    audit_path: str | None = None,
) -> DataFrame:
    """Clean every input file and write ``<stem>_cleaned<ext>`` datasets; gives the audit table.

    The work is one plan per layout, not per file. Outputs are written to a staging folder and
    moved to their names afterwards, so an input may be overwritten in place, and an output, which
    carries a manifest, is itself an input like a file.
    """
    paths = resolve_inputs(spark, inputs)
    if not paths:
        raise FileNotFoundError("no input files found")
    finals = {p: target_of(p.rstrip("/"), output_dir, suffix, inplace) for p in paths}
    if len(set(finals.values())) < len(finals):
        raise ValueError("two inputs would get the same output path; use separate folders")
    layouts, scanned = find_layouts(spark, paths, options.delimiter)
    results: list[LayoutResult] = []
    try:
        return _clean_layouts(spark, layouts, scanned, results, finals, options, audit_path)
    finally:  # also after an error
        for folder in {r.folder for r in results} | {x.held for x in layouts if x.held}:
            remove_folder(spark, folder)


def _clean_layouts(
    spark: SparkSession,
    layouts: list[Layout],
    scanned: DataFrame,
    results: list[LayoutResult],
    finals: dict[str, str],
    options: CleanOptions,
    audit_path: str | None,
) -> DataFrame:
    results += [clean_layout(spark, layout, options) for layout in layouts]
    files = [f for layout in layouts for f in layout.files]
    outputs = spark.createDataFrame(
        [(f, str(i), path_of(f).rstrip("/"), finals[path_of(f)]) for i, f in enumerate(files)],
        f"{FILE} string, dataset_id string, input_path string, output_path string",
    )
    audit = cut_lineage(
        audit_table(results, scanned, outputs.drop("dataset_id"), options)
    )
    targets = outputs.join(audit.select("input_path", "header_out"), "input_path")
    for r in results:
        _write_layout(spark, r, targets)
    if audit_path:
        audit.write.mode("append").parquet(audit_path)
    return audit


def _write_layout(spark: SparkSession, result: LayoutResult, outputs: DataFrame) -> None:
    """Write a layout's datasets, one job per distinct set of kept columns and target store."""
    of_layout = spark.createDataFrame([(f,) for f in result.layout.files], f"{FILE} string")
    targets = outputs.join(of_layout, FILE).cache()
    placed = lookup_join(
        result.rows, targets.select(FILE, "dataset_id"), [FILE], F.struct(*ORDER)
    )
    groups: dict[tuple[str, tuple[str, ...]], list] = {}
    for row in targets.collect():
        groups.setdefault((store_of(row["output_path"]), tuple(row["header_out"])), []).append(row)
    for (_, columns), rows in groups.items():
        if not columns:
            continue
        finals = {row["dataset_id"]: row["output_path"] for row in rows}
        sources = {row["dataset_id"]: row["input_path"] for row in rows}
        beside = next(iter(finals.values())).rsplit("/", 1)[0]
        staging = stage_path(spark, beside)
        ids = F.col("dataset_id").isin(list(finals))
        write_staged(
            placed.filter(ids), "dataset_id", list(columns), ORDER, staging,
            result.layout.delimiter,
        )
        rowless = swap_in(spark, staging, finals, sources, overwrite=True)
        staging = stage_path(spark, beside)
        for dataset in rowless:
            nothing = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
            write_delimited(nothing, f"{staging}/dataset={dataset}", result.layout.delimiter)
        if rowless:
            swap_in(spark, staging, {d: finals[d] for d in rowless}, sources, overwrite=True)
    targets.unpersist()
