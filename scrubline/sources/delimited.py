"""Reading many delimited files at once.

A scan of the raw lines settles each file's encoding, delimiter, header and width. Files that
agree on all of these form one layout and are read by one ``spark.read.csv`` over many paths.
"""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scrubline.functions.names import default_names, widen_names
from scrubline.session import cut_lineage, shared_dir
from scrubline.sources import records
from scrubline.sources.lines import (
    DELIMITERS,
    FALLBACK,
    encoding_of,
    is_blank_line,
    latin1_to_cp1252,
    line_shapes,
    occurrences,
    unquoted,
    vote_delimiter,
)
from scrubline.sources.sinks import ASIDE, manifest_of, recover, recover_folder, stage_path

# a leading underscore never survives name sanitizing, so these cannot meet a data column
FILE, BLOCK, ROW, PLACE = "_file", "_block", "_row", "_place"
ORDER = [PLACE]


def place(dataset: bool = False) -> Column:
    """Position of a row in its file as one number: split offset, then record within the task.

    In a dataset the number of its part comes first. One fixed-width number, rather than a struct,
    lets "first seen" be a plain hash aggregate.
    """
    record = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint")
    part = F.coalesce(part, F.lit(0).cast("bigint")) if dataset else F.lit(0).cast("bigint")
    return place_of(part, F.col("_metadata.file_block_start"), record)


def place_of(part: Column, start: Column, record: Column) -> Column:
    """One number for the part of a dataset, the split's offset and the record within the task."""
    start = (part * F.lit(2**44) + start).cast("decimal(20,0)")
    return (start * F.lit(2**33).cast("decimal(10,0)") + record).cast("decimal(30,0)")


@dataclass(frozen=True)
class Layout:
    """What a set of files has in common; ``files`` are their keys as rows carry them.

    ``spans`` are the least and most cells of each file's rows. ``held`` is the folder of the records of
    files whose cells hold line breaks, empty for other files; who asked for the layouts removes it.
    """

    delimiter: str
    encoding: str
    header: tuple[str, ...]
    held: str
    has_header: bool
    files: tuple[str, ...]
    spans: tuple[tuple[int, int], ...]

    @property
    def multiline(self) -> bool:
        return self.held != ""

    @property
    def width(self) -> int:
        return max(self.own_width(i) for i in range(len(self.files)))

    def own_width(self, file: int) -> int:
        return max(self.spans[file][1], len(self.header))

    @property
    def names(self) -> list[str]:
        return list(self.header)

    @property
    def paths(self) -> list[str]:
        return [path_of(f) for f in self.files]


def path_of(file: str) -> str:
    """Path behind the percent-encoded file name that Spark attaches to rows."""
    return unquote(file)


def delimiter_alias(given: str | None) -> str | None:
    if given is not None and (given.lower() == "tab" or given == r"\t"):
        return "\t"
    return given or None


def is_dataset(path: str) -> bool:
    """Whether a resolved path (or a file key) is a written dataset, a folder of parts."""
    return path.endswith("/")


def _kinds(paths: list[str]) -> list[tuple[list[str], bool]]:
    """Plain files and datasets apart, as their rows name their file differently."""
    sides = [([p for p in paths if is_dataset(p) == kind], kind) for kind in (False, True)]
    return [(some, kind) for some, kind in sides if some]


def _file_key(dataset: bool) -> Column:
    """The file of a row, or the folder of its dataset with a slash at the end."""
    path = F.col("_metadata.file_path")
    return (F.regexp_replace(path, "[^/]+$", "") if dataset else path).alias(FILE)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def resolve_inputs(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Paths for files, folders (their ``*.csv`` only, not below) and globs; missing ones dropped.

    A folder with a manifest is a dataset that an earlier run wrote: it is one input, and its path ends
    in a slash. Outputs that a broken run had moved aside are put back first.
    A name is a pattern only where nothing of that very name exists. The order of the arguments is
    kept and a file named twice is taken once. Spark's readers pass over names that start with an
    underscore or a dot, so those are an error rather than an empty result.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, None] = {}

    def written(status) -> bool:
        path = status.getPath()
        return status.isDirectory() and manifest_of(spark, path.toString()) is not None

    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            recover(spark, pattern)
        hits = [fs.getFileStatus(path)] if fs.exists(path) else fs.globStatus(path) or []
        if len(hits) == 1 and hits[0].isDirectory() and not written(hits[0]):
            recover_folder(spark, hits[0].getPath().toString())
            inside = fs.listStatus(hits[0].getPath())
            names = [(h, h.getPath().getName()) for h in inside]
            hits = [h for h, n in names if n.endswith(".csv") and not n.startswith(ASIDE)]
        for hit in sorted(hits, key=lambda h: h.getPath().toString()):
            if hit.isFile() or written(hit):
                found[hit.getPath().toString() + "/" * hit.isDirectory()] = None
    hidden = [p for p in found if p.rstrip("/").rsplit("/", 1)[-1].startswith(("_", "."))]
    if hidden:
        raise ValueError(f"names that Spark does not read; rename them: {hidden[:5]}")
    return list(found)


def literal(path: str) -> str:
    """A path for ``spark.read`` in which no character is a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw lines with their file and place: ``_file, _block, _row, value``."""
    return _all(
        [
            spark.read.text([literal(p) for p in some]).select(
                _file_key(dataset),
                F.col("_metadata.file_block_start").alias(BLOCK),
                F.monotonically_increasing_id().alias(ROW),
                "value",
            )
            for some, dataset in _kinds(paths)
        ]
    )


def scan_files(lines: DataFrame, delimiter: str | None = None) -> DataFrame:
    """One row per file: encoding, delimiter, header line, widths, blank lines, quoted newlines.

    One pass groups all lines by shape; everything but the header follows from the shapes. The
    header pass looks at each file's first split only. Its typed aggregate keeps Spark on hash
    aggregation, where ``min_by`` on text alone would sort every line.
    """
    candidates = (delimiter,) if delimiter else DELIMITERS
    shapes = cut_lineage(line_shapes(lines, [FILE], "value", candidates))
    real = ~F.col("blank")
    widths = []
    for i in range(len(candidates)):
        n = F.when(real, F.col(f"n{i}") + 1)
        widths += [F.max(n).alias(f"max{i}"), F.min(n).alias(f"min{i}")]
        widths.append(F.some(f"open{i}").cast("int").alias(f"open{i}"))
    facts = shapes.groupBy(FILE).agg(
        F.sum(F.when(~real, F.col("lines")).otherwise(0)).alias("blank_lines"),
        encoding_of(F.every("all_utf8"), F.some("undefined_1252")).alias("encoding"),
        *widths,
    )
    first = lines.filter(F.col(BLOCK) == 0).groupBy(FILE).agg(
        F.min_by("value", ROW).alias("raw_header"),
        F.collect_set(F.lit(True)).alias("seen"),
    )
    voted = vote_delimiter(shapes, [FILE], candidates).select(FILE, "delimiter")
    joined = facts.join(first, FILE, "left").join(voted, FILE, "left")
    joined = joined.fillna({"delimiter": candidates[0]})
    if delimiter:
        joined = joined.withColumn("delimiter", F.lit(delimiter))
    latin = F.decode(F.col("raw_header").cast("binary"), "ISO-8859-1")
    header = (
        F.when(F.col("encoding") == "utf-8", F.col("raw_header"))
        .when(F.col("encoding") == "cp1252", latin1_to_cp1252(latin))
        .otherwise(latin)
    )

    def own(side: str):
        picked = F.lit(0)
        for i, d in enumerate(candidates):
            picked = F.when(F.col("delimiter") == d, F.col(f"{side}{i}")).otherwise(picked)
        return F.coalesce(picked, F.lit(0)).cast("int")

    multiline = own("open") == 1
    # inside a quoted cell a blank line is part of a record, so such files have none
    blank_lines = F.when(multiline, F.lit(0).cast("bigint")).otherwise(F.col("blank_lines"))
    return joined.select(
        FILE, blank_lines.alias("blank_lines"), "encoding", multiline.alias("multiline"), "delimiter",
        header.alias("header_line"), own("max").alias("width"), own("min").alias("min_width"),
    )


def _spark_encoding(encoding: str) -> str:
    return "UTF-8" if encoding == "utf-8" else "ISO-8859-1"


def _csv_options(
    delimiter: str, encoding: str, multiline: bool, width: int = 0
) -> dict[str, str]:
    return {
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "encoding": _spark_encoding(encoding),
        "multiLine": str(multiline).lower(),
        "maxCharsPerColumn": "-1",
        "maxColumns": str(max(20480, width + 1)),
        "mode": "PERMISSIVE",
    }


def _hold_records(
    spark: SparkSession, files: list[str], delimiter: str, encoding: str
) -> tuple[str, list[Row]]:
    """Records of files whose cells hold line breaks, written once to the shared folder.

    Gives the folder, and per file its widths and its header record.
    """
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint")
    value = F.col("value")
    if encoding != "utf-8":
        value = F.decode(value.cast("binary"), "ISO-8859-1")
    lines = _all(
        [
            spark.read.text([literal(path_of(f)) for f in some]).select(
                F.col("_metadata.file_path").alias(records.PATH),
                (F.coalesce(part, F.lit(0)) if dataset else F.lit(-1)).cast("bigint").alias(records.PART),
                F.col("_metadata.file_block_start").alias(BLOCK),
                F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias(ROW),
                value.alias("value"),
            )
            for some, dataset in _kinds(files)
        ]
    )
    path, part = F.col(records.PATH), F.col(records.PART)
    text = latin1_to_cp1252(F.col("text")) if encoding == "cp1252" else F.col("text")
    found = records.find_records(lines, delimiter).select(
        F.when(part < 0, path).otherwise(F.regexp_replace(path, "[^/]+$", "")).alias(FILE),
        place_of(F.greatest(part, F.lit(0)), F.col(BLOCK), F.col(ROW)).alias(PLACE),
        "first",
        text.alias("text"),
    )
    folder = stage_path(spark, shared_dir(spark))
    found.write.parquet(folder)
    cells = occurrences(unquoted(F.col("text"), (delimiter,)), F.lit(delimiter)) + 1
    heads = F.when(F.col("first"), F.struct(PLACE, "text"))
    facts = spark.read.parquet(folder).groupBy(FILE).agg(
        F.max(cells).alias("width"), F.min(cells).alias("min_width"), F.min(heads)["text"].alias("header")
    )
    return folder, facts.collect()


def find_layouts(
    spark: SparkSession, paths: list[str], delimiter: str | None = None
) -> tuple[list[Layout], DataFrame]:
    """Layouts of the given files and the scan table they come from.

    The driver receives one short row per file, as it already holds the list of files.
    """
    paths = resolve_inputs(spark, paths)
    if not paths:
        return [], None
    delimiter = delimiter_alias(delimiter)
    scanned = cut_lineage(scan_files(read_lines(spark, paths), delimiter))
    scanned = _with_empty_files(spark, scanned, paths, delimiter)
    rows = scanned.orderBy(FILE).collect()
    spans: dict[str, tuple[int, int]] = {}
    headers: dict[str, str] = {}
    folders: dict[tuple[str, str], str] = {}
    for enc, sep in sorted({(r["encoding"], r["delimiter"]) for r in rows if r["multiline"]}):
        chosen = [
            r[FILE] for r in rows
            if r["multiline"] and (r["encoding"], r["delimiter"]) == (enc, sep)
        ]
        folders[enc, sep], facts = _hold_records(spark, chosen, sep, enc)
        for r in facts:
            spans[r[FILE]] = (r["width"], r["min_width"])
            headers[r[FILE]] = r["header"]
    groups: dict[tuple, list[tuple[str, tuple[int, int]]]] = {}
    for r in rows:
        width, least = spans.get(r[FILE], (r["width"], r["min_width"]))
        text = r["header_line"] or ""
        has_header = text.strip() != ""
        if has_header and r["multiline"]:
            text = headers[r[FILE]]
        lines = io.StringIO(text, newline="")
        cells = next(csv.reader(lines, delimiter=r["delimiter"]), []) if has_header else []
        header = tuple(cells) or tuple(default_names(width))
        held = folders[r["encoding"], r["delimiter"]] if r["multiline"] else ""
        key = (r["delimiter"], r["encoding"], header, held, has_header)
        groups.setdefault(key, []).append((r[FILE], (least, width)))
    return [Layout(*key, *zip(*members)) for key, members in groups.items()], scanned


def _with_empty_files(
    spark: SparkSession, scanned: DataFrame, paths: list[str], delimiter: str | None
) -> DataFrame:
    """The scan with a row for each file that holds no line at all."""
    seen = {path_of(r[FILE]) for r in scanned.select(FILE).collect()}
    empty = [(p, 0, "utf-8", False, delimiter or FALLBACK, "", 0, 0) for p in paths if p not in seen]
    return scanned.unionByName(spark.createDataFrame(empty, scanned.schema)) if empty else scanned


def layout_names(layout: Layout, pad_rows: str) -> list[str]:
    """Raw names of the columns read: the header, widened unless rows are truncated to it."""
    if pad_rows == "truncate":
        return layout.names
    if pad_rows == "error":
        for i, (least, _) in enumerate(layout.spans):
            if least != layout.own_width(i):
                raise ValueError(
                    f"uneven rows: {least} to {layout.own_width(i)} cells in {layout.paths[i]}"
                )
    return widen_names(layout.names, layout.width)


def read_layout(
    spark: SparkSession, layout: Layout, pad_rows: str = "pad", keep_blank: bool = False
) -> DataFrame:
    """All rows of a layout: file, place and one string column ``_c0, ...`` per cell.

    Columns keep positional names here, since raw header names may repeat. Spark's reader passes
    over blank lines; with ``keep_blank`` each is a row without values, after the other rows of its
    split.
    """
    wanted = len(layout_names(layout, pad_rows))
    schema = ", ".join(f"_c{i} string" for i in range(max(layout.width, wanted)))
    reader = (
        spark.read.schema(schema)
        .options(
            **_csv_options(layout.delimiter, layout.encoding, False, layout.width)
        )
        .option("header", str(layout.has_header).lower())
    )
    if layout.multiline:
        return _parse_records(spark, layout, schema, wanted)
    cells = [F.col(f"_c{i}") for i in range(wanted)]
    if layout.encoding == "cp1252":
        cells = [latin1_to_cp1252(c).alias(f"_c{i}") for i, c in enumerate(cells)]
    rows = _all(
        [
            reader.csv([literal(p) for p in some]).select(_file_key(dataset), place(dataset).alias(PLACE), *cells)
            for some, dataset in _kinds(layout.paths)
        ]
    )
    return rows.unionByName(_blank_rows(spark, layout, wanted)) if keep_blank else rows


def _parse_records(spark: SparkSession, layout: Layout, schema: str, wanted: int) -> DataFrame:
    """Cells of held records by Spark's parser, each record once and in any number of tasks."""
    held = spark.read.parquet(layout.held).filter(F.col(FILE).isin(list(layout.files)))
    if layout.has_header:
        held = held.filter(~F.col("first"))
    options = _csv_options(layout.delimiter, "utf-8", True, layout.width)
    parsed = F.explode(F.array(F.from_csv("text", schema, options))).alias("_parsed")
    cells = [F.col("_parsed")[f"_c{i}"].alias(f"_c{i}") for i in range(wanted)]
    return held.select(FILE, PLACE, parsed).select(FILE, PLACE, *cells)


def _blank_rows(spark: SparkSession, layout: Layout, width: int) -> DataFrame:
    """A row of NULL cells for every blank line; in files with quoted newlines there are none.

    Without a header record the first blank line of a file stands for it.
    """
    late = F.lit(2**32).cast("decimal(11,0)")
    lines = _all(
        [
            spark.read.text([literal(p) for p in some]).select(
                _file_key(dataset), (place(dataset) + late).cast("decimal(30,0)").alias(PLACE), "value"
            )
            for some, dataset in _kinds(layout.paths)
        ]
    )
    blank = lines.filter(is_blank_line(F.col("value")) & F.lit(not layout.multiline)).drop("value")
    if not layout.has_header:
        header = blank.groupBy(FILE).agg(F.min(PLACE).alias("_first"))
        match = (blank[FILE] == header[FILE]) & (blank[PLACE] == header["_first"])
        blank = blank.join(header, match, "left_anti")
    cells = [F.lit(None).cast("string").alias(f"_c{i}") for i in range(width)]
    return blank.select(FILE, PLACE, *cells)
