"""The cleaning plan: one profiling job, then one plan built from its result.

Order of the steps is part of the meaning: trim, missing cells, conversion and filling, empty
rows, duplicates, empty columns. Filling comes before the empty-row test.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.convert import converted_text, typed_value
from scrubline.functions.names import snake_name, unique_names
from scrubline.functions.parsing import parse_timestamp
from scrubline.functions.text import is_missing_cell, with_clean_text
from scrubline.operators.dedup import drop_duplicate_rows, keep_first
from scrubline.operators.lookup import lookup_join
from scrubline.operators.profile import COLUMN, column_profile, infer_types, with_fills
from scrubline.operators.shape import filled_columns, is_empty_row
from scrubline.options import CleanOptions
from scrubline.session import cut_lineage, spread_small

#: whole numbers up to here are exact in the profile's range counters
_SAFE_LONG = 9e15


@dataclass(frozen=True)
class ColumnRule:
    """What the profile decided for one column."""

    kind: str = "string"
    fill: str | None = None
    nonmissing: int | None = None
    total: int | None = None
    low: float | None = None
    high: float | None = None

    @property
    def sql_type(self) -> str:
        if self.kind == "integer":
            if self.fill is not None and not self.fill.lstrip("-").isdigit():
                return "double" if _is_number(self.fill) else "bigint"
            fits = max(abs(self.low or 0), abs(self.high or 0)) < _SAFE_LONG
            return "bigint" if fits else "decimal(38,0)"
        return {"float": "double", "boolean": "boolean", "date": "timestamp_ntz"}.get(
            self.kind, "string"
        )


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


@dataclass
class Cleaned:
    """A cleaned dataset: the frame, the rules used, and lazy side outputs."""

    frame: DataFrame
    columns: list[str]
    order: list[str]
    header_in: list[str]
    rules: dict[str, ColumnRule]
    options: CleanOptions
    texts: DataFrame = field(repr=False)

    @property
    def types(self) -> dict[str, str]:
        return {c: self.rules[c].kind for c in self.columns}

    def rejects(self) -> DataFrame:
        """Cells that hold a value but do not conform to their column's type."""
        kinds = {c: r.kind for c, r in self.rules.items() if r.kind != "string"}
        none = F.lit(None).cast("string")

        def reject(c: str | None) -> Column:
            if c is None:
                return _reject(none, none, none, F.lit(False))
            value = typed_value(F.col(c), _plain_type(self.rules[c]), self.options.trim)
            return _reject(F.lit(c), F.col(c), F.lit(kinds[c]), value.isNull())

        found = F.filter(
            F.array(*[reject(c) for c in (list(kinds) or [None])]),
            lambda b: b["bad"] & b["raw_value"].isNotNull(),
        )
        return self.texts.select(*self.order, F.inline(found)).drop("bad")

    def audit(self) -> DataFrame:
        """One row of counters; the header counts as a row read."""
        columns = list(self.rules)
        never = any(r.fill for r in self.rules.values())
        flagged = self.texts.withColumn(
            "_empty", F.lit(False) if never else is_empty_row(columns)
        )
        filled = flagged.select(
            "_empty", *[filled_text(c, self.rules[c], self.options) for c in columns]
        )
        keys = _dedup_keys(filled, self.rules, self.options)
        return audit_counts(filled, columns, self.options, keys)


def _reject(column: Column, raw: Column, wanted: Column, bad: Column) -> Column:
    return F.struct(
        column.alias("column_name"), raw.alias("raw_value"), wanted.alias("wanted_type"),
        bad.alias("bad"),
    )


def _plain_type(rule: ColumnRule) -> str:
    return ColumnRule(kind=rule.kind, low=rule.low, high=rule.high).sql_type


def name_columns(
    df: DataFrame, order: list[str], names: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """The frame under sanitized names, order columns first, and the data columns.

    ``names`` are the raw names of the data columns where the frame itself holds positional ones.
    """
    fixed = set(order)
    columns = unique_names(names or [c for c in df.columns if c not in fixed])
    new = iter(columns)
    renamed = df.toDF(*[c if c in fixed else next(new) for c in df.columns])
    return renamed.select(*order, *columns), columns


def prepare(df: DataFrame, columns: list[str], options: CleanOptions) -> DataFrame:
    """Normalized text in the data columns, NULL for missing cells."""
    return with_clean_text(df, columns, options.trim, options.na_tokens)


def is_blank_row(columns: list[str], options: CleanOptions) -> Column:
    """Whether all raw cells of a row are missing; stops at the first one that is not."""
    blank = is_missing_cell(F.col(columns[0]), options.trim, options.na_tokens)
    for c in columns[1:]:
        blank = blank & is_missing_cell(F.col(c), options.trim, options.na_tokens)
    return blank


def column_rules(
    texts: DataFrame, columns: list[str], options: CleanOptions, order: list[str]
) -> dict[str, ColumnRule]:
    """The profile's decisions, at most one row per column."""
    if not options.needs_profile:
        return {c: ColumnRule() for c in columns}
    profile = infer_types(
        column_profile(
            texts, columns, dates=options.parse_dates, tokens=options.na_tokens,
            cleaned=options.trim,
        ),
        options,
    )
    if options.fill_missing in ("mode", "median"):
        # Decide first, then look for fills only where a cell is missing and a fill can apply.
        rows = {r[COLUMN]: r for r in profile.collect()}
        number = ("integer", "float")
        needed = [
            c
            for c in columns
            if 0 < rows[c]["nonmissing"] < rows[c]["total"]
            and (options.fill_missing == "mode" or rows[c]["type"] in number)
        ]
        fills: dict[str, str | None] = {}
        if needed:
            part = df_of_rows(profile, [rows[c] for c in needed])
            found = with_fills(texts, part, needed, options, order=order)
            fills = {r[COLUMN]: r["fill"] for r in found.select(COLUMN, "fill").collect()}
    else:
        found = with_fills(texts, profile, columns, options, order=order)
        rows = {r[COLUMN]: r for r in found.collect()}
        fills = {c: r["fill"] for c, r in rows.items()}
    return _rules_of(rows, fills, columns)


def _rules_of(rows: dict, fills: dict, columns: list[str]) -> dict[str, ColumnRule]:
    out = {}
    for c in columns:
        r = rows.get(c)
        if r is None:  # no rows at all
            out[c] = ColumnRule(nonmissing=0, total=0)
            continue
        out[c] = ColumnRule(
            r["type"], fills.get(c), r["nonmissing"], r["total"], r["low"], r["high"]
        )
    return out


def rules_of_profile(
    profile: DataFrame, columns: list[str], options: CleanOptions
) -> dict[str, ColumnRule]:
    """Decisions from a stored profile alone, for fills that need no second look at the data."""
    if options.fill_missing in ("mode", "median"):
        raise ValueError(f"a profile holds no {options.fill_missing}")
    found = with_fills(profile, infer_types(profile, options), columns, options)
    rows = {r[COLUMN]: r for r in found.collect()}
    return _rules_of(rows, {c: r["fill"] for c, r in rows.items()}, columns)


def df_of_rows(like: DataFrame, rows: list) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, like.schema)


def filled_text(c: str, rule: ColumnRule, options: CleanOptions) -> Column:
    value = converted_text(F.col(c), rule.kind, options.date_format, options.trim)
    return (value if rule.fill is None else F.coalesce(value, F.lit(rule.fill))).alias(c)


def filled_typed(c: str, rule: ColumnRule, options: CleanOptions) -> Column:
    kind = rule.sql_type
    value = typed_value(F.col(c), kind, options.trim)
    if rule.fill is not None:
        fill = F.lit(rule.fill)
        if kind == "timestamp_ntz":
            fill = parse_timestamp(fill)
        elif kind != "string":
            fill = fill.try_cast(kind)
        value = F.when(F.col(c).isNull(), fill).otherwise(value)
    return value.alias(c)


def _dedup_keys(df: DataFrame, rules: dict[str, ColumnRule], options: CleanOptions) -> list[str]:
    """Names of the key columns; empty for whole-row duplicates."""
    keys = [snake_name(k) for k in options.dedup_keys]
    unknown = [k for k in keys if k not in rules]
    if unknown and not options.dedup_keys_optional:
        raise ValueError(f"unknown duplicate key: {', '.join(unknown)}")
    return [] if unknown else keys


def comparable(c: str, kind: str | Column, options: CleanOptions) -> Column:
    """The value two rows are compared by: a zero fill equals a float column's ``0.0``."""
    text = F.col(c)
    if options.fill_missing != "zero":
        return text
    is_float = F.lit(kind == "float") if isinstance(kind, str) else kind == "float"
    return F.when(is_float & (text == "0"), F.lit("0.0")).otherwise(text)


def remove_duplicates(
    df: DataFrame,
    rules: dict[str, ColumnRule],
    options: CleanOptions,
    order: list[str],
    keys: list[str],
    typed: bool,
    scope: list[str] = (),
) -> DataFrame:
    if keys or (options.fill_missing == "zero" and not typed):
        chosen = [
            F.col(k) if typed else comparable(k, rules[k].kind, options)
            for k in (keys or list(rules))
        ]
        return keep_first(df, [*scope, *chosen], order)
    return drop_duplicate_rows(df, ignore=[o for o in order if o not in scope])


def clean(
    df: DataFrame,
    options: CleanOptions = CleanOptions(),
    order: list[str] | None = None,
    typed: bool = False,
    spread: bool = False,
) -> Cleaned:
    """Clean one dataset.

    ``order`` names the columns that identify a row and say which comes first; they are carried
    through unchanged. Without them the rows are numbered as read. In text mode every column is a
    string and a cell that does not conform keeps its text; with ``typed`` it becomes NULL and
    shows up in ``rejects()``. ``spread`` shuffles an input of a few splits over all cores first.
    """
    if order is None:
        order = ["row_id"]
        df = df.withColumn("row_id", F.monotonically_increasing_id())
    header_in = [c for c in df.columns if c not in order]
    raw, columns = name_columns(spread_small(df, order) if spread else df, order)
    texts = prepare(raw, columns, options)
    keys = _dedup_keys(texts, dict.fromkeys(columns), options) if options.drop_duplicates else []
    rules = column_rules(texts, columns, options, order)
    build = filled_typed if typed else filled_text
    filtered = texts
    if options.drop_empty_rows and not any(r.fill for r in rules.values()):
        # a row is empty when all its cells are missing and nothing fills them, so the test needs
        # no conversion and can sit next to the scan
        filtered = prepare(raw.filter(~is_blank_row(columns, options)), columns, options)
    frame = filtered.select(*order, *[build(c, rules[c], options) for c in columns])
    if options.drop_duplicates:
        frame = remove_duplicates(frame, rules, options, order, keys, typed)
    kept = columns
    if options.remove_empty_columns:
        kept = _kept_columns(frame, columns, rules, options, bool(keys), typed)
        frame = frame.select(*order, *kept)
    return Cleaned(frame, kept, order, header_in, rules, options, texts)


def _kept_columns(frame, columns, rules, options, by_keys: bool, typed: bool) -> list[str]:
    """Columns with a value somewhere in the output.

    The profile answers this unless duplicates by key may have removed a column's only values.
    """
    counted = all(r.nonmissing is not None for r in rules.values())
    if by_keys or not counted or typed:
        return filled_columns(
            frame.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns
        )

    def has_value(r: ColumnRule) -> bool:
        return r.nonmissing > 0 or bool(r.fill and r.total)

    return [c for c in columns if has_value(rules[c])]


def audit_counts(
    filled: DataFrame,
    columns: list[str],
    options: CleanOptions,
    keys: list[str],
    dataset: list[str] = (),
) -> DataFrame:
    """Rows in and out, empty rows and duplicates, per dataset, from one pass over filled rows.

    Duplicates are counted by grouping on the compared columns, so copies are combined inside
    each task; the second grouping has one row per dataset and task. ``filled`` may carry the
    flag ``_empty`` already.
    """
    empty = F.col("_empty") if "_empty" in filled.columns else is_empty_row(columns)
    if not options.drop_empty_rows:
        empty = F.lit(False)
    if options.drop_duplicates:
        compared = [
            F.when(~F.col("_empty"), F.col(c)).alias(f"_k{i}")
            for i, c in enumerate(keys or columns)
        ]
        groups = (
            filled.withColumn("_empty", empty)
            .groupBy(*dataset, "_empty", *compared)
            .agg(F.count(F.lit(1)).alias("_copies"))
        )
        extra = F.col("_copies") - 1
    else:
        groups = filled.select(*dataset, empty.alias("_empty"), F.lit(1).alias("_copies"))
        extra = F.lit(0)
    copies, blank = F.col("_copies"), F.col("_empty")
    counted = groups.groupBy(*dataset).agg(
        (F.coalesce(F.sum(copies), F.lit(0)) + 1).alias("rows_in"),
        F.coalesce(F.sum(F.when(blank, copies)), F.lit(0)).alias("empty_rows_dropped"),
        F.coalesce(F.sum(F.when(~blank, extra)), F.lit(0)).alias("duplicate_rows_dropped"),
    )
    return counted.withColumn(
        "rows_out",
        F.col("rows_in") - 1 - F.col("empty_rows_dropped") - F.col("duplicate_rows_dropped"),
    )


@dataclass
class CleanedMany:
    """Many datasets of one layout, cleaned in one plan with a rule set per dataset."""

    frame: DataFrame
    columns: list[str]
    dataset: str
    order: list[str]
    options: CleanOptions
    decisions: DataFrame = field(repr=False)
    filled: DataFrame = field(repr=False)
    keys: list[str] = field(default_factory=list)

    def audit(self) -> DataFrame:
        return audit_counts(self.filled, self.columns, self.options, self.keys, [self.dataset])

    def rows_read(self) -> DataFrame:
        """Rows and empty rows per dataset; reads the flag only, so no cell is converted."""
        empty = F.col("_empty") if self.options.drop_empty_rows else F.lit(False)
        return self.filled.groupBy(self.dataset).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("empty_rows")
        )

    def column_types(self) -> DataFrame:
        """One row per dataset with the map from column to type."""
        pair = F.struct(F.col(COLUMN), F.col("type"))
        return self.decisions.groupBy(self.dataset).agg(
            F.map_from_entries(F.collect_list(pair)).alias("column_types")
        )


def clean_many(
    df: DataFrame,
    dataset: str,
    options: CleanOptions = CleanOptions(),
    order: list[str] = ("row_id",),
    names: list[str] | None = None,
    spread: bool = False,
) -> CleanedMany:
    """Clean every dataset named by the ``dataset`` column with its own types and fills.

    Nothing is decided on the driver: the per-dataset rules are a table, joined back to the rows
    (see ``lookup_join``), so that the number of datasets and a very large one do not matter.
    """
    carried = [dataset, *order]
    spread_out = spread_small(df, carried) if spread else df
    raw, columns = name_columns(spread_out, carried, names)
    texts = prepare(raw.withColumn("_empty", is_blank_row(columns, options)), columns, options)
    keys = _dedup_keys(texts, dict.fromkeys(columns), options) if options.drop_duplicates else []
    if options.needs_profile:
        profile = infer_types(
            column_profile(
                texts, columns, [dataset], options.parse_dates, options.na_tokens,
                cleaned=options.trim,
            ),
            options,
        )
        decisions = cut_lineage(
            with_fills(texts, profile, columns, options, [dataset], list(order))
        )
        entry = F.struct(F.col(COLUMN), F.struct("type", "fill"))
        rules = decisions.groupBy(dataset).agg(
            F.map_from_entries(F.collect_list(entry)).alias("_rules"),
            F.some(F.coalesce(F.col("fill"), F.lit("")) != "").alias("_fills"),
        )
        # names are looked up once per dataset; rows find their rule by the column's position
        rules = rules.select(
            dataset,
            "_fills",
            F.array(*[F.col("_rules")[c]["type"] for c in columns]).alias("_kinds"),
            F.array(*[F.col("_rules")[c]["fill"] for c in columns]).alias("_filling"),
        )
        ruled = lookup_join(texts, rules, [dataset], F.struct(*order))
        ruled = ruled.withColumn("_empty", F.col("_empty") & ~F.col("_fills"))
        filled = ruled.select(
            *carried, "_empty", "_kinds",
            *[_filled_by_rule(c, i, options) for i, c in enumerate(columns)],
        )
    else:
        decisions = (
            texts.select(dataset)
            .distinct()
            .select(dataset, F.explode(F.array(*[F.lit(c) for c in columns])).alias(COLUMN))
            .withColumn("type", F.lit("string"))
        )
        filled = texts.withColumn("_kinds", F.lit(None).cast("array<string>"))
    frame = filled.filter(~F.col("_empty")) if options.drop_empty_rows else filled
    frame = frame.drop("_empty")
    if options.drop_duplicates:
        if keys or options.fill_missing == "zero":
            chosen = [
                comparable(k, F.get("_kinds", F.lit(columns.index(k))), options)
                if options.fill_missing == "zero"
                else F.col(k)
                for k in (keys or columns)
            ]
            frame = keep_first(frame, [dataset, *chosen], list(order))
        else:
            frame = drop_duplicate_rows(frame.drop("_kinds"), ignore=list(order))
    return CleanedMany(
        frame.select(*carried, *columns), columns, dataset, list(order), options, decisions,
        filled.select(*carried, "_empty", *columns), keys,
    )


def _filled_by_rule(c: str, position: int, options: CleanOptions) -> Column:
    kinds = ("integer", "float", "boolean") if options.infer_types else ()
    kinds += ("date",) if options.parse_dates else ()
    kind = F.get("_kinds", F.lit(position))
    value = converted_text(F.col(c), kind, options.date_format, options.trim, kinds)
    return F.coalesce(value, F.get("_filling", F.lit(position))).alias(c)
