"""Cleaning files as they arrive, with rules frozen beforehand or refreshed by every batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrubline.operators.profile import column_profile, merge_profiles
from scrubline.options import CleanOptions
from scrubline.plans.clean import (
    ColumnRule,
    filled_text,
    is_blank_row,
    name_columns,
    prepare,
    rules_of_profile,
)
from scrubline.streaming.batches import BatchFolders

_PROFILE = (
    "column_name string, total long, nonmissing long, numeric long, whole long, fractional long, "
    "boolean long, dates long, mean double, low double, high double"
)
_STORED = f"{_PROFILE}, batch int"


def clean_stream(
    stream: DataFrame, rules: dict[str, ColumnRule], options: CleanOptions, order: list[str]
) -> DataFrame:
    """The cleaning projection with types and fills frozen from an earlier profile.

    Stateless: each micro-batch is trimmed, normalized, converted, filled and rid of empty rows.
    """
    raw, columns = name_columns(stream, order)
    known = {c: rules.get(c, ColumnRule()) for c in columns}
    if options.drop_empty_rows and not any(r.fill for r in known.values()):
        raw = raw.filter(~is_blank_row(columns, options))
    texts = prepare(raw, columns, options)
    return texts.select(*order, *[filled_text(c, known[c], options) for c in columns])


@dataclass(frozen=True)
class Profiled:
    """``rows`` as cleaned, the ``profile`` of all input so far and the ``rules`` it gives."""

    rows: DataFrame
    profile: DataFrame
    rules: dict[str, ColumnRule]


@dataclass(frozen=True)
class ProfiledStream:
    """Cleans each batch by the profile of all input up to and with that batch.

    A batch is profiled by itself, which scans new files only, and merged with the profile that the
    batch before it stored: one row per column and batch. Types and fills are decided anew from the
    merged profile; rows cleaned earlier keep the text they were given. Fills that a profile does not
    hold (median, mode) are an error.
    """

    options: CleanOptions
    order: tuple[str, ...]
    base: str

    @property
    def folders(self) -> BatchFolders:
        return BatchFolders(self.base)

    def run(self, stream: DataFrame) -> Profiled:
        spark = stream.sparkSession
        named, columns = name_columns(stream, list(self.order))
        texts = [filled_text(c, ColumnRule(), self.options) for c in columns]
        schema = named.select(*self.order, *texts).schema
        if self.options.fill_missing in ("median", "mode"):
            raise ValueError(f"a profile holds no {self.options.fill_missing}")
        self.folders.begin(spark, "rows", schema)
        self.folders.begin(spark, "merged", StructType.fromDDL(_STORED))
        self.folders.run(stream, self.take)
        done = self.folders.read(spark, "merged", _STORED).agg(F.max("batch")).first()[0]
        latest = self.profile(spark, -1 if done is None else done)
        rows = self.folders.read(spark, "rows", schema)
        return Profiled(rows, latest, rules_of_profile(latest, columns, self.options))

    def take(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named, columns = name_columns(batch, list(self.order))
        texts = prepare(named, columns, self.options)
        own = column_profile(
            texts, columns, dates=self.options.parse_dates, tokens=self.options.na_tokens,
            cleaned=self.options.trim,
        )
        parts = own.unionByName(self.profile(spark, number - 1))
        merged = merge_profiles(parts).withColumn("batch", F.lit(number))
        self.folders.write(merged.coalesce(1), "merged", number)
        rules = rules_of_profile(self.profile(spark, number), columns, self.options)
        cleaned = clean_stream(batch, rules, self.options, list(self.order))
        self.folders.write(cleaned, "rows", number)

    def profile(self, spark: SparkSession, number: int) -> DataFrame:
        """The profile of all input up to a batch; -1 is before the first."""
        return self.folders.read(spark, "merged", _PROFILE, range(max(number, 0), number + 1))
