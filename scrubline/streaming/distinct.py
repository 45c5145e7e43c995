"""The first row per key of an unbounded stream, with all its columns, and the rows that came too late."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scrubline.operators.dedup import keep_first
from scrubline.streaming.batches import BatchFolders

#: per batch: newest time of all input so far, newest time kept in it, oldest batch still remembered
_MARK = "batch int, high long, newest long, first int"


@dataclass(frozen=True)
class DistinctRows:
    """``rows``: the first row of each key. ``late``: rows behind the watermark, or without a time."""

    rows: DataFrame
    late: DataFrame


@dataclass(frozen=True)
class FirstRows:
    """What a stream's duplicates are told by, and where the rows go.

    The watermark of a batch is the newest time of the batches before it less ``delay``. A row older
    than that is late and goes to ``late`` with all its columns, as does a row without a time; every
    other row goes to ``rows`` unless its key is remembered. A key is remembered until the watermark is
    ``delay`` past the time of its row. Nulls in keys equal each other. Of one batch's rows of a key
    the first in ``order`` counts (by default all columns in turn), across batches the earlier one.

    The rows already kept are the state: a batch is compared with the keys in the folders of those
    batches that may still hold a remembered one, so what is read is bounded by the delay, not by the
    stream's age. A batch is reduced to one row per key inside each task before it meets them, so a
    hot key joins as one row.
    """

    keys: tuple[str, ...]
    ts: str
    delay: str
    base: str
    order: tuple[str, ...] = ()

    @property
    def folders(self) -> BatchFolders:
        return BatchFolders(self.base)

    def run(self, stream: DataFrame) -> DistinctRows:
        spark, schema = stream.sparkSession, stream.schema
        for kind in ("rows", "late"):
            self.folders.begin(spark, kind, schema)
        self.folders.run(stream, self.take)
        return DistinctRows(*(self.folders.read(spark, k, schema) for k in ("rows", "late")))

    def take(self, batch: DataFrame, number: int) -> None:
        spark, schema, time = batch.sparkSession, batch.schema, _micros(self.ts)
        high, first = self._before(spark, number)
        delay = _length(spark, self.delay)
        watermark = None if high is None else high - delay
        is_late = time.isNull() if watermark is None else time.isNull() | (time < watermark)

        seen, kept = Observation(), Observation()
        timely = batch.observe(
            seen, F.max(time).alias("high"), F.count_if(is_late).alias("late")
        ).filter(~is_late)
        keys = [_named(k) for k in self.keys]
        fresh = keep_first(timely, keys, [_named(c) for c in self.order or batch.columns])
        if watermark is not None:
            known = self.remembered(spark, schema, range(first, number), watermark)
            same = [fresh[k].eqNullSafe(known[f"seen_{i}"]) for i, k in enumerate(keys)]
            fresh = fresh.join(known, same, "left_anti")
        self.folders.write(fresh.observe(kept, F.max(time).alias("newest")), "rows", number)
        found = seen.get
        if found["late"]:
            self.folders.write(batch.filter(is_late), "late", number)

        now = max((h for h in (high, found["high"]) if h is not None), default=None)
        newest = kept.get["newest"]
        if now is not None:
            ages = self._newest(spark, first, number) | {number: newest}
            young = [b for b, t in ages.items() if t is not None and t + delay >= now - delay]
            first = min(young, default=number + 1)
        mark = spark.createDataFrame([(number, now, newest, first)], _MARK)
        self.folders.write(mark.coalesce(1), "marks", number)

    def remembered(
        self, spark: SparkSession, schema: StructType, batches: range, watermark: int
    ) -> DataFrame:
        """Keys that a row is still compared with, as ``seen_0`` and so on."""
        rows = self.folders.read(spark, "rows", schema, batches)
        young = _micros(self.ts) + _length(spark, self.delay) >= watermark
        return rows.filter(young).select(
            *[F.col(_named(k)).alias(f"seen_{i}") for i, k in enumerate(self.keys)]
        )

    def _before(self, spark: SparkSession, number: int) -> tuple[int | None, int]:
        if number == 0:
            return None, 0
        mark = self.folders.read(spark, "marks", _MARK, [number - 1]).first()
        return mark["high"], mark["first"]

    def _newest(self, spark: SparkSession, first: int, number: int) -> dict[int, int | None]:
        """Newest kept time of each remembered batch: as many rows as batches within the delay."""
        if first >= number:  # nothing is remembered
            return {}
        marks = self.folders.read(spark, "marks", _MARK, range(first, number))
        return {r["batch"]: r["newest"] for r in marks.select("batch", "newest").collect()}


def _named(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(_named(ts)).cast("timestamp"))


def _length(spark: SparkSession, delay: str) -> int:
    """Microseconds of an interval written as for a watermark."""
    zero = "timestamp_micros(0)"
    return spark.range(1).select(F.expr(f"unix_micros({zero} + interval {delay})")).first()[0]
