"""Cleaning files as they arrive and dropping repeated events in an unbounded stream."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.options import CleanOptions
from scrubline.plans.clean import clean
from scrubline.plans.views import dirty_customer, dup_events
from scrubline.session import shared_dir
from scrubline.streaming.distinct import FirstRows
from scrubline.streaming.profiled import ProfiledStream, clean_stream


def distinct_stream(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First event per key; a key is remembered until the watermark passes it, so state is bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, checkpoint: str, target: str) -> DataFrame:
    """Process all available input into Parquet and read the result."""
    started = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return stream.sparkSession.read.parquet(target)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table as a stream of files, whether it is one file or a folder of files."""
    folder = folder.rstrip("/")
    stored = spark.read.parquet(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(stored.schema)
    if any(f.endswith(f"/{name}.parquet") for f in stored.inputFiles()[:1]):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")


def _work_path(spark: SparkSession, name: str) -> str:
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def distinct_table_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their copies, read as a stream, the first row per key with all its columns."""
    events = dup_events(table_stream(spark, folder, "events"))
    first = FirstRows(
        keys=("user_id", "ts", "event_type"), ts="ts", delay="1 hour",
        base=_work_path(spark, "events"), order=("copy_no", "event_id"),
    )
    return first.run(events).rows


def clean_table_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Dirty customers cleaned as a stream with the rules of the batch profile."""
    options = CleanOptions(infer_types=True)
    batch = clean(dirty_customer(spark, folder), options, ["c_custkey"])
    source = dirty_customer(spark, folder, table_stream(spark, folder, "customer"))
    cleaned = clean_stream(source, batch.rules, options, ["c_custkey"])
    base = _work_path(spark, "customers")
    return run_to_table(cleaned, posixpath.join(base, "state"), posixpath.join(base, "rows"))


def profile_table_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The profile that dirty customers leave behind when they are cleaned as they arrive."""
    options = CleanOptions(infer_types=True, parse_dates=True)
    source = dirty_customer(spark, folder, table_stream(spark, folder, "customer"))
    keeper = ProfiledStream(options, ("c_custkey",), _work_path(spark, "profiled"))
    return keeper.run(source).profile
