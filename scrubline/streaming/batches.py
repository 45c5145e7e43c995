"""Micro-batches kept as folders of Parquet, one folder per kind and batch.

A batch writes only its own folders and reads only those of earlier batches, so one that runs again
after a failure replaces what it left and gives the same result. State lives and dies with the
output: both lie under one folder, next to the stream's checkpoint.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class BatchFolders:
    """The folders under ``base``; holds names only, so a batch function may carry it."""

    def __init__(self, base: str):
        self.base = base.rstrip("/")

    def folder(self, kind: str, batch: int | str) -> str:
        return posixpath.join(self.base, kind, f"{batch:010d}" if isinstance(batch, int) else batch)

    def begin(self, spark: SparkSession, kind: str, schema: StructType) -> None:
        """An empty first folder, so that a kind can be read before any batch ran."""
        empty = spark.createDataFrame([], schema)
        empty.write.mode("overwrite").parquet(self.folder(kind, "begin"))

    def write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.folder(kind, batch))

    def read(
        self, spark: SparkSession, kind: str, schema: StructType, batches: Iterable[int] | None = None
    ) -> DataFrame:
        """All rows of a kind, or those of some batches."""
        if batches is None:
            whole = spark.read.schema(schema).option("recursiveFileLookup", "true")
            return whole.parquet(posixpath.join(self.base, kind))
        chosen = [self.folder(kind, b) for b in batches] or [self.folder(kind, "begin")]
        return spark.read.schema(schema).parquet(*chosen)

    def run(self, stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
        """All input that is there, batch by batch; a later call goes on where this one ended."""
        started = (
            stream.writeStream.foreachBatch(each)
            .option("checkpointLocation", posixpath.join(self.base, "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        started.awaitTermination()
