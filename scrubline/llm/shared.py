"""Helpers of the operators: narrow inputs, tables held in the shared folder."""

from __future__ import annotations

import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.session import shared_dir, ship_package


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone, so that no other column can clash with an operator's own names."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def text_bytes(text: Column) -> Column:
    """The UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def held(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The files outlive executors, so a lost machine repeats its own tasks and nothing before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def portions(batches, column: str, most: int = 4 << 20):
    """The batches cut into runs of rows with about ``most`` bytes in a column of texts or blobs.

    What a worker holds then depends neither on the batch size set nor on how long the texts are.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, begin = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if total and total + size > most:
                yield batch.slice(begin, row - begin)
                total, begin = 0, row
            total += size + 64
        if batch.num_rows:
            yield batch.slice(begin)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
