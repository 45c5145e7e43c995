"""Importance resampling towards a target distribution, on hashed runs of words.

Each run of adjacent words falls into a bucket by its checksum. A bucket's gain is the logarithm of
its share in the target over its share in the source, both smoothed by one occurrence; a document
weighs the sum of the gains of its runs. Random noise of the Gumbel kind, drawn from a hash of the
document's id, turns the highest sums into a sample without replacement whose odds are the weights.

Texts are read twice and never moved: once to count buckets, with one row per bucket and task in
the shuffle, once to weigh. Only the gains, one number per bucket, travel to the tasks. Ranks come
from a range-partitioned sort whose parts are numbered by their counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.shared import held, map_batches, portions, text_bytes
from scrubline.llm.word_automaton import Appender, WordScan

BUCKETS = 10_000
SCALE = 1000
HASHES = 4294967296.0  # values of the eight hexadecimal digits


def bucket_counts(
    docs: DataFrame, buckets: int = BUCKETS, low: int = 1, high: int = 1, text: str = "text"
) -> DataFrame:
    """``(bucket, n)``: occurrences of runs of ``low`` to ``high`` words, for buckets with any.

    A null or empty text has no words. Every row counts, repeated rows too.
    """

    def count(batches):
        appender, total = Appender(), np.zeros(buckets, dtype=np.int64)
        for batch in portions(batches, "body"):
            scan = WordScan(batch.column("body").to_pylist())
            for sums, _ in scan.runs(low, high, appender):
                total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    narrow = docs.select(text_bytes(F.col(text).cast("string")).alias("body"))
    partial = map_batches(narrow, count, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket from the ``(bucket, n)`` tables of source and target.

    The answer has ``buckets`` numbers, whatever the tables count. Without any occurrence on a side
    that side is uniform.
    """
    spark = source.sparkSession
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).union(
        target.select("bucket", F.lit(0).cast("bigint"), "n")
    )
    numbers = spark.range(buckets).select(
        F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t")
    )
    counts = both.union(numbers).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    rows = counts.collect()
    all_s = float(sum(r["s"] for r in rows)) + buckets
    all_t = float(sum(r["t"] for r in rows)) + buckets
    gains = [0] * buckets
    for r in rows:
        share = (float(r["t"] + 1) * all_s) / (float(r["s"] + 1) * all_t)
        gains[r["bucket"]] = int(np.floor(SCALE * np.log(share)))
    return gains


def weigh(
    docs: DataFrame,
    gains: list[int],
    low: int = 1,
    high: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` for every row; a text without words weighs 0."""
    narrow = docs.select(
        F.col(key).alias("doc_id"), text_bytes(F.col(text).cast("string")).alias("body")
    )
    buckets, kind = len(gains), narrow.schema["doc_id"].dataType.simpleString()

    def score(batches):
        appender, gain = Appender(), np.array(gains, dtype=np.int64)
        for batch in portions(batches, "body"):
            scan = WordScan(batch.column("body").to_pylist())
            n, weight = np.zeros((2, scan.n_texts), dtype=np.int64)
            for sums, at in scan.runs(low, high, appender):
                n += np.bincount(at, minlength=scan.n_texts)
                np.add.at(weight, at, gain[sums % np.uint32(buckets)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scan.n_words), pa.array(n), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    schema = f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint"
    return map_batches(narrow, score, schema)


def noise(seed: int, key: Column) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    part = (drawn.cast("double") + 0.5) / F.lit(HASHES)
    return F.floor(F.lit(-float(SCALE)) * F.ln(-F.ln(part))).cast("bigint")


def draw(weighed: DataFrame, seed: int, percent: int, least_words: int) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``; ranks 1, 2, 3, ... go to the drawn documents.

    Of the N rows with at least ``least_words`` words, ``floor(percent * N / 100)`` with the highest
    scores are drawn, ties to the smaller doc_id (null first), then to fewer features, the smaller
    weight and the row held first. Rows that repeat take part one by one. A null doc_id draws its noise from
    the seed alone.
    """
    scored = weighed.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    scored = held(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= least_words
    wanted = scored.where(able).count() * percent // 100
    order = [
        (~able).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(),
        F.col("n_features").asc(), F.col("weight").asc(), F.col("row").asc(),
    ]
    # The row's number makes every key unique, so a part never grows with a repeated row. Parts are
    # in the order of the keys, and a number's upper bits are its part's.
    parts = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = held(parts.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33).alias("part")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part of the sort
    before = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")
    )
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.select(
        *weighed.columns, "score", F.when(place <= wanted, place).cast("bigint").alias("rank")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    seed: int = 2024,
    percent: int = 10,
    least_words: int = 20,
    buckets: int = BUCKETS,
    low: int = 1,
    high: int = 1,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    Draws ``percent`` of the documents towards the distribution of ``target``. Whole texts are
    read, however long. A null or empty text has no words, weight 0 and is never drawn unless
    ``least_words`` is 0. An empty table gives an empty result, an empty target a uniform one.
    Other columns, whatever their names, are not read.
    """
    gains = bucket_gains(
        bucket_counts(docs, buckets, low, high, text),
        bucket_counts(target, buckets, low, high, target_text),
        buckets,
    )
    return draw(weigh(docs, gains, low, high, key, text), seed, percent, least_words)
