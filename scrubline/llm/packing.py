"""Packing documents into token sequences by cutting-stock column generation.

A document is cut into full sequences and one remainder. The remainders' length histogram is the
demand of a cutting-stock problem: patterns of lengths that fill a sequence are the columns of a
linear program, a knapsack dynamic program over the sequence's length prices new columns with the
program's duals, and the program's solution is rounded to whole patterns. What rounding leaves is
packed largest first, each sequence filled up by a subset-sum dynamic program.

Spark counts the histogram, ranks the pieces of each length class and joins the rank to the pattern
that uses it; the driver sees the histogram only (at most one row per class), whatever the number of
documents. Lengths are classed by ``grain`` tokens, rounded up, so a pattern never overflows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubline.llm.shared import held, map_batches, texts_of
from scrubline.llm.word_tokens import encoder

CAPACITY = 2048
GRAIN = 4
END_ID = 1
BUCKETS = 64
FULL_BUCKETS = 4096
MOST_COLUMNS = 3000
GAP = 1e-3
TRUST = (0.1, 0.3, 0.6, 1.0)


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of every document: full ones first, then the remainder; the ids are kept as bytes."""
    narrow = texts_of(docs, key, text)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary"
    end = np.array([END_ID], dtype="<u4").tobytes()
    span = 4 * capacity

    def cut(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows, starts, lengths, totals, ids, held_bytes = [], [], [], [], [], 0

            def full(rows=rows, starts=starts, lengths=lengths, totals=totals, ids=ids, batch=batch):
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "ids"],
                )

            for row, body in enumerate(batch.column("text").to_pylist()):
                blob = encode(body or "") + end
                for at in range(0, len(blob), span):
                    piece = blob[at : at + span]
                    rows.append(row)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    totals.append(len(blob) // 4)
                    ids.append(piece)
                held_bytes += len(blob)
                if held_bytes > 16 << 20:
                    yield full()
                    for column in (rows, starts, lengths, totals, ids):
                        column.clear()
                    held_bytes = 0
            if rows:
                yield full()

    return map_batches(narrow, cut, schema)


@dataclass
class Patterns:
    """Columns: how often each class (1-based, in grains) occurs; and how many of each are used."""

    columns: np.ndarray
    counts: np.ndarray


def best_pattern(prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1..room that fits into ``room``, by dynamic program."""
    best = np.zeros(room + 1)
    taken = np.zeros(room + 1, dtype=np.int64)
    for c in range(1, room + 1):
        values = best[c - 1 :: -1] + prices[:c] if c > 1 else best[:1] + prices[:1]
        k = int(np.argmax(values))
        if values[k] > best[c - 1]:
            best[c], taken[c] = values[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern = np.zeros(room, dtype=np.int64)
    c = room
    while c > 0:
        if taken[c]:
            pattern[taken[c] - 1] += 1
            c -= taken[c]
        else:
            c -= 1
    return float(best[room]), pattern


def solve(demand: np.ndarray) -> Patterns:
    """Patterns covering ``demand`` (pieces of 1..n grains, sequences of n grains).

    Column generation on the linear program by the revised simplex method. It ends when no pattern
    is worth more than ``GAP`` above its cost, or when the plan is within ``GAP`` of the sequences
    that the tokens alone would fill.
    """
    room = len(demand)
    present = np.flatnonzero(demand)
    columns = _starting_columns(demand)
    inverse = np.linalg.inv(columns[present]) if len(present) else np.zeros((0, 0))
    amounts = inverse @ demand[present]
    sizes = np.arange(1, room + 1)
    floor = float(demand @ sizes) / room  # no plan needs fewer sequences
    # a price in proportion to length is always feasible and, where pieces fill sequences without
    # a rest, the best; pricing near it keeps the duals from swinging
    steady = sizes / room
    for _ in range(MOST_COLUMNS if len(present) else 0):
        if amounts.sum() <= floor * (1 + GAP):
            break
        prices = np.zeros(room)
        prices[present] = inverse.sum(axis=0)
        for trust in TRUST:
            mixed = np.where(demand > 0, trust * prices + (1 - trust) * steady, 0)
            _, pattern = best_pattern(np.maximum(mixed, 0), room)
            value = float(pattern @ prices)
            if value > 1 + GAP:
                break
        if value <= 1 + GAP:
            break
        direction = inverse @ pattern[present]
        usable = direction > 1e-9
        if not usable.any():
            break
        ratio = np.where(usable, amounts / np.where(usable, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        amounts = amounts - ratio[out] * direction
        amounts[out] = ratio[out]
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[:, out] = pattern
    return _rounded(columns, np.maximum(amounts, 0), demand)


def _starting_columns(demand: np.ndarray) -> np.ndarray:
    """A basis: full patterns, each used until one length runs out, which gives its row a pivot."""
    left, made, open_rows = demand.astype(float), [], set(np.flatnonzero(demand).tolist())
    while open_rows:
        pattern = np.zeros(len(demand), dtype=np.int64)
        largest = max(open_rows)
        at_hand = np.ceil(left).astype(np.int64)
        at_hand[largest] = max(0, at_hand[largest] - 1)
        pattern[largest] = 1
        for size in _fullest(at_hand, len(demand) - largest - 1):
            pattern[size - 1] += 1
        need = np.flatnonzero(pattern)
        limits = left[need] / pattern[need]
        out = int(need[np.argmin(limits)])
        left -= limits.min() * pattern
        left[out] = 0
        left = np.maximum(left, 0)
        open_rows.discard(out)
        made.append(pattern)
    return np.array(made, dtype=np.int64).reshape(len(made), len(demand)).T


def _rounded(columns: np.ndarray, amounts: np.ndarray, demand: np.ndarray) -> Patterns:
    """Whole patterns that use every piece exactly once."""
    left = demand.astype(np.int64).copy()
    counts = np.zeros(columns.shape[1], dtype=np.int64)
    used = columns.T.astype(np.int64)
    for k in np.argsort(-amounts, kind="stable"):  # never more of a length than there is
        need = used[k] > 0
        fit = int((left[need] // used[k][need]).min()) if need.any() else 0
        counts[k] = min(int(amounts[k] + 1e-6), fit)
        left -= counts[k] * used[k]
    for k in np.argsort(-(amounts - np.floor(amounts + 1e-6)), kind="stable"):
        if used[k].any() and (used[k] <= left).all():
            counts[k] += 1
            left -= used[k]
    extra = _fill(left)
    every = np.concatenate([used, extra]) if len(extra) else used
    counts = np.concatenate([counts, np.ones(len(extra), dtype=np.int64)])
    return Patterns(every[counts > 0], counts[counts > 0])


def _fill(left: np.ndarray) -> np.ndarray:
    """Patterns for the last pieces: the largest one left, then whatever fills the room best."""
    left, made = left.copy(), []
    while left.any():
        pattern = np.zeros(len(left), dtype=np.int64)
        largest = int(np.flatnonzero(left)[-1]) + 1
        left[largest - 1] -= 1
        pattern[largest - 1] = 1
        for size in _fullest(left, len(left) - largest):
            left[size - 1] -= 1
            pattern[size - 1] += 1
        made.append(pattern)
    return np.array(made, dtype=np.int64).reshape(len(made), len(left))


def _fullest(left: np.ndarray, room: int) -> list[int]:
    """Sizes of pieces at hand whose sum is as near to ``room`` as can be (subset sum)."""
    reached = np.zeros(room + 1, dtype=bool)
    reached[0] = True
    by = np.zeros(room + 1, dtype=np.int64)
    for size in (np.flatnonzero(left[:room]) + 1)[::-1]:
        for _ in range(min(int(left[size - 1]), room // int(size))):
            new = reached[:-size] & ~reached[size:]
            if not new.any():
                break
            by[size:][new] = size
            reached[size:] |= new
        if reached[room]:
            break
    at, sizes = int(np.flatnonzero(reached)[-1]), []
    while at:
        sizes.append(int(by[at]))
        at -= int(by[at])
    return sizes


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``doc_id``, ``start``, ``length``.

    ``pieces`` must be a stored table: it is read three times. Sequences are numbered from 0 and
    filled without gaps. Pieces of equal length are interchangeable, so repeated rows and ties only
    decide which of them comes first.
    """
    spark = pieces.sparkSession
    classed = pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    whole = F.col("class") == capacity // grain
    bucket = F.pmod(
        F.xxhash64("doc_id", "start"), F.when(whole, FULL_BUCKETS).otherwise(BUCKETS)
    ).cast("int")
    classed = classed.withColumn("bucket", bucket)
    counts = held(classed.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    demand = np.zeros(capacity // grain, dtype=np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        demand[row["class"] - 1] = row["n"]
    uses = _uses(spark, demand)
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # at most classes x BUCKETS + FULL_BUCKETS rows
    offsets = counts.select(
        "class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    order = Window.partitionBy("class", "bucket").orderBy("doc_id", "start")
    ranked = classed.withColumn("place", F.row_number().over(order))
    ranked = ranked.join(F.broadcast(offsets), ["class", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("place") - 1
    )
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    seated = ranked.join(
        F.broadcast(uses), (ranked["class"] == uses["use_class"]) & inside
    ).withColumn("along", F.col("rank") - F.col("first"))
    seated = seated.select(
        *[pieces[c] for c in pieces.columns],
        (F.col("base") + F.expr("along div each")).alias("sequence_id"),
        "use_class",
        F.expr("along % each").alias("turn"),
    )
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("use_class"), "turn").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return seated.withColumn(
        "offset", F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("bigint"))
    ).drop("use_class", "turn")


def _uses(spark: SparkSession, demand: np.ndarray) -> DataFrame:
    """Which ranks of a class go to which pattern: one row per class and pattern, so bounded."""
    rest = demand.copy()
    whole, rest[-1] = int(demand[-1]), 0
    patterns = solve(rest)
    rows, next_rank, base = [(len(demand), 0, whole, 1, 0)] if whole else [], {}, whole
    for column, count in zip(patterns.columns, patterns.counts):
        for size in np.flatnonzero(column) + 1:
            each, first = int(column[size - 1]), next_rank.get(int(size), 0)
            last = first + each * int(count)
            rows.append((int(size), first, last, each, base))
            next_rank[int(size)] = last
        base += int(count)
    schema = "use_class int, first bigint, last bigint, each bigint, base bigint"
    return spark.createDataFrame(rows, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents with their ids, sequence and place.

    Columns: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``ids`` (little-endian 32-bit),
    ``ids_crc32``, ``sequence_id``, ``offset``. A null text is empty and has the closing id alone.
    An empty table gives an empty result.
    """
    pieces = tokenize_pieces(docs, tokenizer, capacity, key, text)
    return pack(held(pieces.withColumn("ids_crc32", F.crc32("ids")), "pieces"), capacity)
