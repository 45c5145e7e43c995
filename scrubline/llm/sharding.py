"""Shards of near equal bytes by minimax contiguous partition.

Equal texts form one atomic group. Groups are ordered by the SHA-256 of their text, and the smallest
capacity is sought for which the groups, taken in order, fit into the shards: a capacity is checked
greedily, by always taking the longest run that fits. A group as large as a fair share gets a shard
of its own first, since no other group could make that shard smaller.

The order is a hash, so a shard is an interval of hashes: seven cut points place every document,
without a join. Group sizes are summed inside the tasks, which makes a text that a third of all
rows share one row per task. The driver sees the sums of 4096 hash blocks; greedy steps inside a
block are answered by filtered aggregates for many capacities at once.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.shared import held, partitions, text_bytes, texts_of

BLOCKS = 4096
AT_ONCE = 32


def shard_documents(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``.

    ``size`` is the text's UTF-8 bytes plus one. A null text counts as empty and shares its group.
    ``slot`` numbers the rows of a shard from 0 in no particular order. With fewer groups than
    shards some shards stay empty; an empty table gives an empty result. Repeated rows each get a
    slot. A group is never divided, so a text that repeats beyond a fair share makes its shard
    larger than the others.
    """
    body = texts_of(docs, key, text).select("doc_id", text_bytes(F.col("text")).alias("body"))
    rows = held(
        body.select(
            "doc_id",
            F.unhex(F.sha2("body", 256)).alias("group"),
            (F.length("body") + 1).cast("bigint").alias("size"),
            F.crc32("body").alias("text_crc32"),
        ),
        "sized",
    )
    placed = rows.withColumn("shard", _shard_of(rows, shards))
    return _numbered(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def _block() -> Column:
    """The first twelve bits of the hash."""
    return (F.conv(F.substring(F.hex("group"), 1, 3), 16, 10)).cast("int")


def _shard_of(rows: DataFrame, shards: int) -> Column:
    groups = held(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    largest = groups.orderBy(F.desc("bytes"), "group").limit(shards).collect()
    alone, left = [], total
    for row in largest:
        free = shards - len(alone)
        if free == 1 or row["bytes"] * free < left:
            break
        alone.append(bytes(row["group"]))
        left -= row["bytes"]
    rest, biggest = groups, max((r["bytes"] for r in largest[len(alone) :]), default=0)
    for group in alone:
        rest = rest.where(F.col("group") != F.lit(group))
    cuts = Cuts(rest, biggest).keys(shards - len(alone))
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("group") > F.lit(cut), 1).otherwise(0)
    for k, group in enumerate(alone):
        shard = F.when(F.col("group") == F.lit(group), shards - 1 - k).otherwise(shard)
    return shard.cast("int")


class Cuts:
    """Running sums over ordered groups: block sums on the driver, the rest asked from Spark."""

    def __init__(self, groups: DataFrame, biggest: int):
        blocked = groups.withColumn("block", _block())
        sums = {r["block"]: r["s"] for r in blocked.groupBy("block").agg(F.sum("bytes").alias("s")).collect()}
        self.sizes = [sums.get(b, 0) for b in range(BLOCKS)]
        self.starts = [0, *accumulate(self.sizes)]
        self.total, self.biggest = self.starts[-1], biggest
        order = Window.partitionBy("block").orderBy("group")
        self.ends = held(
            blocked.select("block", "group", F.sum("bytes").over(order).alias("end")), "ends"
        )

    def keys(self, shards: int) -> list[bytes]:
        """The last group of each shard but the last one."""
        if self.total == 0 or shards < 2:
            return []
        capacity = self.smallest_capacity(shards)
        least = [self.total]  # a cut must not lie before these, or the shards after it overflow
        for _ in range(shards - 1):
            least.append(self._from([least[-1] - capacity])[0])
        least.reverse()
        cuts, at = [], 0
        for k in range(1, shards):
            # the cut nearest below an equal share among those that keep the capacity
            aim = min(at + capacity, max(k * self.total // shards, least[k]))
            at = self._upto([aim])[0]
            cuts.append(at)
        return self._groups_at([c for c in cuts if 0 < c < self.total])

    def smallest_capacity(self, shards: int) -> int:
        low = max(-(-self.total // shards), self.biggest)
        # whole blocks first: their optimum is at most one block above that of the groups
        widest = max(self.sizes)
        a, b = max(low, widest), self.total
        while a < b:
            middle = (a + b) // 2
            a, b = (a, middle) if self._blocks_fit(middle, shards) else (middle + 1, b)
        low, high = max(low, a - widest), a
        while low < high:
            step = max(1, (high - low) // (AT_ONCE + 1))
            tried = list(range(low, high, step))[:AT_ONCE]
            fits = self._fit(tried, shards)
            good = [c for c, ok in zip(tried, fits) if ok]
            bad = [c for c, ok in zip(tried, fits) if not ok]
            high = min(good, default=high)
            low = max(bad, default=low - 1) + 1
        return high

    def _blocks_fit(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            at = self.starts[bisect_right(self.starts, at + capacity) - 1]
        return at >= self.total

    def _fit(self, capacities: list[int], shards: int) -> list[bool]:
        at = [0] * len(capacities)
        for _ in range(shards - 1):
            at = self._upto([p + c for p, c in zip(at, capacities)])
        return [p + c >= self.total for p, c in zip(at, capacities)]

    def _upto(self, limits: list[int]) -> list[int]:
        """For each limit the largest running sum not above it."""
        return self._ask(limits, lambda end, x: F.max(F.when(end <= x, end)), 0)

    def _from(self, limits: list[int]) -> list[int]:
        """For each limit the smallest running sum not below it; 0 for limits up to 0."""
        return self._ask(limits, lambda end, x: F.min(F.when(end >= x, end)), 1)

    def _ask(self, limits: list[int], best, side: int) -> list[int]:
        found, asked = {}, {}
        for x in set(limits):
            if x <= 0 or x >= self.total:
                found[x] = min(max(x, 0), self.total)
                continue
            block = bisect_right(self.starts, x) - 1
            if self.starts[block] == x:
                found[x] = x
            else:
                asked[x] = block
        if asked:
            inside = self.ends.where(F.col("block").isin(sorted(set(asked.values()))))
            answers = [
                best(
                    F.when(F.col("block") == b, F.col("end")), F.lit(x - self.starts[b])
                ).alias(f"x{k}")
                for k, (x, b) in enumerate(asked.items())
            ]
            row = inside.agg(*answers).first()
            for k, (x, b) in enumerate(asked.items()):
                value = row[k]
                if value is None:  # no group ends inside on that side
                    value = self.sizes[b] if side else 0
                found[x] = self.starts[b] + value
        return [found[x] for x in limits]

    def _groups_at(self, cuts: list[int]) -> list[bytes]:
        """The groups that end at the given running sums."""
        if not cuts:
            return []
        wanted = F.lit(False)
        for cut in set(cuts):
            block = bisect_right(self.starts, cut - 1) - 1
            wanted = wanted | (
                (F.col("block") == block) & (F.col("end") == cut - self.starts[block])
            )
        return sorted(bytes(r["group"]) for r in self.ends.where(wanted).collect())


def _numbered(placed: DataFrame) -> DataFrame:
    """Gapless numbers inside each shard: rows are numbered in hash buckets, counts shift them."""
    buckets = partitions(placed.sparkSession)
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "group"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # at most shards x buckets rows, so the broadcast is bounded
    offsets = counts.select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "group")
    numbered = rows.withColumn("place", F.row_number().over(order))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).withColumn(
        "slot", F.col("before") + F.col("place") - 1
    )
