"""Benchmark decontamination with suffix arrays of the training text.

Every task sorts the word suffixes of its documents, shard by shard, and binary-searches each
suffix of the test items in them. A hit of a whole window is lengthened to the longest verbatim
match, whose place and length are kept.

Shards are bounded blocks of documents, so memory does not grow with the data, and documents are
never shuffled. A shard's suffix array holds the suffixes that can start a match: those that begin
with as many word pairs known from the items as the shortest window has. The items travel in blocks
of bounded size; with several blocks the documents pass them one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.shared import held, map_batches, portions, text_bytes, texts_of
from scrubline.session import ship_package

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20

MATCH = "array<struct<start:bigint,length:bigint,item_id:string,item_start:bigint>>"
ARROW_MATCH = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("item_id", pa.string()),
            ("item_start", pa.int64()),
        ]
    )
)
# ASCII bytes other than digits and letters part words; letters are lower-cased.
LOWERED = bytes(
    (c + 32 if 65 <= c <= 90 else c)
    if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122
    else 32
    for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWERED).split()


class TestItems:
    """The items of one block, with their vocabulary, word pairs and window keys."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.vocab, self.items = window, {}, []
        vocab = self.vocab
        for item_id, text in items:
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in words_of(text)]
            if ids:
                self.items.append((item_id, np.array(ids, dtype=np.int64)))
        self.shortest = min((min(len(ids), window) for _, ids in self.items), default=0)
        pairs = [i[:-1] << 32 | i[1:] for _, i in self.items if len(i) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        self.words = np.concatenate([i for _, i in self.items]) if self.items else self.pairs
        low, high, self.of, self.at = [], [], [], []
        for k, (_, ids) in enumerate(self.items):
            size = min(len(ids), window)
            starts = np.arange(len(ids) - size + 1)
            rows = np.zeros((len(starts), window), dtype=">u4")
            rows[:, :size] = ids[starts[:, None] + np.arange(size)]
            low.append(_keys(rows.copy()))
            rows[:, size:] = 0xFFFFFFFF
            high.append(_keys(rows))
            self.of.append(np.full(len(starts), k))
            self.at.append(starts)
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.low, self.high, self.of, self.at = join(low), join(high), join(self.of), join(self.at)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian words as byte strings, whose order is the order of the words."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.shape[1] * 4}").ravel()


def _starts(ids: np.ndarray, test: TestItems) -> np.ndarray:
    """Positions from which as many known words and pairs follow as the shortest window has."""
    known = ids > 0
    need = test.shortest
    if need > 1:
        pair = ids[:-1] << 32 | ids[1:]
        at = np.flatnonzero(known[:-1] & known[1:])
        slot = np.searchsorted(test.pairs, pair[at])
        slot[slot == len(test.pairs)] = 0
        good = np.zeros(len(ids), dtype=bool)
        good[at] = test.pairs[slot] == pair[at]
        known, need = good, need - 1
    stops = np.flatnonzero(~known)
    nearest = np.searchsorted(stops, np.arange(len(ids)))
    ends = np.append(stops, len(ids))[nearest]
    return np.flatnonzero(ends - np.arange(len(ids)) >= need)


def longest_matches(ids: np.ndarray, test: TestItems) -> list[tuple[int, int, int, int]]:
    """``(position, words, item, place in item)`` of each verbatim match that cannot be lengthened.

    ``ids`` are the word ids of a shard, 0 for a word that no item has and between documents.
    """
    starts = _starts(ids, test) if test.shortest else np.empty(0, np.int64)
    if not len(starts):
        return []
    padded = np.concatenate([ids, np.zeros(test.window, ids.dtype)])
    rows = padded[starts[:, None] + np.arange(test.window)].astype(">u4")
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = starts[order], keys[order]
    first = np.searchsorted(keys, test.low, side="left")
    count = np.searchsorted(keys, test.high, side="right") - first
    hit = np.repeat(np.arange(len(count)), count)
    if not len(hit):
        return []
    inside = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
    train = suffixes[first[hit] + inside]
    item, place = test.of[hit], test.at[hit]
    sizes = np.array([len(i) for _, i in test.items])
    base = np.cumsum(sizes) - sizes
    before = np.where(place > 0, test.words[base[item] + np.maximum(place - 1, 0)], -1)
    here = np.where(train > 0, padded[np.maximum(train - 1, 0)], 0)
    new = before != here  # else the match that starts a word earlier has this one inside
    train, item, place = train[new], item[new], place[new]
    length = np.minimum(sizes[item], test.window)
    going = np.arange(len(train))
    while len(going):
        t, i, p, n = train[going], item[going], place[going], length[going]
        more = (p + n < sizes[i]) & (t + n < len(ids))
        going, t, i, p, n = going[more], t[more], i[more], p[more], n[more]
        same = padded[t + n] == test.words[base[i] + p + n]
        going = going[same]
        length[going] += 1
    return list(zip(train.tolist(), length.tolist(), item.tolist(), place.tolist()))


def _matches_of(texts: list[bytes], test: TestItems) -> tuple[list[list[dict]], list[int]]:
    """Longest matches and number of words of each text of a shard."""
    ids, starts, counts = [0], [], []
    for text in texts:
        words = words_of(text)
        starts.append(len(ids))
        counts.append(len(words))
        ids.extend(map(test.vocab.get, words, repeat(0)))
        ids.append(0)
    found: list[list] = [[] for _ in texts]
    places = np.array(starts)
    for p, n, i, q in longest_matches(np.array(ids, dtype=np.int64), test):
        doc = int(np.searchsorted(places, p, side="right")) - 1
        match = {"start": p - starts[doc], "length": n, "item_id": test.items[i][0], "item_start": q}
        found[doc].append(match)
    return found, counts


def _search(batches, items: list[tuple[str, bytes]], window: int):
    test = TestItems(items, window)
    for batch in portions(batches, "body", SHARD_BYTES):
        found, counts = _matches_of(batch.column("body").to_pylist(), test)
        found = [old + new for old, new in zip(batch.column("matches").to_pylist(), found)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("body"),
                pa.array(counts, pa.int64()),
                pa.array([_covered(m) for m in found], pa.int64()),
                pa.array(found, ARROW_MATCH),
            ],
            ["doc_id", "body", "n_words", "n_hit", "matches"],
        )


def _covered(matches: list[dict]) -> int:
    total = end = 0
    for m in sorted(matches, key=lambda m: m["start"]):
        stop = m["start"] + m["length"]
        total += max(0, stop - max(end, m["start"]))
        end = max(end, stop)
    return total


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``matches``, ``items``.

    ``matches`` are the longest verbatim matches of at least one window (word place, words, item and
    place in it), ``n_hit`` the words they cover, ``items`` the sorted ids of the items found. An
    item of fewer words than a window is one window. Null texts have no words; items without words
    match nothing; a null item id is listed as the empty string; items that repeat an id are listed
    once. Repeated documents each get a row. With no items nothing is hit.
    """
    state = texts_of(docs, key, text).select(
        "doc_id",
        text_bytes(F.col("text")).alias("body"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(0).cast("bigint").alias("n_hit"),
        F.array().cast(MATCH).alias("matches"),
    )
    schema = state.schema
    blocks = _item_blocks(benchmark, block_bytes, item, item_text)
    spark = docs.sparkSession
    for k, items in enumerate(blocks):
        shipped = spark.sparkContext.broadcast(items)

        def search(batches, shipped=shipped):
            return _search(batches, shipped.value, window)

        state = map_batches(held(state, "leaks") if k else state, search, schema)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return state.select("doc_id", "n_words", "n_hit", "matches", ids.alias("items"))


def _item_blocks(benchmark: DataFrame, block_bytes: int, item: str, item_text: str):
    """The items, in blocks of at most about ``block_bytes``; an empty block if there are none."""
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"),
        text_bytes(F.col(item_text).cast("string")).alias("body"),
    ).where(F.length("body") > 0)
    total = items.agg(F.sum(F.length("body") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    number = F.pmod(F.hash("item_id", "body"), F.lit(int(blocks)))
    for k in range(blocks):
        yield [(r.item_id, bytes(r.body)) for r in items.where(number == k).collect()]


def drop_leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold any benchmark window; all columns kept, nothing shuffled.

    A row is judged by its own text inside the task that reads it, so ids may be null or stand for
    several texts, and other columns may have any names. A null or empty text holds no window.
    """
    spark = docs.sparkSession
    ship_package(spark)
    for items in _item_blocks(benchmark, BLOCK_BYTES, "item_id", "text"):
        docs = docs.where(~_holds_window(spark.sparkContext.broadcast(items), window)(F.col("text").cast("string")))
    return docs


def _holds_window(shipped, window: int):
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        test = TestItems(shipped.value, window)
        for texts in batches:
            bodies = ["" if t is None else t for t in texts]
            hit, at = np.zeros(len(bodies), bool), 0
            while at < len(bodies):
                part, size = [], 0
                while at + len(part) < len(bodies) and (size < SHARD_BYTES or not part):
                    part.append(bodies[at + len(part)].encode())
                    size += len(part[-1])
                found, _ = _matches_of(part, test)
                hit[at : at + len(part)] = [bool(m) for m in found]
                at += len(part)
            yield pd.Series(hit)

    return F.pandas_udf(judge, "boolean")


def leak_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
