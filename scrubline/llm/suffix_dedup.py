"""Repeated passages removed with suffix arrays, by deep-shallow sorting.

A byte goes if a string of ``LENGTH`` bytes around it also starts earlier (in a smaller document, or
earlier in the same one).

Anchors. Sorting every suffix of the corpus is not needed: of the ``LENGTH - GRAM + 1`` grams of a
string the one with the least fingerprint is its anchor. Equal strings have equal anchors at the same
place, so strings are compared with those of equally fingerprinted anchors only. The strings that
share an anchor's position form its context, about one context for every 35 bytes.

Copies. Of equal contexts the first stays and the others go entirely. Inside a task this is done
before anything is shuffled, so a passage that a third of all documents share is one row per task.

Suffix arrays. First contexts with the same anchor but different surroundings are sorted twice,
by the bytes after the anchor and by those before it read backwards: suffix arrays of the anchored
positions. Within each, strings that agree in the bytes a window needs are neighbours, an interval
of the array whose common prefixes are long enough. Two windows are equal if they fall into the same
interval of both arrays.

An anchor with more than ``HOT`` different contexts is dealt out window by window, so no task gets a
group that grows with the corpus.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.shared import held, map_batches, partitions, text_bytes, texts_of
from scrubline.llm.shingles import blocks, mixed, prefix_sums
from scrubline.llm.suffix_sort import deep_shallow_order, neighbour_prefixes

LENGTH = 100
GRAM = 32
HOT = 50_000
AT_ONCE = 100_000
BROADCAST_IDS = 1_000_000
RECORD = np.dtype(
    [("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("at", "<u4"), ("low", "u1"), ("high", "u1")]
)
PLACE_BITS = 20


def anchors(raw: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Contexts of a run of texts: anchor place, gram, context, windows' first and last start.

    ``ends`` are the texts' ends in ``raw``. Windows do not cross texts.
    """
    spread = length - gram + 1
    if len(raw) < length:
        return None
    sums, down = prefix_sums(raw)
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    # leftmost least gram: the place breaks ties, and moves along with the text
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= spread:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    if spread > reach:
        keys = np.minimum(keys[: len(keys) - (spread - reach)], keys[spread - reach :])
    starts = np.concatenate([[0], ends[:-1]])
    opened = np.zeros(len(raw) + 1, dtype=np.int64)
    fits = ends - starts >= length
    np.add.at(opened, starts[fits], 1)
    np.add.at(opened, ends[fits] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(opened)[: len(keys)])
    if not len(valid):
        return None
    place = (keys[valid] & low).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)])
    firsts = np.flatnonzero(new)
    first = valid[firsts]
    last = valid[np.append(firsts[1:], len(valid)) - 1]
    at = place[firsts]
    context = mixed(
        (sums[last + length] - sums[first]) * down[first]
        + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    )
    return at, grams[at], context, first, last


def _records(ids: list[int], tags: list[int], bodies: list[bytes], length: int, gram: int) -> np.ndarray:
    """One record for every context of the texts."""
    made, done = [], 0
    for block in blocks(bodies):
        for part, shift in _pieces(block, length):
            ends = np.cumsum([len(b) for b in part])
            raw = np.frombuffer(b"".join(part), dtype=np.uint8)
            found = anchors(raw, ends, length, gram)
            if found is None:
                continue
            at, grams, context, first, last = found
            owner = np.searchsorted(ends, first, side="right")
            base = np.concatenate([[0], ends[:-1]])[owner]
            record = np.empty(len(at), dtype=RECORD)
            record["gram"], record["context"] = grams, context
            number = owner + done
            record["doc"] = np.array(ids, dtype=np.int64)[number]
            record["tag"] = np.array(tags, dtype=np.uint32)[number]
            record["at"] = at - base + shift
            record["low"], record["high"] = at - last, at - first
            made.append(record)
        done += len(block)
    return np.concatenate(made) if made else np.empty(0, dtype=RECORD)


def _pieces(block: list[bytes], length: int):
    """A long text alone in overlapping pieces, so that places fit their bits."""
    most = 1 << (PLACE_BITS - 1)
    if len(block) > 1 or len(block[0]) <= most:
        yield block, 0
        return
    text = block[0]
    for at in range(0, len(text), most):
        # the overlap has every window that starts in this piece, and no more
        yield [text[at : at + most + length - 1]], at


def _copies(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first record of every context, and the others, ordered by gram and context."""
    order = np.lexsort(
        (records["at"], records["tag"], records["doc"], records["context"], records["gram"])
    )
    records = records[order]
    new = np.ones(len(records), dtype=bool)
    new[1:] = (records["gram"][1:] != records["gram"][:-1]) | (
        records["context"][1:] != records["context"][:-1]
    )
    first = records[new][np.cumsum(new) - 1]
    # a repeated row of the same document at the same place is not a later one
    later = ~new & (
        (records["doc"] != first["doc"]) | (records["tag"] != first["tag"]) | (records["at"] != first["at"])
    )
    return records[new], records[later]


def _spans(records: np.ndarray, length: int, low=None, high=None) -> pa.RecordBatch:
    """Removed stretches of the records' windows, joined where they touch, by document."""
    low = records["low"] if low is None else low
    high = records["high"] if high is None else high
    start = records["at"].astype(np.int64) - high
    stop = records["at"].astype(np.int64) - low + length
    order = np.lexsort((start, records["tag"], records["doc"]))
    doc, tag, start, stop = records["doc"][order], records["tag"][order], start[order], stop[order]
    names = ["kind", "bucket", "doc_id", "tag", "blob"]
    rows, bounds = [], np.flatnonzero(
        np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), [True]])
    ) if len(doc) else []
    for a, b in zip(bounds[:-1], bounds[1:]):
        s, e = joined(start[a:b], stop[a:b])
        rows.append((int(doc[a]), int(tag[a]), np.concatenate([s, e]).astype("<i8").tobytes()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([1] * len(rows), pa.int32()),
            pa.array([hash_bucket(r[0]) for r in rows], pa.int32()),
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.binary()),
        ],
        names,
    )


def hash_bucket(number: int) -> int:
    return (number * 0x9E3779B1) & 0x7FFFFFFF


def joined(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches sorted by start, as maximal ones."""
    if not len(start):
        return start, stop
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:], len(start)) - 1]


SCHEMA = "kind int, bucket int, doc_id bigint, tag bigint, blob binary"


def _packed(records: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Records by bucket of their gram."""
    bucket = (records["gram"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
    numbers = [int(bucket[a]) for a in edges[:-1]]
    blobs = [records[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
    empty = pa.nulls(len(numbers), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([0] * len(numbers), pa.int32()),
            pa.array(numbers, pa.int32()),
            empty,
            empty,
            pa.array(blobs, pa.binary()),
        ],
        ["kind", "bucket", "doc_id", "tag", "blob"],
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(doc_id, tag, blob)``: removed stretches; several rows per document, which may overlap.

    ``docs`` has ``doc_id`` (bigint), ``tag`` (the text's crc32) and ``body`` (bytes).
    """
    buckets = partitions(docs.sparkSession) * 4

    def scan(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "tag", "body")]
            at = 0
            while at < len(columns[0]):
                begin, size = at, 0
                while at < len(columns[0]) and size < 8 << 20:
                    size += len(columns[2][at])
                    at += 1
                records = _records(*[c[begin:at] for c in columns], length, gram)
                if len(records):
                    first, later = _copies(records)
                    yield _packed(first, buckets)
                    yield _spans(later, length)

    def settle(batches):
        blobs = []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            yield batch.filter(pa.array(kinds == 1))
            blobs += batch.filter(pa.array(kinds == 0)).column("blob").to_pylist()
        if not blobs:
            return
        records = np.frombuffer(b"".join(blobs), dtype=RECORD)
        blobs.clear()
        first, later = _copies(records)
        yield _spans(later, length)
        same = first["gram"][1:] == first["gram"][:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        chosen = first[several]
        order = np.lexsort((chosen["at"], chosen["tag"], chosen["doc"]))
        yield _by_document(chosen[order])

    # one row per block and bucket, so the exchange moves packed records
    moved = map_batches(docs, scan, SCHEMA).repartition(partitions(docs.sparkSession), "bucket")
    settled = held(map_batches(moved, settle, SCHEMA), "anchors")
    spans = settled.where("kind = 1").select("doc_id", "tag", "blob")
    asked = settled.where("kind = 2").select("doc_id", "tag", "blob")
    contexts = held(_contexts(docs, asked, length, gram), "contexts")
    return spans.unionByName(_sorted_spans(contexts, length, gram, hot))


def _by_document(records: np.ndarray) -> pa.RecordBatch:
    names = ["kind", "bucket", "doc_id", "tag", "blob"]
    new = np.ones(len(records) + 1, dtype=bool)
    new[1:-1] = (records["doc"][1:] != records["doc"][:-1]) | (records["tag"][1:] != records["tag"][:-1])
    bounds = np.flatnonzero(new) if len(records) else np.array([0])
    heads = records[bounds[:-1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([2] * len(heads), pa.int32()),
            pa.array([0] * len(heads), pa.int32()),
            pa.array(heads["doc"]),
            pa.array(heads["tag"].astype(np.int64)),
            pa.array([records[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
        ],
        names,
    )


CONTEXT = (
    "gram bigint, doc_id bigint, tag bigint, at bigint, low int, high int, before binary, after binary"
)


def _contexts(docs: DataFrame, asked: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around the asked anchors: before it (read backwards) and after its gram."""
    around = length - gram
    wanted = asked.select(F.col("doc_id").alias("wanted")).distinct()
    wanted = held(wanted, "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, docs["doc_id"] == wanted["wanted"], "left_semi").dropDuplicates(["doc_id", "tag"])
    lists = asked.groupBy("doc_id", "tag").agg(F.collect_list("blob").alias("blobs"))
    both = texts.join(lists, ["doc_id", "tag"])

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("gram", "doc", "tag", "at", "low", "high", "before", "after")}
            for body, parts in zip(batch.column("body").to_pylist(), batch.column("blobs").to_pylist()):
                records = np.frombuffer(b"".join(parts), dtype=RECORD)
                for r in ("doc", "tag", "at", "low", "high"):
                    out[r].append(records[r])
                out["gram"].append(records["gram"].view(np.int64))
                padded = bytes(around) + body + bytes(length)
                for at in records["at"].tolist():
                    out["before"].append(padded[at : at + around][::-1])
                    out["after"].append(padded[at + length : at + length + around])
            join = lambda c, kind: pa.array(np.concatenate(out[c]).astype(kind) if out[c] else np.empty(0, kind))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    join("gram", np.int64),
                    join("doc", np.int64),
                    join("tag", np.int64),
                    join("at", np.int64),
                    join("low", np.int32),
                    join("high", np.int32),
                    pa.array(out["before"], pa.binary()),
                    pa.array(out["after"], pa.binary()),
                ],
                ["gram", "doc_id", "tag", "at", "low", "high", "before", "after"],
            )

    return map_batches(both.select("body", "blobs"), cut, CONTEXT)


def _sorted_spans(contexts: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """Removed stretches of contexts that share an anchor but differ."""
    sizes = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    large = held(sizes.select(F.col("gram").alias("large")), "hot")
    parts = partitions(contexts.sparkSession)
    own = contexts.withColumn("single", F.lit(False))
    if not large.isEmpty():
        around = length - gram
        divided = contexts.join(large, contexts["gram"] == large["large"], "left_semi")
        each = divided.withColumn("x", F.explode(F.sequence("low", "high")))
        key = F.xxhash64(
            "gram", "x", F.expr("substring(before, 1, x)"), F.expr(f"substring(after, 1, {around} - x)")
        )
        windows = each.withColumns({"gram": key, "low": F.col("x"), "high": F.col("x"), "single": F.lit(True)})
        own = own.join(large, own["gram"] == large["large"], "left_anti").unionByName(windows.drop("x"))
    ordered = own.repartition(parts, "gram").sortWithinPartitions("gram", "doc_id", "tag", "at")

    def search(batches):
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= AT_ONCE:
                table = pa.Table.from_batches(kept).combine_chunks()
                names = table.column("gram").to_numpy()
                # whole groups only; the last one may go on
                split = int(np.searchsorted(names, names[-1]))
                lone = bool(table.column("single")[-1].as_py())
                if split:
                    yield _removed(table.slice(0, split), length, gram)
                    kept = table.slice(split).to_batches()
                    rows = table.num_rows - split
                elif lone:  # equal windows: the first one decides about all others
                    yield _removed(table, length, gram)
                    kept, rows = table.slice(0, 1).to_batches(), 1
        if kept:
            yield _removed(pa.Table.from_batches(kept).combine_chunks(), length, gram)

    found = map_batches(ordered, search, SCHEMA)
    return found.select("doc_id", "tag", "blob")


def _removed(table: pa.Table, length: int, gram: int) -> pa.RecordBatch:
    """Windows of the contexts that an earlier context of the group has too.

    The rows of a group come in document order, so the first row of a class is the earliest.
    """
    around = length - gram
    column = lambda c: table.column(c).to_numpy()
    matrix = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(-1, around)
    group = column("gram")
    low, high = column("low").astype(np.int64), column("high").astype(np.int64)
    intervals = []
    for side in ("after", "before"):
        rows = matrix(side)
        order = deep_shallow_order(group, rows)
        intervals.append((order, neighbour_prefixes(order, group, rows)))
    records = np.zeros(len(group), dtype=RECORD)
    records["doc"], records["tag"], records["at"] = column("doc_id"), column("tag"), column("at")
    found, at_x = [], []
    for x in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        members = np.flatnonzero((low <= x) & (x <= high))
        if len(members) < 2:
            continue
        classes = []
        for (order, lcp), need in zip(intervals, (around - x, x)):
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.cumsum(lcp < need)
            classes.append(number[members])
        both = classes[0] * (len(group) + 1) + classes[1]
        _, first, back = np.unique(both, return_index=True, return_inverse=True)
        earliest = members[first[back]]
        same = (
            (records["doc"][members] == records["doc"][earliest])
            & (records["tag"][members] == records["tag"][earliest])
            & (records["at"][members] == records["at"][earliest])
        )
        gone = members[~same]
        found.append(gone)
        at_x.append(np.full(len(gone), x))
    chosen = np.concatenate(found) if found else np.empty(0, np.int64)
    x = np.concatenate(at_x) if at_x else chosen
    return _spans(records[chosen], length, x, x)


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans``, ``kept``.

    ``spans`` are the removed stretches (start and stop in bytes), ``kept`` the remaining bytes. Null
    and empty texts have no bytes. Rows that repeat a document (id and text) are the same document
    and treated alike. Documents that share an id are ordered by their texts' crc32. A null id comes
    before all others. Ids are whole numbers.
    """
    narrow = texts_of(docs, key, text).select(
        "doc_id", text_bytes(F.col("text")).alias("body")
    )
    least = F.lit(-(1 << 63))
    rows = narrow.select(
        F.coalesce(F.col("doc_id").cast("bigint"), least).alias("doc_id"),
        F.crc32("body").alias("tag"),
        "body",
    )
    spans = repeated_spans(rows.where(F.length("body") >= length), length, gram, hot)
    gathered = spans.groupBy("doc_id", "tag").agg(F.collect_list("blob").alias("blobs"))
    both = rows.join(gathered, ["doc_id", "tag"], "left")

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", "gone", "count", "spans", "kept")}
            for body, blobs in zip(batch.column("body").to_pylist(), batch.column("blobs").to_pylist()):
                parts = [np.frombuffer(b, "<i8").reshape(2, -1) for b in blobs or ()]
                both_ends = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int64)
                order = np.argsort(both_ends[0], kind="stable")
                start, stop = joined(both_ends[0][order], both_ends[1][order])
                edges = [0, *np.column_stack([start, stop]).ravel().tolist(), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                out["n"].append(len(body))
                out["gone"].append(len(body) - len(kept))
                out["count"].append(len(start))
                out["spans"].append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist())])
                out["kept"].append(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(out[c], pa.int64()) for c in ("n", "gone", "count")],
                    pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array(out["kept"], pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    schema = (
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
        "spans array<struct<start:bigint,stop:bigint>>, kept binary"
    )
    done = map_batches(both, cut, schema)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
