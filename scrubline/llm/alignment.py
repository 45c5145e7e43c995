"""Alignment of two tokenizers over a corpus: shared groups of tokens and how common their links are.

Texts up to ``CHUNK`` bytes are read where they lie, piece by piece, with the groups of recent pieces
remembered. A longer text is cut into byte ranges that different tasks read; each range gives a
fragment (open prefix, closed groups, open suffix), and fragments are composed in a tree, ``FAN`` at
a time, until one is left for the text. A task holds a bounded number of ranges except at the last
levels, where it holds the ids of one text.

The corpus is read twice: once to count in how many documents each pair of ids is linked, with pairs
summed inside each task before they move, once to sum those counts over each document's links. The
counts travel to the tasks for the most common pairs, at most ``PAIRS_MOST``; any others are joined.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.shared import held, map_batches, portions, text_bytes
from scrubline.llm.token_groups import Fragment, TokenPair, compose, fragment, links, token_pair
from scrubline.session import ship_package

CHUNK = 64 << 10
FAN = 8
PAIRS_MOST = 2_000_000
PORTION = 2 << 20
CACHE_BYTES = 160 << 20  # of remembered pieces in a worker
CACHE_ENTRY = 300  # beside a piece's own bytes
PARTIAL = 1 << 20  # pairs that a task sums before it sends them on


def _decoded(raw: bytes | None) -> str | None:
    """The text; one that is not UTF-8 has no tokens, as a null one."""
    try:
        return raw.decode() if raw else None
    except UnicodeDecodeError:
        return None


class _Memory(dict):
    """What was computed for pieces. When it has grown too large, only what the next texts use stays."""

    def __init__(self, pair: TokenPair, fill, moved=None):
        self.pair, self.fill, self.moved, self.size = pair, fill, moved, 0

    def learn(self, texts: list[list[str]]) -> None:
        used = set().union(*texts)
        if self.size > CACHE_BYTES:
            kept = used.intersection(self)
            values = [self[p] for p in kept]
            self.size = self.size * len(kept) // len(self)
            self.clear()
            self.update(zip(kept, self.moved(values) if self.moved else values))
        for encoded in self.pair.encode(list(used.difference(self))):
            values = self.fill(encoded)
            self.update(zip(encoded.pieces, values))
            self.size += sum(map(len, encoded.pieces)) + CACHE_ENTRY * len(encoded.pieces)
            self.size += encoded.a.nbytes * 3


def _pairs_of(encoded) -> list[bytes | None]:
    packed, _, of = links(encoded.a, encoded.b, encoded.n_a, encoded.n_b)
    stops = np.searchsorted(of, encoded.stops)
    raw, begin, out = packed.tobytes(), 0, []
    for stop in (stops * 8).tolist():
        out.append(raw[begin:stop] or None)
        begin = stop
    return out


class _Sums:
    """Counts of pairs in documents, merged portion by portion."""

    def __init__(self):
        self.pairs, self.counts = np.zeros((2, 0), np.int64)

    def add(self, of_documents: list[np.ndarray]) -> None:
        """Adds the distinct pairs of each document."""
        if not of_documents:
            return
        pairs, counts = np.unique(np.concatenate(of_documents), return_counts=True)
        both = np.concatenate([self.pairs, pairs])
        self.pairs, back = np.unique(both, return_inverse=True)
        added = np.concatenate([self.counts, counts])
        self.counts = np.bincount(back, added, minlength=len(self.pairs)).astype(np.int64)

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.pairs), pa.array(self.counts)], ["pair", "n"])
        self.__init__()
        return out


def _short(docs: DataFrame, chunk: int) -> DataFrame:
    return docs.where(f"coalesce(octet_length(body), 0) <= {chunk}")


def _count_short(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def count(batches):
        pair = token_pair(path_a, path_b)
        known, sums = _Memory(pair, _pairs_of), _Sums()
        for batch in portions(batches, "body", PORTION):
            texts = [pair.pieces(_decoded(t)) for t in batch.column("body").to_pylist()]
            known.learn(texts)
            found = []
            for pieces in texts:
                parts = list(map(known.__getitem__, set(pieces)))
                if parts and None not in parts:
                    found.append(np.unique(np.frombuffer(b"".join(parts), np.int64)))
            sums.add(found)
            if len(sums.pairs) > PARTIAL:
                yield sums.take()
        yield sums.take()

    return map_batches(docs.select("body"), count, "pair bigint, n bigint")


class _Counts:
    """The counts sent to the tasks, found by binary search."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.counts, self.best = pairs[order], counts[order], best[order]

    def find(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, whether it is the highest of its A id, whether it is known; 0 where it is not."""
        if not len(self.pairs):
            return (np.zeros(len(packed), np.int64),) * 2 + (np.zeros(len(packed), bool),)
        at = np.minimum(np.searchsorted(self.pairs, packed), len(self.pairs) - 1)
        known = self.pairs[at] == packed
        return self.counts[at] * known, self.best[at] * known, known


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _figures(a, b, n_a, n_b, stops, counts: _Counts):
    """The figures of each run of groups up to the stops, and its pairs that the counts do not hold."""
    packed, times, of = links(a, b, n_a, n_b)
    found, best, known = counts.find(packed)
    per_link = np.stack([times, times * best, times * found])
    run_of_group = np.searchsorted(stops, np.arange(len(n_a)), side="right")
    out = np.zeros((len(stops), len(FIGURES)), np.int64)
    for column, values in enumerate((n_a, n_b, np.ones(len(n_a), np.int64))):
        np.add.at(out[:, column], run_of_group, values)
    run = run_of_group[of]
    for column, values in enumerate(per_link, start=3):
        np.add.at(out[:, column], run, values)
    rest = np.flatnonzero(~known)
    return out, run[rest], packed[rest], times[rest]


def _measure_short(docs, path_a, path_b, counts, schema: str, with_groups: bool) -> DataFrame:
    def measure(batches):
        pair, numbers, lists, rare = token_pair(path_a, path_b), [], [], {}

        def fill(encoded):
            figures, run, packed, times = _figures(
                encoded.a, encoded.b, encoded.n_a, encoded.n_b, encoded.stops, counts.value
            )
            first = len(lists)
            lists.extend(pair.listed(encoded.a, encoded.b, encoded.n_a, encoded.n_b, encoded.stops))
            if len(run):
                cold = np.searchsorted(run, np.arange(len(encoded.stops) + 1))
                for k in range(len(encoded.stops)):
                    some = slice(cold[k], cold[k + 1])
                    rare[first + k] = packed[some], times[some]
            numbers.append(figures)
            return range(first, len(lists))

        def moved(kept):
            """The lists rid of all but some entries, which get new places in their order."""
            numbers[:] = [np.concatenate(numbers)[kept]]
            lists[:] = [lists[k] for k in kept]
            cold = {new: rare[old] for new, old in enumerate(kept) if old in rare} if rare else {}
            rare.clear()
            rare.update(cold)
            return range(len(kept))

        known = _Memory(pair, fill, moved)
        for batch in portions(batches, "body", PORTION):
            texts = [pair.pieces(_decoded(t)) for t in batch.column("body").to_pylist()]
            known.learn(texts)
            table = np.concatenate(numbers) if numbers else np.zeros((0, len(FIGURES)), np.int64)
            numbers[:] = [table]
            rows = []
            for pieces in texts:
                at = list(map(known.__getitem__, pieces))
                figures = table.take(np.array(at, np.int64), axis=0)
                if not at or not figures[:, 0].all():
                    rows.append((np.zeros(len(FIGURES), np.int64), None, []))
                    continue
                parts = [rare[k] for k in at if k in rare] if rare else []
                rows.append((figures.sum(0), b";".join(map(lists.__getitem__, at)), parts))
            yield _result(batch, rows, with_groups, schema)

    return map_batches(docs, measure, schema)


def _result(batch, rows, with_groups: bool, schema: str) -> pa.RecordBatch:
    """Rows of figures, groups as text, and uncounted pairs next to the batch's own columns."""
    columns = {c: batch.column(c) for c in batch.schema.names if c in ("doc_id", "row")}
    figures = np.stack([r[0] for r in rows]) if rows else np.zeros((0, len(FIGURES)), np.int64)
    for k, name in enumerate(FIGURES):
        columns[name] = pa.array(figures[:, k])
    columns["groups_sha256"] = pa.array(
        ["" if r[1] is None else hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()
    )
    if with_groups:
        columns["groups"] = pa.array(["" if r[1] is None else r[1].decode() for r in rows], pa.string())
    if "rare" in schema:
        kind = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
        listed = []
        for _, _, parts in rows:
            pairs = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int64)
            times = np.concatenate([t for _, t in parts]) if parts else np.zeros(0, np.int64)
            distinct, back = np.unique(pairs, return_inverse=True)
            summed = np.bincount(back, times, minlength=len(distinct)).astype(np.int64)
            listed.append([{"pair": p, "times": t} for p, t in zip(distinct.tolist(), summed.tolist())])
        columns["rare"] = pa.array(listed, kind)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


# --- long texts: byte ranges, fragments, a tree --------------------------------------------------


def byte_ranges(pair: TokenPair, text: str, size: int) -> list[tuple[str, int, int]]:
    """``(stretch, skip, take)`` for ranges of about ``size`` bytes of a space and the text.

    A stretch is the pieces that the range touches; the tokens that end in the ``take`` bytes after
    its first ``skip`` are the range's. Borders are multiples of ``size``, but only the first of
    those inside one piece counts, so that no piece is read more than twice.
    """
    pieces = pair.pieces(text)
    stops = np.cumsum([len(p.encode()) + 1 for p in pieces])
    starts = np.concatenate([[0], stops[:-1]])
    borders = np.arange(size, int(stops[-1]), size)
    _, first = np.unique(np.searchsorted(stops, borders, side="left"), return_index=True)
    borders = [0, *borders[first].tolist(), int(stops[-1])]
    out = []
    for low, high in zip(borders, borders[1:]):
        begin = int(np.searchsorted(stops, low, side="right"))
        end = int(np.searchsorted(stops, high, side="left")) + 1
        out.append((" ".join(pieces[begin:end]), low - int(starts[begin]), high - low))
    return out


def _range_fragment(pair: TokenPair, stretch: str, skip: int, take: int) -> Fragment | None:
    """The fragment of a range; None if its bytes do not come back."""
    sides = [[], []], [[], []]
    at, known = 0, {}
    pieces = pair.pieces(stretch)
    for encoded in pair.encode(sorted(set(pieces))):
        begin = 0
        group_a, group_b = (np.concatenate([[0], np.cumsum(n)]) for n in (encoded.n_a, encoded.n_b))
        for piece, stop in zip(encoded.pieces, encoded.stops.tolist()):
            known[piece] = (
                encoded.a[group_a[begin] : group_a[stop]], encoded.b[group_b[begin] : group_b[stop]]
            )
            begin = stop
    for piece in pieces:
        found = known[piece]
        if not len(found[0]):
            return None
        for (ids, ends), some, lengths in zip(sides, found, (pair.lengths_a, pair.lengths_b)):
            ids.append(some)
            ends.append(np.cumsum(lengths[some]) + at)
        at += len(piece.encode()) + 1
    tokens = []
    for ids, ends in sides:
        ids, ends = np.concatenate(ids), np.concatenate(ends)
        inside = (ends > skip) & (ends <= skip + take)
        tokens += [ids[inside], ends[inside]]
    return fragment(*tokens)


FRAGMENT = "a binary, b binary, n_a binary, n_b binary, ok boolean"


def _packed(parts: list[Fragment | None]) -> list[pa.Array]:
    columns = []
    for field in Fragment._fields:
        kind = "<u4"
        columns.append(
            pa.array(
                [None if p is None else zlib.compress(getattr(p, field).astype(kind).tobytes(), 1) for p in parts],
                pa.binary(),
            )
        )
    return [*columns, pa.array([p is not None for p in parts], pa.bool_())]


def _unpacked(row: dict) -> Fragment | None:
    if not row["ok"]:
        return None
    return Fragment(
        *(np.frombuffer(zlib.decompress(row[f]), "<u4").astype(np.int64) for f in Fragment._fields)
    )


def long_texts(docs: DataFrame, path_a: str, path_b: str, chunk: int, fan: int) -> DataFrame:
    """``(row, doc_id, a, b, n_a, n_b, ok)``: the whole fragment of each text of over ``chunk`` bytes.

    ``docs`` has ``doc_id`` and ``body``; ``ok`` is false where the bytes do not come back.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        pair = token_pair(path_a, path_b)
        for batch in portions(batches, "body", PORTION):
            for k, raw in enumerate(batch.column("body").to_pylist()):
                text = _decoded(raw)
                parts = [("", 0, 0)] if text is None else byte_ranges(pair, text, chunk)
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(k, 1).take(pa.array([0] * n)),
                        batch.column("doc_id").slice(k, 1).take(pa.array([0] * n)),
                        pa.array(range(n), pa.int64()),
                        pa.array([p[0].encode() for p in parts], pa.binary()),
                        pa.array([p[1] for p in parts], pa.int64()),
                        pa.array([p[2] for p in parts], pa.int64()),
                    ],
                    ["row", "doc_id", "place", "body", "skip", "take"],
                )

    def read(batches):
        pair = token_pair(path_a, path_b)
        for batch in portions(batches, "body", PORTION):
            parts = [
                _range_fragment(pair, r["body"].decode(), r["skip"], r["take"]) if r["body"] else None
                for r in batch.select(["body", "skip", "take"]).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "doc_id", "place")] + _packed(parts),
                ["row", "doc_id", "place", "a", "b", "n_a", "n_b", "ok"],
            )

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        parts = [_unpacked(r) for r in rows]
        whole = None if None in parts else compose(parts)
        names = ["row", "doc_id", "place", "a", "b", "n_a", "n_b", "ok"]
        ids = [table.column(c).slice(0, 1).combine_chunks() for c in ("row", "doc_id")]
        return pa.table(
            [*ids, pa.array([rows[0]["place"] // fan], pa.int64()), *_packed([whole])], names=names
        )

    numbered = docs.where(f"octet_length(body) > {chunk}").withColumn(
        "row", F.monotonically_increasing_id()
    )
    ids = f"row bigint, doc_id {kind}, place bigint, "
    ranges = map_batches(numbered, cut, ids + "body binary, skip bigint, take bigint")
    ranges = held(ranges, "ranges")
    parts = map_batches(ranges.repartition("row", "place"), read, ids + FRAGMENT)
    most = ranges.agg(F.max("place")).first()[0] or 0
    ship_package(docs.sparkSession)
    while most > 0:  # one level of the tree: fan neighbours of a text become one
        near = parts.groupBy("row", "doc_id", F.expr(f"place div {fan}").alias("parent"))
        parts = near.applyInArrow(lambda table: join(table), ids + FRAGMENT)
        most //= fan
    return held(parts.drop("place"), "fragments")


def _count_long(whole: DataFrame) -> DataFrame:
    def count(batches):
        sums = _Sums()
        for batch in portions(batches, "a", PORTION):
            for row in batch.to_pylist():
                if row["ok"]:
                    found = _unpacked(row)
                    sums.add([np.unique(links(found.a, found.b, *found.groups())[0])])
            yield sums.take()

    return map_batches(whole.select("a", "b", "n_a", "n_b", "ok"), count, "pair bigint, n bigint")


def _measure_long(whole, path_a, path_b, counts, schema: str, with_groups: bool) -> DataFrame:
    def measure(batches):
        pair = token_pair(path_a, path_b)
        for batch in portions(batches, "a", PORTION):
            rows = []
            for row in batch.select(["a", "b", "n_a", "n_b", "ok"]).to_pylist():
                if not row["ok"]:
                    rows.append((np.zeros(len(FIGURES), np.int64), None, []))
                    continue
                found = _unpacked(row)
                n_a, n_b = found.groups()
                stops = np.array([len(n_a)])
                figures, _, packed, times = _figures(found.a, found.b, n_a, n_b, stops, counts.value)
                listed = pair.listed(found.a, found.b, n_a, n_b, stops)[0]
                rows.append((figures[0], listed, [(packed, times)]))
            yield _result(batch, rows, with_groups, schema)

    return map_batches(whole, measure, schema)


# --- the corpus ----------------------------------------------------------------------------------


def _common(rated: DataFrame, most: int) -> tuple[int, DataFrame]:
    """The least class of counts to send and the pairs of at least that class: at most ``most``.

    Classes are powers of two, so a few dozen numbers say how many pairs each would add.
    """
    sizes = rated.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("class").desc())
    taken, least = 0, 65
    for row in sizes.collect():
        if taken + row["n"] > most:
            break
        taken, least = taken + row["n"], row["class"]
    return least, rated.where(F.col("class") >= least)


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    key: str = "doc_id",
    text: str = "text",
    with_groups: bool = False,
    chunk: int = CHUNK,
    fan: int = FAN,
    most_pairs: int = PAIRS_MOST,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256`` and, if asked for, ``groups``.

    ``groups`` lists each group as the decimal ids of A, a bar, those of B, groups parted by
    semicolons. A link is a pair of tokens that share a group; its count is the number of documents
    that link its two ids. ``n_best`` counts links whose count is the highest of their A id, ties
    included; ``count_sum`` adds the counts of all links. A null or empty text, one that is not
    UTF-8 and one that either tokenizer does not give back byte by byte has no tokens: all figures
    are 0 and both strings are empty. Every row counts as a document of its own, whatever its id:
    null ids, repeated ids and repeated rows are told apart by their rows. Whole texts are read,
    however long. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(key).alias("doc_id"), text_bytes(F.col(text).cast("string")).alias("body")
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    short, whole = _short(narrow, chunk), long_texts(narrow, path_a, path_b, chunk, fan)

    linked = _count_short(short, path_a, path_b).union(_count_long(whole))
    counted = linked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counted = held(counted, "pairs")
    highest = counted.groupBy("a").agg(F.max("n").alias("highest"))
    rated = counted.join(highest, "a").select(
        "pair", "n", (F.col("n") == F.col("highest")).alias("best"),
        F.floor(F.log2("n")).cast("int").alias("class"),
    )
    rated = held(rated, "rated")
    least, common = _common(rated, most_pairs)
    sent = common.select("pair", "n", "best").toArrow()
    counts = spark.sparkContext.broadcast(
        _Counts(*(sent.column(c).to_numpy() for c in ("pair", "n")), sent.column("best").to_numpy().astype(np.int64))
    )
    cold = rated.where(F.col("class") < least)
    all_sent = cold.isEmpty()

    schema = f"doc_id {kind}, " + "".join(f"{f} bigint, " for f in FIGURES) + "groups_sha256 string"
    schema += ", groups string" if with_groups else ""
    if all_sent:
        measured = _measure_short(short, path_a, path_b, counts, schema, with_groups)
        return measured.union(_measure_long(whole.drop("row"), path_a, path_b, counts, schema, with_groups))

    schema += ", rare array<struct<pair:bigint,times:bigint>>"
    measured = _measure_short(short, path_a, path_b, counts, schema, with_groups).union(
        _measure_long(whole.drop("row"), path_a, path_b, counts, schema, with_groups)
    )
    measured = held(measured.withColumn("row", F.monotonically_increasing_id()), "measured")
    # every pair left has a count below 2^least, so no key of this join is in many documents
    each = measured.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times")
    added = each.join(cold, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_count"),
    )
    done = measured.drop("rare").join(added, "row", "left")
    for column, more in (("n_best", "more_best"), ("count_sum", "more_count")):
        done = done.withColumn(column, F.col(column) + F.coalesce(more, F.lit(0)))
    return done.drop("row", "more_best", "more_count")
