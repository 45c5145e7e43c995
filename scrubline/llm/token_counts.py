"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded once, as a whole. A byte-level vocabulary gives every token's byte length, so
running sums place each token in the text; byte places become character places by counting the
bytes that start a character. The token spans are then joined to the section spans: a sorted
interval join inside the document, which moves no token anywhere.

Rule for a token that lies in several sections: it goes to the one that holds most of its
characters, and to the earlier one if they hold as many. A token that no section holds is counted
as outside. So the counts of a document add up to its tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.shared import map_batches

SPAN = "array<struct<name:string,start:bigint,stop:bigint>>"


class ByteTokens:
    """Ids and character spans of a text's tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last of each token; a split character counts in all."""
        ids = np.asarray(self.encoding.encode_to_numpy(text), dtype=np.int64)
        ends = np.cumsum(self.lengths[ids])
        if not len(ends):
            return ends, ends
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        begins = ends - self.lengths[ids]
        return character[begins], character[ends - 1] + 1


def attribute(
    first: np.ndarray, stop: np.ndarray, starts: np.ndarray, stops: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of each section, crossing tokens of each section, tokens outside.

    ``starts`` and ``stops`` are the sections' spans, sorted and disjoint; empty ones hold nothing.
    """
    counts, crossing = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    real = np.flatnonzero(stops > starts)
    if not len(real) or not len(first):
        return counts, crossing, len(first)
    a, b = starts[real], stops[real]
    low = np.searchsorted(b, first, side="right")
    high = np.searchsorted(a, stop, side="left") - 1
    inside = low <= high
    low, high, first, stop = low[inside], high[inside], first[inside], stop[inside]
    owner = low.copy()
    for t in np.flatnonzero(high > low):
        held_by = np.arange(low[t], high[t] + 1)
        shares = np.minimum(stop[t], b[held_by]) - np.maximum(first[t], a[held_by])
        owner[t] = held_by[int(np.argmax(shares))]
        crossing[real[owner[t]]] += 1
    alone = high == low
    part = alone & ((first < a[owner]) | (stop > b[owner]))
    np.add.at(crossing, real[owner[part]], 1)
    counts[real] = np.bincount(owner, minlength=len(real))
    return counts, crossing, int((~inside).sum())


def count_tokens(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    sections: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per section: ``doc_id``, ``section``, ``name``, ``start``, ``stop``, ``n_tokens``,
    ``n_crossing``, ``doc_tokens``.

    ``sections`` is an array of ``(name, start, stop)`` in characters, sorted and disjoint; by
    default the text's lines, each with the newline that ends it. ``n_crossing`` counts the section's tokens that reach beyond it.
    Tokens outside every section make a row with section -1, present only if there are any. A null
    text counts as empty; an empty text has one empty line without tokens. Repeated documents each
    give their rows; sections without tokens are listed with 0.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if sections is None:
        sections = F.lit(None).cast(SPAN)
    narrow = docs.select(F.col(key).alias("doc_id"), body.alias("text"), sections.alias("sections"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, section bigint, name string, start bigint, stop bigint, "
        "n_tokens bigint, n_crossing bigint, doc_tokens bigint"
    )

    def count(batches):
        tokens = ByteTokens(ranks_path, pattern)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("row", "section", "name", "start", "stop", "n", "x", "all")}
            given = batch.column("sections").to_pylist()
            for row, (body, spans) in enumerate(zip(batch.column("text").to_pylist(), given)):
                if spans is None:
                    sizes = np.array([len(line) + 1 for line in body.split("\n")], dtype=np.int64)
                    stops = np.cumsum(sizes)
                    starts, names = stops - sizes, [str(k) for k in range(len(sizes))]
                    stops[-1] -= 1  # the last line has no newline
                else:
                    names = [s["name"] for s in spans]
                    starts = np.array([s["start"] for s in spans], dtype=np.int64)
                    stops = np.array([s["stop"] for s in spans], dtype=np.int64)
                first, stop = tokens.spans(body)
                counts, crossing, outside = attribute(first, stop, starts, stops)
                order, labels = list(range(len(names))), list(names)
                columns = [starts.tolist(), stops.tolist(), counts.tolist(), crossing.tolist()]
                if outside:
                    order.append(-1)
                    labels.append(None)
                    for column, value in zip(columns, (None, None, outside, 0)):
                        column.append(value)
                rows["row"] += [row] * len(order)
                rows["section"] += order
                rows["name"] += labels
                for c, column in zip(("start", "stop", "n", "x"), columns):
                    rows[c] += column
                rows["all"] += [len(first)] * len(order)
            whole = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows["row"], whole)),
                    pa.array(rows["section"], whole),
                    pa.array(rows["name"], pa.string()),
                    *[pa.array(rows[c], whole) for c in ("start", "stop", "n", "x", "all")],
                ],
                ["doc_id", "section", "name", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"],
            )

    return map_batches(narrow, count, schema)
