"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its letters' vectors by
multiplication after shifting each by its place; a text's vector is the sum (bundle) of its n-grams
and a language's prototype the sum of its texts' unit vectors. A text gets the language of the
prototype with the largest cosine.

Training sums one vector per language and task before anything moves; scoring reads each text once
and shuffles nothing. Only the prototypes travel to the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.shared import map_batches, texts_of

DIMENSIONS = 1024
GRAM = 3
LETTERS = 1024  # letter classes; code points beyond share them by remainder
SAMPLE_ROWS = 20_000
SHARPNESS = 30.0
UNDETERMINED = "und"
BLOCK = 2048  # n-grams bound at a time


class Binder:
    """Random letter vectors, each shifted for its place in the n-gram."""

    def __init__(self, dimensions: int, gram: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (LETTERS, dimensions), dtype=np.int8) * 2 - 1
        self.gram, self.dimensions = gram, dimensions
        self.places = [np.roll(letters, gram - 1 - i, axis=1) for i in range(gram)]

    def bundle(self, text: str) -> np.ndarray | None:
        """The sum of the text's n-gram vectors; None without a letter."""
        codes = _letter_codes(text)
        if codes is None:
            return None
        grams = codes[: len(codes) - self.gram + 1].astype(np.int64)
        for i in range(1, self.gram):
            grams = grams * LETTERS + codes[i : len(codes) - self.gram + 1 + i]
        distinct, counts = np.unique(grams, return_counts=True)
        total = np.zeros(self.dimensions, dtype=np.float32)
        for at in range(0, len(distinct), BLOCK):
            part = distinct[at : at + BLOCK]
            bound = self.places[-1][part % LETTERS]
            for place in self.places[-2::-1]:
                part = part // LETTERS
                bound = bound * place[part % LETTERS]
            total += counts[at : at + BLOCK].astype(np.float32) @ bound.astype(np.float32)
        return total


def _letter_codes(text: str) -> np.ndarray | None:
    """Letter classes of the lower-cased text, 0 for each run of other characters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return None
    small = points < 0x250
    letter = np.zeros(len(points), dtype=bool)
    letter[small] = _LATIN[points[small]]
    rest = np.flatnonzero(~small)
    if len(rest):
        kinds, back = np.unique(points[rest], return_inverse=True)
        letter[rest] = np.array([chr(c).isalpha() for c in kinds])[back]
    if not letter.any():
        return None
    codes = np.where(letter, points % (LETTERS - 1) + 1, 0).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap after each word
    return np.concatenate([[0], codes[keep], [0]])


_LATIN = np.array([chr(c).isalpha() for c in range(0x250)])


def train_prototypes(
    labelled: DataFrame,
    dimensions: int = DIMENSIONS,
    gram: int = GRAM,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[str, list[float]]:
    """A unit vector per language from rows ``(doc_id, text, lang)``; rows without either are left out.

    About ``sample_rows`` rows are used, chosen by a hash of their doc_id, which has no other part
    here; the languages themselves are taken from all rows. The result holds one vector per language, whatever the data's size.
    """
    rows = labelled.select(
        F.xxhash64("doc_id").alias("draw"),
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    # an equal share for each language, so that rare ones are learned too
    share = max(1, sample_rows // len(counts))
    limit = F.lit(0.0)
    for lang, count in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(share / count)).otherwise(limit)
    chosen = rows.where(F.pmod("draw", F.lit(1 << 20)) < limit * (1 << 20))

    def sums(batches):
        binder, total = Binder(dimensions, gram), {}
        for batch in batches:
            for text, lang in zip(
                batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            ):
                bundle = binder.bundle(text)
                if bundle is not None and (norm := float(np.linalg.norm(bundle))):
                    total[lang] = total.get(lang, 0) + bundle / norm
        if total:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(total)),
                    pa.array([v.astype(float).tolist() for v in total.values()]),
                ],
                ["lang", "vector"],
            )

    partial = map_batches(chosen, sums, "lang string, vector array<double>")
    each = partial.select("lang", F.posexplode("vector").alias("place", "value"))
    summed = each.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vectors = {}
    by_place = F.array_sort(F.collect_list(F.struct("place", "value"))).alias("values")
    for row in summed.groupBy("lang").agg(by_place).collect():
        vector = np.array([p["value"] for p in row["values"]])
        vectors[row["lang"]] = (vector / (np.linalg.norm(vector) or 1.0)).tolist()
    return vectors


def identify_language(
    docs: DataFrame,
    prototypes: dict[str, list[float]],
    dimensions: int = DIMENSIONS,
    gram: int = GRAM,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``lang_pred``, ``score``, ``cosines``.

    ``score`` is the softmax of the cosines at a fixed sharpness. A null text, or one without a
    letter, is ``und`` with score 0; so is every text if nothing was learned. Equal cosines go to
    the language first in name order. Whole texts are read, however long.
    """
    names = sorted(prototypes)
    table = np.array([prototypes[n] for n in names], dtype=np.float32)

    def predict(batches):
        binder = Binder(dimensions, gram)
        for batch in batches:
            labels, scores, all_cosines = [], [], []
            for body in batch.column("text").to_pylist():
                bundle = binder.bundle(body) if body and names else None
                if bundle is None:
                    labels.append(UNDETERMINED)
                    scores.append(0.0)
                    all_cosines.append([])
                    continue
                cosines = table @ bundle / (float(np.linalg.norm(bundle)) or 1.0)
                best = int(np.argmax(cosines))
                weights = np.exp(SHARPNESS * (cosines - cosines[best]))
                labels.append(names[best])
                scores.append(float(1.0 / weights.sum()))
                all_cosines.append(cosines.astype(float).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(labels, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(all_cosines, pa.list_(pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "cosines"],
            )

    narrow = texts_of(docs, key, text)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, cosines array<double>"
    return map_batches(narrow, predict, schema)
