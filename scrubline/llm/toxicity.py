"""Toxicity by compression distance.

Two zstandard dictionaries are learned, one of ordinary and one of toxic text. A text is cut into
windows; each is compressed with either dictionary, and what the toxic one saves is the window's
gain. How many windows reach each of several gains, in number and as a share, is calibrated to a
score on labelled texts whose own fold had no part in the dictionaries.

Words enter the windows and the dictionaries as fixed-width codes (one of the word's start, one of
the whole word), so a match means a whole word or stem. The two dictionaries share the commonest
words. The toxic one also holds the codes that toxic texts use far more often than ordinary ones,
which is what tells the two apart: dictionaries that the stock trainer draws from raw windows
hardly differ, since toxic texts are mostly ordinary words.

Only the model (a few kilobytes) and counts of a bounded sample of labelled rows reach the driver.
"""

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.shared import held, map_batches, texts_of
from scrubline.session import ship_package

WORD = re.compile(r"[^\W\d_]+")
CODE = 12
STEM = 4
WINDOW = 8
LEVEL = 1
COMMON_CODES = 42
TOXIC_CODES = 340
LEAST_TEXTS = 3
CONTRAST = 6.0
SIGNIFICANCE = 3.0
SAMPLE_ROWS = 20_000
GAINS = tuple(range(1, 13))
CACHE = 200_000


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=CODE).digest()


class Coder(dict):
    """Word -> code of its start and code of the whole; emptied when full."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = code = _digest("<" + word[:STEM]) + _digest(word)
        return code

    def words(self, text: str | None) -> list[bytes]:
        return list(map(self.__getitem__, WORD.findall((text or "").lower())))


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionary contents and the calibration; ``weights`` is None if one class is missing."""

    common: bytes
    toxic: bytes
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...] | None
    base: float


class Gauge:
    """The gain of every window of a text."""

    def __init__(self, common: bytes, toxic: bytes):
        self.coder = Coder()
        self.ordinary = self._compressor(common)
        self.toxic = self._compressor(common + toxic)

    @staticmethod
    def _compressor(content: bytes):
        import zstandard

        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not content:
            return zstandard.ZstdCompressor(level=LEVEL, **plain)
        shared = zstandard.ZstdCompressionDict(
            content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        shared.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, **plain)

    def gains(self, text: str | None) -> np.ndarray:
        words = self.coder.words(text)
        plain, toxic = self.ordinary.compress, self.toxic.compress
        found = []
        for at in range(0, len(words), WINDOW):
            window = b"".join(words[at : at + WINDOW])
            found.append(len(plain(window)) - len(toxic(window)))
        return np.array(found or [0])


def features(gains: np.ndarray) -> list[float]:
    """Windows at or above each gain, in number and share, and the total gain per window."""
    reach = [int((gains >= g).sum()) for g in GAINS]
    total = float(gains[gains > 0].sum())
    return [
        *[float(np.log1p(n)) for n in reach],
        *[float(np.sqrt(n / len(gains))) for n in reach],
        float(np.log1p(total)),
        float(np.sqrt(total / len(gains))),
    ]


def sample_labelled(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` of the labelled ids, by a hash of the id; each id once, in one of two halves.

    A doc_id labelled several times is toxic if any label says so. Null ids or labels are left out.
    """
    known = labelled.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null"
    )
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    return known.where(draw < share * (1 << 20)).withColumn(
        "half", F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)).cast("int")
    )


def train(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from ``labelled`` (``doc_id``, ``toxic`` 0/1) and the texts of those documents.

    Not more than about ``rows`` labelled rows are used. Without any label the score is 0; with one
    class only it is that class's.
    """
    chosen = sample_labelled(labelled, rows)  # bounded by ``rows``, hence the broadcast
    texts = held(texts_of(docs).join(F.broadcast(chosen), "doc_id"), "labelled")
    sizes = {(r["half"], r["toxic"]): r["count"] for r in texts.groupBy("half", "toxic").count().collect()}
    toxic = sum(n for (_, t), n in sizes.items() if t)
    ordinary = sum(sizes.values()) - toxic
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", (), (), None, 1.0 if toxic else 0.0)
    counts = held(_code_counts(texts), "codes")
    final = _contents(counts, None, toxic, ordinary)
    folds = {}
    for half in (0, 1):
        t, o = sizes.get((1 - half, 1), 0), sizes.get((1 - half, 0), 0)
        folds[half] = _contents(counts, 1 - half, t, o) if t and o else final
    rows_seen = _feature_rows(texts, folds)
    x = np.array([r["features"] for r in rows_seen], dtype=float)
    y = np.array([r["toxic"] for r in rows_seen], dtype=float)
    means, scales = x.mean(0), x.std(0) + 1e-6
    weights = fit_logistic((x - means) / scales, y)
    return ToxicityModel(
        *final, tuple(means.tolist()), tuple(scales.tolist()), tuple(weights.tolist()), 0.0
    )


def _code_counts(texts: DataFrame) -> DataFrame:
    """In how many sampled texts of each half and class a code occurs; rare codes are dropped."""

    def count(batches):
        coder = Coder()
        for batch in batches:
            found = Counter()
            for text, half, toxic in zip(
                *(batch.column(c).to_pylist() for c in ("text", "half", "toxic"))
            ):
                codes = set()
                for word in coder.words(text):
                    codes.add(word[:CODE])
                    codes.add(word[CODE:])
                found.update((code, half, toxic) for code in codes)
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.binary()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.int32()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                ["code", "half", "toxic", "n"],
            )

    narrow = texts.select("text", "half", "toxic")
    each = map_batches(narrow, count, "code binary, half int, toxic int, n bigint")
    is_toxic, n = F.col("toxic") == 1, F.col("n")
    sums = [
        F.sum(F.when(is_toxic == F.lit(bool(t)), F.when(F.col("half") == h, n)).otherwise(None)).alias(f"{name}{h}")
        for t, name in ((1, "toxic"), (0, "plain"))
        for h in (0, 1)
    ]
    summed = each.groupBy("code").agg(*sums).na.fill(0)
    seen = F.col("toxic0") + F.col("toxic1") + F.col("plain0") + F.col("plain1")
    return summed.where(seen >= LEAST_TEXTS)


def _contents(counts: DataFrame, half: int | None, toxic: int, ordinary: int) -> tuple[bytes, bytes]:
    """The commonest codes, and those that toxic texts use far more often; best ones last."""
    halves = (0, 1) if half is None else (half,)
    t = sum((F.col(f"toxic{h}") for h in halves), F.lit(0))
    p = sum((F.col(f"plain{h}") for h in halves), F.lit(0))
    expected = (p + 0.5) * (toxic / ordinary)
    tallied = counts.select("code", t.alias("t"), p.alias("p"), expected.alias("e"))
    common = tallied.orderBy(F.desc("p"), "code").limit(COMMON_CODES).select("code").collect()
    marked = tallied.where(
        (F.col("t") >= LEAST_TEXTS)
        & (F.col("t") > CONTRAST * F.col("e"))
        & ((F.col("t") - F.col("e")) / F.sqrt(F.col("e") + 1) > SIGNIFICANCE)
    )
    worth = F.col("t") * F.log(F.col("t") / F.col("e"))
    best = marked.orderBy(F.desc(worth), "code").limit(TOXIC_CODES).select("code").collect()
    join = lambda rows: b"".join(bytes(r["code"]) for r in reversed(rows))
    return join(common), join(best)


def _feature_rows(texts: DataFrame, folds: dict[int, tuple[bytes, bytes]]):
    """Features of the sampled texts, each by the dictionaries of the other half."""

    def measure(batches):
        gauges = {h: Gauge(*contents) for h, contents in folds.items()}
        for batch in batches:
            rows = [
                features(gauges[half].gains(text))
                for text, half in zip(
                    batch.column("text").to_pylist(), batch.column("half").to_pylist()
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))],
                ["toxic", "features"],
            )

    narrow = texts.select("text", "half", "toxic")
    return map_batches(narrow, measure, "toxic int, features array<double>").collect()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    shrink = np.append(np.full(len(w) - 1, ridge), 1e-9)
    loss = lambda v: float(np.mean(np.logaddexp(0, z @ v) - y * (z @ v)) + 0.5 * (shrink * v * v).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        slope = z.T @ (p - y) / len(y) + shrink * w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(shrink + 1e-9)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def score_documents(
    docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id``, ``score``, ``n_windows``, ``n_gaining``.

    ``n_gaining`` counts the windows that the toxic dictionary shortens. A null or empty text, or
    one without words, has one empty window and the score of a text without gains.
    """
    narrow = texts_of(docs, key, text)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def score(batches):
        gauge = Gauge(model.common, model.toxic)
        for batch in batches:
            scores, windows, gaining = [], [], []
            for body in batch.column("text").to_pylist():
                gains = gauge.gains(body) if model.weights else np.array([0])
                scores.append(probability(gains, model))
                windows.append(len(gains))
                gaining.append(int((gains > 0).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array(windows, pa.int64()),
                    pa.array(gaining, pa.int64()),
                ],
                ["doc_id", "score", "n_windows", "n_gaining"],
            )

    schema = f"doc_id {kind}, score double, n_windows bigint, n_gaining bigint"
    return map_batches(narrow, score, schema)


def probability(gains: np.ndarray, model: ToxicityModel) -> float:
    if model.weights is None:
        return model.base
    x = (np.array(features(gains)) - np.array(model.means)) / np.array(model.scales)
    return float(1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -50, 50))))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows scored at or above ``threshold``; all columns kept, no shuffle."""
    ship_package(docs.sparkSession)

    def score_all(texts: pd.Series) -> pd.Series:
        gauge = Gauge(model.common, model.toxic)
        return pd.Series([probability(gauge.gains(t), model) for t in texts], dtype=float)

    score = F.pandas_udf(score_all, "double")
    return docs.where(score(F.col("text").cast("string")) < threshold)
