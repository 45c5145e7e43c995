import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from scrubline.llm.importance import bucket_counts, resample
from scrubline.llm.word_automaton import Appender, WordScan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def runs_of(text, low, high):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def buckets_of(text, low, high, buckets):
    return [zlib.crc32(run.encode()) % buckets for run in runs_of(text, low, high)]


def by_hand(rows, items, percent, least, low=1, high=1, buckets=10_000):
    """doc_id, n_features, weight, score, rank of every row, one after the other."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets_of(text, low, high, buckets))
    for text in items:
        t.update(buckets_of(text, low, high, buckets))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    scored = []
    for key, text in rows:
        found = buckets_of(text, low, high, buckets)
        weight = sum(gain[b] for b in found)
        digits = hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8]
        part = (int(digits, 16) + 0.5) / 4294967296
        score = weight + math.floor(-1000 * math.log(-math.log(part)))
        scored.append((key, len(found), weight, score, len(words_of(text)) >= least))
    able = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = len(able) * percent // 100
    ranks = Counter((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able))
    return ranks + Counter((*r[:4], None) for r in scored if not r[4])


def got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_every_row_as_by_hand(spark, odd_docs, odd_rows):
    items = ["the river stone of", "Copper winter; LANTERN été", None, ""]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    assert got(resample(odd_docs, target)) == by_hand(odd_rows, items, 10, 20)
    ranks = resample(odd_docs, target, percent=100, least_words=0, buckets=97, low=1, high=3)
    expected = by_hand(odd_rows, items, 100, 0, 1, 3, 97)
    # repeated rows share a score, so their ranks lie next to each other in any order
    assert got(ranks) == expected
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(1, len(odd_rows) + 1))
    only_pairs = resample(odd_docs, target, percent=40, least_words=2, low=2, high=2)
    assert got(only_pairs) == by_hand(odd_rows, items, 40, 2, 2, 2)


def test_null_ids_and_clashing_columns(spark):
    texts = ["one two three four five", "one two", None, "", "five five five six seven"]
    rows = [(None, t) for t in texts] * 3 + [(7, texts[0])] * 5
    docs = spark.createDataFrame(
        [(*r, 1, 2, 3) for r in rows], "doc_id long, text string, rank int, `a.b` int, Score int"
    )
    target = spark.createDataFrame([("five six",)], "text string")
    result = resample(docs, target, percent=50, least_words=1)
    assert result.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert got(result) == by_hand(rows, ["five six"], 50, 1)


def test_empty_tables(spark, odd_docs, odd_rows, no_docs):
    nothing = spark.createDataFrame([], "text string")
    assert resample(no_docs, nothing).count() == 0 and bucket_counts(no_docs).count() == 0
    assert got(resample(odd_docs, nothing)) == by_hand(odd_rows, [], 10, 20)


def test_composed_checksums():
    appender = Appender()
    pairs = [(b"abc", b"hello"), (b"", b"x" * 1000), (b"q" * 77, b""), ("é".encode(), b"\xff\x00")]
    left, right = ([zlib.crc32(p[k]) for p in pairs] for k in (0, 1))
    sums = appender.append(
        np.array(left, np.uint32), np.array(right, np.uint32), np.array([len(p[1]) for p in pairs])
    )
    assert sums.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_scan_emits_every_word_in_order():
    texts = ["A b, A!b", None, "", "été\x00ÉTÉ x1", "b" * 5000, "  z"]
    scan = WordScan([t if t is None else t.encode() for t in texts])
    words = [(k, w) for k, t in enumerate(texts) for w in words_of(t)]
    assert scan.text.tolist() == [k for k, _ in words]
    assert scan.crc.tolist() == [zlib.crc32(w.encode()) for _, w in words]
    assert scan.n_words.tolist() == [len(words_of(t)) for t in texts]
    assert WordScan([]).n_words.tolist() == [] and not len(WordScan([None]).crc)
