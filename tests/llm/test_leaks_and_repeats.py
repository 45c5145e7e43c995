import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import suffix_dedup
from scrubline.llm.decontaminate import drop_leaked, find_leaks
from scrubline.llm.suffix_sort import deep_shallow_order, neighbour_prefixes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(text, items, window):
    doc = words(text)
    hit, found = set(), set()
    for item, body in items:
        test = words(body)
        size = min(window, len(test))
        grams = {tuple(test[k : k + size]) for k in range(len(test) - size + 1)} if size else set()
        for p in range(len(doc) - size + 1):
            if tuple(doc[p : p + size]) in grams:
                hit.update(range(p, p + size))
                found.add("" if item is None else str(item))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_leaks(spark, odd_docs, odd_rows, block_bytes):
    rng = random.Random(3)
    sources = [t for _, t in odd_rows if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[3:28])) for k, t in enumerate(rng.sample(sources, 6))]
    items += [(90, "Sole"), (91, None), (92, " . "), (None, items[0][1]), (0, items[0][1]), (93, "the of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(odd_docs, bench, block_bytes=block_bytes).collect()
    expected = Counter((i, *map(str, hits(t, items, 10))) for i, t in odd_rows)
    assert Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(list(r["items"]))) for r in got) == expected
    of = {i: words(t) for i, t in odd_rows}
    test = {("" if k is None else str(k), i): words(b) for i, (k, b) in enumerate(items)}
    for r in got:
        for m in r.matches:
            part = of[r.doc_id][m.start : m.start + m.length]
            assert any(k[0] == m.item_id and w[m.item_start : m.item_start + m.length] == part for k, w in test.items())
    clean = drop_leaked(odd_docs, bench)
    assert clean.columns == odd_docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, t in odd_rows if not hits(t, items, 10)[1])


def test_leaked_rows_go_by_their_text(spark):
    """Rows of null or repeated ids are judged one by one."""
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(None, f"a {item} b"), (None, "clean"), (None, None), (1, item), (1, "also clean"), (2, "x"), (2, "x")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int")
    kept = drop_leaked(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.place for r in kept.collect()) == [1, 2, 4, 5, 6]


def test_leaks_without_rows(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(odd_docs, none).where("n_hit = 0 and size(items) = 0").count() == len(odd_rows)
    assert find_leaks(no_docs, none).count() == 0


def without_repeats(rows, length):
    bodies = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(bodies):
        for s in range(len(bodies[i]) - length + 1):
            first.setdefault(bodies[i][s : s + length], (i, s))
    done = {}
    for i, body in bodies.items():
        gone = np.zeros(len(body), dtype=bool)
        for s in range(len(body) - length + 1):
            if first[body[s : s + length]] != (i, s):
                gone[s : s + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(body) else 0
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        done[i] = (len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return done


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeats(odd_docs, odd_rows, hot, monkeypatch):
    if hot == 2:
        monkeypatch.setattr(suffix_dedup, "AT_ONCE", 50)
    done = suffix_dedup.remove_repeats(odd_docs, hot=hot)
    got = done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    expected = without_repeats(odd_rows, 100)
    assert len(got) == len(odd_rows)
    assert {r[0]: tuple(r)[1:] for r in got} == expected


def test_repeats_across_long_texts(spark, monkeypatch):
    """Texts beyond one block are cut into overlapping pieces."""
    from scrubline.llm import shingles

    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = [(k, "".join(rng.choice("xyz ") for _ in range(900)) + shared + "q" * k) for k in range(4)]
    ids, tags = [r[0] for r in rows], [0] * 4
    bodies = [t.encode() for _, t in rows]
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 11)
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 700)
    records = suffix_dedup._records(ids, tags, bodies, 100, 32)
    windows = Counter()
    for r in records:
        for x in range(int(r["low"]), int(r["high"]) + 1):
            windows[int(r["doc"]), int(r["at"]) - x] += 1
    assert windows == Counter((i, s) for i, t in rows for s in range(len(t) - 99))


def test_repeats_of_nothing(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_order(seed):
    rng = np.random.default_rng(seed)
    n, width = 400, 40
    rows = rng.integers(0, 2, (n, width)).astype(np.uint8)
    rows[: n // 2, : width - 6] = rows[0, : width - 6]  # long common prefixes
    rows[n // 2 : n // 2 + 20] = rows[1]  # equal strings
    group = rng.integers(0, 5 if seed else 1, n)
    order = deep_shallow_order(group, rows)
    keys = [(int(group[i]), rows[i].tobytes()) for i in range(n)]
    assert [keys[i] for i in order] == sorted(keys)
    lcp = neighbour_prefixes(order, group, rows)
    for k in range(1, n):
        a, b = keys[order[k - 1]], keys[order[k]]
        same = next((d for d in range(width) if a[1][d] != b[1][d]), width)
        assert lcp[k] == (same if a[0] == b[0] else -1)
