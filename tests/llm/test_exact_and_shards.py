import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scrubline.llm.exact_dedup import drop_exact_copies, exact_groups
from scrubline.llm.sharding import shard_documents


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digit", [1, 24])
def test_exact_groups(odd_docs, odd_rows, digit):
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[plain(t)].append(i)
    expected = Counter(
        (i, min(groups[plain(t)]), len(groups[plain(t)]), i == min(groups[plain(t)]),
         hashlib.sha256(plain(t).encode()).hexdigest())
        for i, t in odd_rows
    )
    got = exact_groups(odd_docs, first_digit=digit)
    assert Counter(tuple(r) for r in got.collect()) == expected
    kept = drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_one_id_for_different_texts(spark):
    rows = [(1, "same start A"), (1, "same start B"), (2, "same start A"), (2, "same start B"), (None, "same start B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.group_size) for r in exact_groups(docs, first_digit=2).collect()}
    assert sorted(got.values()) == [(1, 2), (1, 2), (1, 3), (1, 3), (1, 3)]


@pytest.mark.parametrize("same", [None, 5])
def test_groups_of_different_parents_do_not_meet(spark, same):
    """Null or repeated ids: texts that differ first and then go on alike stay apart."""
    ending = "s" * 900
    rows = [(same, "a" * 100 + ending)] * 2 + [(same, "b" * 100 + ending)] * 2 + [(same, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.group_size, r.keep_id, r.kept) for r in exact_groups(docs).collect())
    assert got == {(2, same, True): 4, (1, same, True): 1}
    assert Counter(r.text[0] for r in drop_exact_copies(docs).collect()) == {"a": 1, "b": 1, "c": 1}


def test_only_texts_that_go_on_move(spark, tmp_path, monkeypatch):
    from scrubline.llm import exact_dedup

    moved = []
    held = exact_dedup.held
    monkeypatch.setattr(exact_dedup, "held", lambda df, name: moved.append((name, df.columns)) or held(df, name))
    rows = [(i, f"{i:030d}" + "x" * 500) for i in range(50)] + [(60, "y" * 400)] * 2
    exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [c for n, c in moved if n == "radix"][0].count("rest") == 0
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    got = Counter(r.group_size for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {1: 50, 2: 2}


def test_exact_groups_empty(no_docs):
    assert exact_groups(no_docs).count() == 0 and drop_exact_copies(no_docs).count() == 0


def check_shards(docs, rows, shards):
    got = shard_documents(docs, shards).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, size(t), crc(t)) for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    of_text = defaultdict(set)
    where = {(r.doc_id, r.text_crc32): r.shard for r in got}
    for i, t in rows:
        of_text[t or ""].add(where[i, crc(t)])
    assert all(len(s) == 1 for s in of_text.values())
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    return sums


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_hold_every_row(odd_docs, odd_rows, shards):
    check_shards(odd_docs, odd_rows, shards)


def test_shards_are_the_best_in_their_order(spark):
    """The largest shard equals that of the best contiguous partition, found by brute force."""
    rows = [(i, "t%03d" % i + "y" * (i * 37 % 211)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sums = check_shards(docs, rows, 4)
    order = sorted(rows, key=lambda r: hashlib.sha256(r[1].encode()).digest())
    sizes = [len(t) + 1 for _, t in order]

    def fits(capacity):
        used, left = 1, capacity
        for s in sizes:
            if s > left:
                used, left = used + 1, capacity
            left -= s
        return used <= 4

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    assert max(sums.values()) == best


def test_hot_text_gets_its_own_shard(spark):
    rows = [(i, "hot text") for i in range(300)] + [(1000 + i, f"other {i:03d}") for i in range(600)]
    sums = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), rows, 8)
    assert max(sums.values()) == 300 * 9
    others = sorted(sums.values())[:-1]
    assert len(others) == 7 and others[-1] - others[0] <= 30


def test_shards_of_nothing(no_docs):
    assert shard_documents(no_docs, 8).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (3, "a")], "doc_id long, text string")
    assert shard_documents(docs, 2).where(F.col("slot") >= 0).count() == 3
    assert exact_groups(docs).count() == 3
