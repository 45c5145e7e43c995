import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import jaccard_join
from scrubline.llm.components import connected
from scrubline.llm.jaccard_join import keep_one_per_component, linked_components
from scrubline.llm.t_occurrence import InvertedLists, group_links

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, width):
    found = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        grams = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)] or ([tuple(w)] if w else [])
        found[i] = frozenset(grams)
    return found


def components(sets, percent):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,percent,block", [(4, 85, 1 << 20), (5, 80, 1 << 20), (4, 85, 90), (2, 50, 300)])
def test_components(odd_docs, odd_rows, width, percent, block):
    sets = sets_of(odd_rows, width)
    expected = components(sets, percent)
    got = linked_components(odd_docs, width, percent, block_shingles=block).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, len(sets[i]), expected[i]) for i, _ in odd_rows)


def test_chains_and_hubs(spark):
    """Near copies in a chain, whose ends are not similar, and a large group around one text."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, chain = [], [word() for _ in range(60)]
    for k in range(30):
        rows.append((k, " ".join(chain)))
        chain[2 * k] = word()
    hub = [word() for _ in range(80)]
    for k in range(150):
        copy = list(hub)
        copy[rng.randrange(80)] = word()
        rows.append((100 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = components(sets_of(rows, 4), 85)
    for block in (1 << 20, 1500):
        got = linked_components(docs, block_shingles=block).collect()
        assert {r.doc_id: r.component_id for r in got} == expected
    kept = keep_one_per_component(docs, 4, 85)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


@pytest.mark.parametrize("kind", ["family", "strangers"])
def test_tasks_of_a_divided_group(spark, monkeypatch, kind):
    """No task holds more than a block and a part; a family that joins across blocks is not sent round."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for k in range(120):
        copy = list(base)
        if kind == "family":
            copy[rng.randrange(200)] = word()
        else:  # too little in common to be similar, but for every tenth and its next one
            copy[176:] = [word() for _ in range(24)]
            if k % 10 == 1:
                copy[176:] = rows[-1][1].split()[176:-1] + [word()]
        rows.append((k, " ".join(copy)))
    searched = []
    search = jaccard_join._search

    def watched(filled, percent, asked):
        job = [c for c in ("leader", "block", "part") if c in filled.columns]
        held = filled.groupBy(*job).agg(F.count("*").alias("n"), F.sum(F.length("shingles") / 8).alias("s"))
        searched.append([(r.n, r.s) for r in held.collect()])
        return search(filled, percent, asked)

    monkeypatch.setattr(jaccard_join, "_search", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = linked_components(docs, block_shingles=2000).collect()
    assert {r.doc_id: r.component_id for r in got} == components(sets_of(rows, 4), 85)
    assert max(s for jobs in searched for _, s in jobs) <= 4 * 2000 + 16 * 200
    assert len(searched[0]) > 8  # the group was divided
    if kind == "family":
        assert sum(n for jobs in searched[1:] for n, _ in jobs) <= 3 * sum(n for n, _ in searched[0])


def test_one_row_of_a_component_stays_whatever_its_ids(spark):
    """Null and repeated ids: near copies go, other texts of the same id stay."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    family = lambda n: [" ".join([*base[:99], word()]) for base in [[word() for _ in range(100)]] for _ in range(n)]
    nulls, same, mixed = family(3), family(3), family(2)
    rows = [(None, t) for t in nulls] + [(7, t) for t in same] + [(None, mixed[0]), (7, mixed[1])]
    rows += [(7, family(1)[0]), (None, family(1)[0]), (9, "one row"), (9, "one row"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int")
    kept = keep_one_per_component(docs.repartition(3), 4, 85)
    assert kept.columns == docs.columns
    got = Counter(r.text for r in kept.collect())
    assert sum(got[t] for t in nulls) == 1 and sum(got[t] for t in same) == 1
    assert got[mixed[0]] == 0 and got[mixed[1]] == 1  # a null id comes last
    assert got["one row"] == 1 and got[None] == 2 and got[rows[8][1]] == got[rows[9][1]] == 1


def test_no_documents(no_docs):
    assert linked_components(no_docs).count() == 0 and keep_one_per_component(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_search_finds_every_set_with_the_overlap(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(80)]
    index = InvertedLists(sets)
    for query in sets[:20]:
        for least in (1, 3, len(query)):
            found = dict(index.search(query, least, lambda s: False))
            truth = {k: len(np.intersect1d(query, s)) for k, s in enumerate(sets)}
            assert found == {k: n for k, n in truth.items() if n >= least}
    named = {k: frozenset(s.tolist()) for k, s in enumerate(sets)}
    root = components(named, 60)
    seen = defaultdict(set)
    for a, b in group_links(sets, 60):
        seen[a].add(b)
        seen[b].add(a)
    for k in named:
        reach, todo = {k}, [k]
        while todo:
            for n in seen[todo.pop()] - reach:
                reach.add(n)
                todo.append(n)
        assert reach == {j for j in named if root[j] == root[k]}


def test_connected(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links += [(1000 + k, 1001 + k) for k in range(70)] + [(2000, 2001 + k) for k in range(50)] + [(5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    touched = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: find(n) for n in touched}


def test_bitmaps_rule_out_no_similar_set():
    from scrubline.llm.jaccard_join import may_link, parity_bitmap

    rng = np.random.default_rng(8)
    for size in (1, 2, 9, 60, 129, 130, 900, 5000):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        n = len(base)
        gone = n * 15 // 100  # the most that a subset may lose at 85 %
        fresh = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        part = np.concatenate([base[: n - n // 13], rng.integers(0, 1 << 63, n // 13, dtype=np.uint64)])
        sets = [base, base[gone:], part, fresh]
        links = np.zeros(len(sets), dtype=bool)
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    links[a] = links[b] = True
        near = may_link(np.array([len(s) for s in sets]), [parity_bitmap(s) for s in sets], 85)
        assert links[0] and links[1] and not (links & ~near).any()
        if size >= 60:
            assert not near[3]


def test_sets_stay_where_nothing_can_be_similar(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    # passages that several texts have, and no two texts have all the same ones
    passages = [" ".join(word() for _ in range(40)) for _ in range(7)]
    rows = [" ".join(three) for three in combinations(passages, 3)]
    twin = [word() for _ in range(150)]
    rows += [" ".join(twin), " ".join(twin + ["end"])]
    sent = {}

    def spy(dealt, narrow, width):
        sent["classes"] = [r["class"] for r in dealt.select("class").distinct().collect()]
        return with_sets(dealt, narrow, width)

    with_sets = jaccard_join._with_sets
    monkeypatch.setattr(jaccard_join, "_with_sets", spy)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for most in (512, 1):  # larger groups stay whole
        monkeypatch.setattr(jaccard_join, "MOST_COMPARED", most)
        found = {r.doc_id: r.component_id for r in linked_components(df).collect()}
        assert found == {i: i for i in range(len(rows))} | {len(rows) - 1: len(rows) - 2}
        assert len(sent["classes"]) == 2 if most == 512 else len(sent["classes"]) > 2
