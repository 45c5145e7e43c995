"""Stages of the pipeline keep tables of any columns, ids and texts."""

import random
from collections import Counter

import pytest

from scrubline.llm import toxicity
from scrubline.llm.decontaminate import drop_leaked
from scrubline.llm.exact_dedup import drop_exact_copies
from scrubline.llm.jaccard_join import keep_one_per_component, linked_components

NAMES = ["__sha", "__ROW", "row", "Whole", "a.b", "digit", "hash", "rest", "keep_id", "class", "`q`", "doc id", "n_hit"]


def words(rng, n):
    return [rng.choice("stone river light winter sails copper garden lantern".split()) + str(rng.randrange(99)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, near copies and leaks under null, repeated and single ids, and columns of any name."""
    rng, rows = random.Random(2), []
    for doc_id in (None, 7, 1, 2):
        one = words(rng, 40)
        rows += [(doc_id, " ".join(one)), (doc_id, "  ".join(one)), (doc_id, " ".join([*one[:39], "changed"]))]
        rows.append((doc_id, " ".join(["leak", "of", "ten", "words", "in", "a", "row", "that", "is", "here"])))
    rows += [(None, None), (3, ""), (None, ""), (3, "short")]
    full = [(*r, *[f"{k}-{n}" for n in range(len(NAMES))]) for k, r in enumerate(rows)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame(full, schema).repartition(3), [tuple(r) for r in full]


def check(kept, odd, expected):
    """The rows that stay are rows that were, each whole; of each text as many as expected."""
    docs, rows = odd
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert not set(got) - set(rows) and len(set(got)) == len(got)
    assert Counter((" ".join((r[1] or "").split())) for r in got) == expected


def plain(rows):
    return [" ".join((r[1] or "").split()) for r in rows]


def test_exact_copies(odd):
    check(drop_exact_copies(odd[0]), odd, Counter(set(plain(odd[1]))))


def test_near_copies(odd):
    texts = plain(odd[1])
    expected = Counter({t for t in texts if t and "changed" not in t}) + Counter({"": texts.count("")})
    got = keep_one_per_component(odd[0], 5, 80)
    families = Counter(t.replace("changed", "")[:60] for t in plain([tuple(r) for r in got.collect()]))
    assert families == Counter(t[:60] for t in expected.elements())
    assert got.columns == odd[0].columns


def test_leaks(spark, odd):
    bench = spark.createDataFrame([(1, "leak of ten words in a row that is here"), (2, None)], "item_id long, text string")
    kept = drop_leaked(odd[0], bench)
    check(kept, odd, Counter(t for t in plain(odd[1]) if not t.startswith("leak")))
    again = drop_leaked(odd[0], bench)  # a plan that has not run, so that it is listed once
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # the fixture's own


def test_toxic(spark, odd):
    model = toxicity.train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    check(toxicity.drop_toxic(odd[0], model), odd, Counter(plain(odd[1])))


def test_null_ids_are_read_once_each(spark):
    """Near copies with null ids, and one row many times over: work grows with the rows, not their square."""
    rng, rows = random.Random(3), []
    for _ in range(60):
        one = words(rng, 30)
        rows += [(None, " ".join(one)), (None, " ".join([*one[:29], "end"]))]
    rows += [rows[0]] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = linked_components(docs, 4, 80).collect()
    assert len(got) == len(rows) and all(r.component_id is None for r in got)
    kept = keep_one_per_component(docs, 4, 80)
    assert kept.count() == 60
