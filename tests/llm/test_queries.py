import importlib
import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from scrubline.llm.oracle import llm_oracles
from scrubline.llm.queries import llm_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_query_gives_every_row(spark, name):
    from scrubline.sources.tables import table

    df = llm_queries()[name](spark, FOLDER)
    source = table(spark, FOLDER, "pages" if name.startswith("op9") else "documents")
    rows = df.collect()
    key = "page_id" if name.startswith("op9") else "doc_id"
    assert {r[key] for r in rows} == {r[key] for r in source.select(key).collect()}
    if name not in ("op2_packing", "op3_token_counts"):
        assert len(rows) == source.count()


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    done = con.execute(llm_oracles()[name])
    names = [d[0] for d in done.description]
    df = llm_queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(done.fetchall())


def test_pipeline_stages(spark):
    """Each stage is held against a plain Python version of its decision."""
    from tests.llm.test_exact_and_shards import plain
    from tests.llm.test_leaks_and_repeats import hits
    from tests.llm.test_links import components, sets_of

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing",
    ]
    scores = {r.doc_id: r.score for r in llm_queries()["op5_toxicity"](spark, FOLDER).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, FOLDER)
        if name == "packing":
            rows = after.collect()
            assert {r.doc_id for r in rows} == set(before)
            break
        assert after.columns == docs.columns
        docs = after.checkpoint() if spark.sparkContext.getCheckpointDir() else after.cache()
        got = sorted(r.doc_id for r in docs.collect())
        if name == "toxicity":
            expected = [i for i in before if scores[i] < 0.7]
        elif name == "exact_dedup":
            least = {}
            for i in sorted(before):
                least.setdefault(plain(before[i]), i)
            expected = least.values()
        elif name == "ngram_jaccard_join":
            expected = set(components(sets_of(before.items(), 5), 80).values())
        else:
            expected = [i for i, t in before.items() if not hits(t, items, 10)[1]]
        assert got == sorted(expected)
    ran = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in ran.select("doc_id").collect()} == {r.doc_id for r in rows}


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_operators():
    root = os.path.dirname(importlib.import_module("scrubline").__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as source:
                    assert "scrubline.llm" not in source.read()
