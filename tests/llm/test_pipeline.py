import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle
from edge import edge_docs, empty_docs

import corpus_pipeline
from imagora.llm import queries
from imagora.llm.common import stage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_sql(spark, name):
    r = oracle.compare(spark, oracle.duck(SF), SF, name, queries.QUERIES[name], queries.ORACLE[name])
    assert r["ok"] and not r.get("types"), r


def test_every_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = docs
    results = {}
    for name, step in corpus_pipeline.STAGES:
        before, kept = kept, stage(step(spark, kept, SF), name)
        results[name] = kept.collect()
        if name != "sharding":
            assert kept.schema == docs.schema
            assert kept.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert len(results["language_id"]) == docs.count()
    texts = [r.text for r in results["near_dedup"]]
    assert len(set(texts)) == len(texts) == len({r.doc_id for r in results["near_dedup"]})
    leaks = {r.doc_id for r in results["near_dedup"] if any(b in r.text for b in bench)}
    assert {r.doc_id for r in results["near_dedup"]} - {r.doc_id for r in results["decontamination"]} == leaks
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert words(results["mixing"]) == pytest.approx(1.5 * words(results["decontamination"]), rel=0.1)
    assert sorted(r.doc_id for r in results["sharding"]) == sorted(r.doc_id for r in results["mixing"])


def test_edges(spark):
    for make in (edge_docs, empty_docs):
        docs = make(spark)
        for name, step in corpus_pipeline.STAGES:
            out = stage(step(spark, docs, SF), name)
            if name != "sharding":
                assert out.columns == docs.columns
                docs = out
        assert (out.count() == 0) == (make is empty_docs)


def test_names_of_inner_columns_stay_the_users(spark):
    names = ["row", "guess", "i0", "t0", "t1", "hits", "times", "copy", "limits", "cuts", "_cut", "_gap", "_guess", "_copies"]
    docs = edge_docs(spark)
    docs = docs.select(*[c for c in docs.columns if c not in names], *[F.lit(f"own {n}").alias(n) for n in names])
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        assert docs.count() and {tuple(r) for r in docs.select(*names).collect()} == {tuple(f"own {n}" for n in names)}, name
