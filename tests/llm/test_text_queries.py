"""Registered text queries and the pipeline at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck
from conftest import SF
from riskloom.llm import queries

import corpus_pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    problem, _ = compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None, problem


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op7", "op9", "op10", "op11", "op12")))
def test_every_document_has_its_rows(spark, name):
    found = queries.QUERIES[name](spark, SF).select("doc_id").distinct().count()
    assert found == duckdb.sql(f"SELECT count(DISTINCT doc_id) FROM '{SF}/documents.parquet'").fetchall()[0][0]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert {r["doc_id"] for r in rows} <= before
        if name == "toxicity":
            clean = {d for d in before if labels.get(d) == 0}
            assert len(clean - {r["doc_id"] for r in rows}) <= 0.02 * len(clean)
        before = {r["doc_id"] for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {d for r in bins for d in r["doc_ids"]} == before
    assert max(r["n_words"] for r in bins) <= 2048
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sum(r["n_words"] for r in whole) == sum(r["n_words"] for r in bins)
