"""The registered queries on given tables, and the pipeline."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from burstlens.llm import queries as registered
from tests.llm.test_decontaminate import words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    yield con
    con.close()


def test_there_is_one_query_for_each_operator():
    names = [n.partition("_")[0] for n in registered.queries()]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    got = registered.queries()[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(result.fetchall(), key=str)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(registered.queries()) - set(ORACLES)))
def test_query_has_a_row_for_each_document(spark, name):
    got = registered.queries()[name](spark, SF)
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    docs = docs.selectExpr("*", "'x' as kept", "1 as SCORE", "2 as spans", "3 as _fingerprint")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    phrases = {tuple(words(b.text)[i : i + 10]) for b in benchmark for i in range(len(words(b.text)) - 9)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = after.cache()
        n = docs.count()
        assert 0 < n <= before
        before = n
    for r in docs.collect():
        own = words(r.text)
        assert not any(tuple(own[i : i + 10]) in phrases for i in range(len(own) - 9))
        assert r.n_chars == len(r.text)
        assert (r.kept, r.SCORE, r.spans, r._fingerprint) == ("x", 1, 2, 3)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before and last.columns[: len(columns)] == columns
    assert all(r.n_tokens == len(r.token_ids) for r in last.collect())


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
