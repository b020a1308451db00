"""Registered queries against their SQL, and the pipeline against the stages' meaning."""

import os

import pytest

import corpus_pipeline
from docquarry.llm.registry import LLM_ORACLE, LLM_QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", list(LLM_ORACLE))
def test_query(spark, name):
    connection = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    df = LLM_QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    relation = connection.sql(LLM_ORACLE[name])
    assert sorted(relation.columns) == columns
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=str)
    assert got == sorted(relation.select(*columns).fetchall(), key=str)


def test_pipeline_stages(spark):
    from tests.llm.test_text_operators import brute_groups, brute_repeats

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    after = {}
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF_DIR).persist()
        after[name] = {r.doc_id: r for r in docs.collect()}
    kept = after["language"]
    groups = {d: c for d, _, c in brute_groups([(r.doc_id, r.text) for r in kept.values()])}
    assert set(after["near_copies"]) == {d for d, c in groups.items() if d == c}
    table = [(r.doc_id, r.text) for r in after["near_copies"].values()]
    removed = {d: n for d, n, _, _ in brute_repeats(table)}
    for d, r in after["repeated_passages"].items():
        before = after["near_copies"][d].text
        assert (r.text == before) == (removed[d] == 0)
        assert 0 <= len(before.encode()) - removed[d] - len(r.text.encode()) <= 6
    assert set(after["no_benchmarks"]) < set(after["repeated_passages"])
    assert all(r.decoded == r.text and r.n_tokens == len(r.token_ids) for r in after["tokens"].values())
