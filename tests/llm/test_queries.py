"""Queries with SQL give the same rows in Spark and in DuckDB; all run on the smallest data."""

import pytest

import corpus_pipeline
from frameloom.llm.queries import ORACLES, QUERIES
from tests.compare import difference, open_tables


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert difference(spark, open_tables(sf), QUERIES[name], ORACLES[name], sf) is None


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as hook

    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(hook.queries())
    assert set(ORACLES) <= set(hook.oracle_sql())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_keeps_the_columns_and_ends_in_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes
        docs = out
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(row.round_trip for row in rows)
    assert all(4 * row.n_tokens == len(row.ids) for row in rows)
    # the first stages drop, the mix repeats
    assert {row.doc_id for row in rows} <= {row.doc_id for row in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_pipeline_runs_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
