"""All operators are registered, and all SQL of this subpackage runs and agrees."""

import duckdb
import pytest
from test_queries import canonical

import corpus_pipeline
from larder.llm import queries

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name, sf):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got, expected = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and len(got)
    assert canonical(got) == canonical(expected)


def test_pipeline_runs_end_to_end(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0 and {"doc_id", "length", "sequence_id", "offset"} <= set(packed.columns)
    assert packed.groupBy("sequence_id").count().where("count > 1").isEmpty()
    assert packed.select("doc_id").distinct().join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "left_anti").isEmpty()
