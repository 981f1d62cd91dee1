"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from larder.plans import archive, selections, upkeep  # noqa: F401  (both add their queries to the archive's)
from larder.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return ""
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        if isinstance(v, bool) or not hasattr(v, "__float__"):
            return str(v)
        return repr(float(v))

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(archive.QUERIES))
def test_query(spark, duck, name):
    got = archive.QUERIES[name](spark, SF).toPandas()
    if name not in archive.SQL:
        assert len(got)
        return
    expected = duck.sql(archive.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "up"), [("q58_null_last_ascending", True), ("q58_null_last_descending", False)])
def test_null_last_sorts_every_order(spark, duck, name, up):
    got = [(r.status, r.o_orderkey) for r in archive.QUERIES[name](spark, SF).collect()]
    rows = duck.sql("select nullif(o_orderstatus, 'P'), o_orderkey from orders").fetchall()
    assert len(got) == len(rows) and any(s is None for s, _ in got)
    assert got == sorted(rows, key=lambda r: (r[0] is None, (ord(r[0]) if up else -ord(r[0])) if r[0] else 0, r[1]))


@pytest.mark.parametrize(("name", "forms"), [("q32_derive_unit_price", (1, 2, 3, 5)), ("q33_size_bucket_and_key", (0, 1, 2, 3, 4, 5))])
def test_every_form_of_wording_is_read(spark, duck, name, forms):
    got = dict(archive.QUERIES[name](spark, SF).selectExpr("l_linenumber % 6 as form").groupBy("form").count().collect())
    assert got == dict(duck.sql(f"select l_linenumber % 6, count(*) from lineitem join part on l_partkey = p_partkey where l_linenumber % 6 in {forms} group by 1").fetchall())


def test_churn_hash_follows_the_rows_and_not_their_order(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    archive.observations(spark, SF).write.parquet(str(tmp_path / "obs"))
    rows = spark.read.parquet(str(tmp_path / "obs"))
    found = lambda o: (monkeypatch.setattr(archive, "observations", lambda *_: o), {r.d: (r.n, r.hash) for r in archive.QUERIES["q63_churn_hash"](spark, SF).collect()})[1]
    before = found(rows)
    assert len({h for _, h in before.values()}) == len(before)
    assert found(rows.repartition(7, "face").sortWithinPartitions(F.desc("face"))) == before
    week, order, line = rows.orderBy("d", "l_orderkey", "l_linenumber").select("d", "l_orderkey", "l_linenumber").first()
    one = (F.col("l_orderkey") == order) & (F.col("l_linenumber") == line) & (F.col("d") == week)
    after = found(rows.withColumn("face", F.when(one, F.col("face") + 0.01).otherwise(F.col("face"))))
    assert {d for d in before if before[d] != after[d]} == {week} and before[week][0] == after[week][0]
