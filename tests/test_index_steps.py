"""Steps of the incremental index: cheap hashes of weeks, one shuffle a step, the last week without joining all lines."""

from datetime import date

from pyspark.sql import functions as F

from larder.plans import upkeep
from larder.sources.tables import observations, table
from larder.streaming import product_index


def test_hashes_of_weeks_tell_rows_apart_in_any_order(spark):
    """every row was spelt as JSON and its digest read as decimals."""
    row = ("k", "t", None, "kg", date(2026, 1, 5), 1.0, None, 2.0, True, 1, 1)
    schema = "key string, title string, cat string, unit string, d date, gp double, gpf string, face double, flagged boolean, l_orderkey long, l_linenumber int"
    hash_of = lambda *rows: product_index.week_hashes(spark.createDataFrame(rows, schema).repartition(3)).first()
    moved, other = (row[0], None, "t", *row[3:]), (*row[:9], 2, 1)
    assert hash_of(row, other) == hash_of(other, row) and hash_of(row, other).n == 2
    assert len({hash_of(*rows).hash for rows in ([row], [moved], [other], [row, row], [row, row, other, other], [row, other])}) == 6


def test_states_are_shuffled_once(spark):
    obs = observations(spark, "/root/testdata/sf0.001").cache()
    for states in (product_index.weekly_states(obs), product_index.merged(spark.createDataFrame([], product_index.PRODUCTS))):
        plan = states._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    obs.unpersist()


def test_last_week_is_that_of_joined_lines(spark):
    line, obs = table(spark, "/root/testdata/sf0.001", "lineitem"), observations(spark, "/root/testdata/sf0.001")
    last = obs.agg(F.max("d")).first()[0]
    assert upkeep._last_week(line, obs) == last
    early = obs.where(F.col("d") < date(1999, 1, 1))  # as if later lines had no part
    assert upkeep._last_week(line, early) == early.agg(F.max("d")).first()[0]
    assert upkeep._last_week(line.where("false"), obs.where("false")) is None
