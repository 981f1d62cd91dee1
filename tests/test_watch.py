"""Stale deliveries and alerts from streams that stop and go on."""

import datetime

import pytest

from larder.streaming import ingest, watch

MONDAY = datetime.date(2026, 1, 5)
week = lambda k: MONDAY + datetime.timedelta(7 * k)


def run(spark, make, rows, schema, folder, mode):
    """Add a file of rows to a stream's source and run it to its end; what each run gave."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    got = []
    with watch.keyed_state(spark):
        stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        ingest.ingest(stream, lambda batch, epoch: got.extend(map(tuple, batch.collect())), f"{folder}/state", mode)
    return sorted(got)


def test_deliveries_across_restarts(spark, tmp_path):
    go = lambda rows: run(spark, watch.judged, rows, "source string, d date, n long, hash string", tmp_path, "update")
    assert go([("a", week(0), 5, "x"), ("b", week(0), 5, "x")]) == [("a", week(0), 5, "stored"), ("b", week(0), 5, "stored")]
    assert go([("a", week(1), 5, "x"), ("b", week(1), 6, "y")]) == [("a", week(1), 5, "stale"), ("b", week(1), 6, "stored")]
    assert go([("a", week(1), 7, "z"), ("b", week(1), 4, "w")]) == [("a", week(1), 7, "stored"), ("b", week(1), 4, "shrunk")]
    assert go([("a", week(1), 7, "z"), ("b", week(1), 9, "v"), ("b", week(3), 9, "v")]) == [("a", week(1), 7, "unchanged"), ("b", week(1), 9, "stored"), ("b", week(3), 9, "stored")]


def test_one_alert_a_week_and_source_across_restarts(spark, tmp_path):
    at = lambda k, days, hours=9: datetime.datetime.combine(week(k), datetime.time(hours)) + datetime.timedelta(days)
    go = lambda rows: [(s, w) for s, w, _ in run(spark, watch.alerts, rows, "source string, at timestamp, d date", tmp_path, "append")]
    assert go([("a", at(0, 0), week(0)), ("b", at(0, 0), None)]) == []
    assert go([("a", at(0, 1), None), ("b", at(0, 1), None)]) == [("b", week(0))]
    assert go([("a", at(0, 2), None), ("b", at(0, 2), week(0)), ("b", at(0, 3), None)]) == []
    assert go([("a", at(1, 0), None), ("b", at(1, 0), week(1))]) == []
    assert go([("b", at(1, 4), None)]) == [("a", week(1))]
    assert go([("a", at(1, 5), None), ("b", at(1, 6), None)]) == []


@pytest.mark.parametrize("gap", [7, 14])
def test_stale_weeks_look_at_the_monday_before(spark, gap):
    rows = [("a", MONDAY, "x"), ("a", MONDAY + datetime.timedelta(gap), "x"), ("b", MONDAY + datetime.timedelta(gap), "x")]
    found = watch.stale_weeks(spark.createDataFrame(rows, "source string, d date, hash string")).collect()
    assert [tuple(r) for r in found] == ([("a", week(1))] if gap == 7 else [])
