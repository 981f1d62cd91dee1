"""Files, repairs, write guards and markers."""

import json

import pytest
from pyspark.sql import functions as F

from larder.operators import matching, personal, trend
from larder.sources import tables
from larder.streaming import ingest, watch


def test_snapshots_and_latest(spark, tmp_path):
    for year, week, date, title in (("2026", "KW9", "2026-02-23", "a"), ("2026", "KW26", "2026-06-22", "b"), ("2025", "KW01", "2025-12-29", "c")):
        folder = tmp_path / year / week
        folder.mkdir(parents=True)
        (folder / f"{date}.json").write_text(json.dumps({"validFrom": date, "totalCount": 1, "offers": [{"id": 7, "title": title, "price": {"rawValue": 0}}]}))
    rows = tables.snapshots(spark, f"{tmp_path}/[0-9]*/KW*/*.json")
    assert {r.week for r in rows.collect()} == {"2026-KW9", "2026-KW26", "2025-KW01"}
    latest = tables.offers(tables.latest_snapshot(rows)).collect()
    assert [(r.title, r.price.rawValue) for r in latest] == [("b", 0.0)]


def test_optional_source(spark, tmp_path):
    assert tables.optional(spark, str(tmp_path / "none.json"), tables.RECEIPT).count() == 0


def test_preferences_are_repaired(spark):
    raw = json.dumps({"interests": {"a": 2, "b": 9}, "votes": {"1": {"v": 1, "t": "x"}, "2": {"v": 5, "t": "y"}}})
    p = tables.preferences(spark.createDataFrame([(raw,), ("{",)], "value string")).collect()
    assert p[0].interests == {"a": 2} and set(p[0].votes) == {"1"} and p[0].bought == {} and p[1].interests == {}


def test_brochures(spark):
    raw = json.dumps({"x": [{"publisher": {"name": "P"}, "id": 1, "validFrom": "2026-01-05", "inner": {"publisher": "Q", "id": 2, "validFrom": "z"}}]})
    page = f'<html><script id="__NEXT_DATA__" type="application/json">{raw}</script></html>'
    found = tables.embedded_json(spark.createDataFrame([(page,), ("<p>",)], "html string")).select(F.to_json("data").alias("j")).collect()
    assert found[1].j is None
    spark.udtf.register("brochures", tables.Brochures)
    spark.createDataFrame([(found[0].j,)], "j string").createOrReplaceTempView("pages_json")
    got = spark.sql("select b.* from pages_json, lateral brochures(j) b").collect()
    assert [(r.node_id, r.publisher) for r in got] == [("1", "P")]


def test_week_sink_never_shrinks(spark, tmp_path):
    path = str(tmp_path / "weeks")
    sink = ingest.WeekSink(spark, path, "week", ["id", "price"])
    df = lambda rows: spark.createDataFrame(rows, "week string, id int, price double, seen string")
    sink(df([("w1", 1, 1.0, "a"), ("w1", 2, 2.0, "a")]))
    sink(df([("w1", 1, 1.0, "b")]))  # smaller: kept out
    assert spark.read.parquet(path).count() == 2
    sink(df([("w1", 2, 2.0, "c"), ("w1", 1, 1.0, "c")]))  # only volatile columns differ: kept out
    assert {r.seen for r in spark.read.parquet(path).collect()} == {"a"}
    sink(df([("w1", 1, 9.0, "d"), ("w1", 2, 2.0, "d"), ("w2", 1, 1.0, "d")]))
    assert spark.read.parquet(path).count() == 3


def test_stream_into_sink(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    spark.createDataFrame([("w1", 1), ("w2", 2)], "week string, id int").write.parquet(str(src))
    stream = spark.readStream.schema("week string, id int").parquet(str(src))
    ingest.ingest(stream, ingest.WeekSink(spark, str(out), "week", ["id"]), str(tmp_path / "cp"))
    assert spark.read.parquet(str(out)).count() == 2


def test_stale_week(spark):
    rows = spark.createDataFrame([("2026-01-05", 1), ("2026-01-05", 2), ("2026-01-12", 2), ("2026-01-12", 1), ("2026-01-19", 3)], "d string, id int")
    hashes = ingest.canonical_hash(rows.withColumn("d", F.col("d").cast("date")), "d", ["id"]).withColumn("source", F.lit("s"))
    assert [str(r.d) for r in watch.stale_weeks(hashes).collect()] == ["2026-01-12"]


def test_marked_links(spark):
    texts = spark.createDataFrame([(1, "a [[Veggie Wurst|Wurst]] b [[Nix|x]]")], "k int, t string")
    titles = spark.createDataFrame([("veggie wurst",)], "title string")
    got = {r.raw: (r.title, r.label) for r in matching.marked_links(texts, titles, "k", "t").collect()}
    assert got == {"Veggie Wurst": ("veggie wurst", "veggie wurst"), "Nix": (None, "x")}


def test_no_products(spark):
    rows = [("Einwegpfand", 1), ("Summe", 1), ("Milch", 2)]
    lines = spark.createDataFrame([(n, n.lower(), 1.0, 1.0, i) for i, (n, _) in enumerate(rows)], "name string, norm string, qty double, spent double, at int")
    assert [r.norm for r in personal.loyalty(lines).collect()] == ["milch"]


@pytest.mark.parametrize(("days", "n"), [(7, 0), (14, 1), (21, 2)])
def test_gap_weeks(spark, days, n):
    dates = spark.sql(f"select 'k' as key, date'2026-01-05' as d union all select 'k', date_add(date'2026-01-05', {days})")
    assert trend.missing_weeks(dates).count() == n
