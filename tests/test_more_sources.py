"""Paged and sibling sources, receipts, replaced indexes, guards and isolation."""

import json

import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import audit, digest, personal
from larder.sources import sinks, tables
from larder.streaming import ingest


def test_paged_source(spark):
    def pages(offset, limit):
        rows = [{"sku": f"s{k}", "price": k / 2} for k in range(130)]
        return {"data": rows[offset : offset + limit], "total": 140}  # the source counts more than it gives

    spark.dataSource.register(tables.paged_source("pages_ok", "sku string, price double", 60, pages))
    df = spark.read.format("pages_ok").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 130
    assert df.where("sku = 's7'").first().price == 3.5
    spark.dataSource.register(tables.paged_source("pages_bad", "sku string", 60, lambda offset, limit: {"data": None}))
    with pytest.raises(Exception, match="malformed page"):
        spark.read.format("pages_bad").load().count()


def test_sibling_archive(spark, tmp_path):
    def write(folder, date, start, n, total=None):
        path = tmp_path / folder
        path.mkdir(parents=True, exist_ok=True)
        offers = [{"sku": f"k{i // 2 if n == 3 else i}", "title": "t"} for i in range(n)]
        (path / f"{date}.json").write_text(json.dumps({"weekStart": start, "totalCount": total, "offers": offers}))

    write("2026/KW02", "2026-01-05", "2026-01-05", 30)
    write("2026/KW03", "2026-01-12", "2026-01-13", 30, 40)
    write("2026/KW06", "2026-02-02", "2026-02-02", 3)
    snaps = tables.siblings(spark, f"{tmp_path}/20*/KW*/*.json", "other")
    keys = snaps.select("source", "d", F.explode("offers.sku").alias("key"))
    known = spark.sql("select date'2026-01-19' as missing")
    got = sorted((r.check, r.severity, r.entity, r.detail) for r in audit.sibling_report(snaps, keys, known).collect())
    assert got == [
        ("known gap", "note", "other", "2026-01-19"), ("misfiled", "fail", "other/2026-01-12", "2026-01-13"), ("missed week", "fail", "other", "2026-01-26"),
        ("repeated key", "fail", "other/2026-02-02/k0", "2"), ("short of declared", "fail", "other/2026-01-12", "30"), ("thin", "fail", "other/2026-02-02", "3"),
    ]


def test_receipts(spark, tmp_path):
    for name, items in (("a", [("Milch ", 2.0, 1.1), ("Pfand", 1.0, 0.25)]), ("b", [("MILCH", None, -1.0)])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"store": "S", "date": name, "items": [{"name": n, "qty": q, "price": p} for n, q, p in items]}))
    lines = tables.receipt_lines(spark, str(tmp_path / "*.json"))
    assert lines.select("fp").distinct().count() == 2
    assert [tuple(r) for r in personal.loyalty(lines).collect()] == [("milch", 2, 3.0, 1.1, "MILCH")]
    assert tables.receipt_lines(spark, str(tmp_path / "none.json")).count() == 0


def test_an_index_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "index")
    sinks.write_index(spark.range(5), path, "id")
    with pytest.raises(Exception):
        sinks.write_index(spark.range(9).select(F.raise_error(F.lit("broken")).alias("id")), path)
    assert tables.index(spark, path).count() == 5
    sinks.write_index(spark.range(9), path)
    assert tables.index(spark, path).count() == 9


def test_price_history_and_its_head(spark, tmp_path):
    obs = tables.observations(spark, "/root/testdata/sf0.001")
    sinks.write_history(obs, str(tmp_path))
    head = tables.index(spark, f"{tmp_path}/head").first()
    weeks = sorted({r.d for r in obs.select("d").distinct().collect()})
    assert head.weeks == weeks and head.latest == weeks[-1]
    assert tables.index(spark, f"{tmp_path}/products").where("weeks < 2").count() == 0
    sinks.history_export(tables.index(spark, f"{tmp_path}/products"), f"{tmp_path}/export")
    assert spark.read.json(f"{tmp_path}/export").count() == tables.index(spark, f"{tmp_path}/products").count()


def test_rekeying_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("w1", "A b", 2.0, 1), ("w1", "a B", None, 0), ("w2", "a b", 3.0, 0)], "week string, title string, price double, at int")
    key = lambda df: text.minted_id(text.norm_title(F.col("title")))
    once = sinks.rekeyed(rows, key, "week", "price", F.col("at"))
    assert sorted((r.week, r.price) for r in once.collect()) == [("w1", 2.0), ("w2", 3.0)]
    assert sorted(map(tuple, sinks.rekeyed(once, key, "week", "price", F.col("at")).collect())) == sorted(map(tuple, once.collect()))


def test_manifest_and_nested_pages(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(["2026/KW02/2026-01-05.json", "readme.md"]))
    assert [(r.week, r.date) for r in tables.manifest(spark, str(tmp_path / "m.json")).collect()] == [("2026-KW02", "2026-01-05")]
    b = spark.createDataFrame([(1, [([("x",)],), ([("y",), ("z",)],)])], "brochure_id int, pages array<struct<offers:array<struct<t:string>>>>")
    assert [(r.page, r.offer.t) for r in tables.flattened(b).collect()] == [(0, "x"), (1, "y"), (1, "z")]


def test_a_broken_archive_is_no_empty_one(spark, tmp_path):
    (tmp_path / "weeks").mkdir()
    (tmp_path / "weeks" / "part.parquet").write_text("no parquet")
    sink = ingest.WeekSink(spark, str(tmp_path / "weeks"), "week", ["id"])
    with pytest.raises(Exception):
        sink(spark.createDataFrame([("w1", 1)], "week string, id int"))


def test_one_failing_source_keeps_no_other_from_running():
    ran = []

    def fails():
        raise ValueError("gone")

    assert ingest.isolated({"a": fails, "b": lambda: ran.append("b")}) == {"a": "ValueError: gone"} and ran == ["b"]


@pytest.mark.parametrize(("today", "n"), [("2026-01-05", 0), ("2026-01-06", 1), ("2026-01-11", 1)])
def test_overdue_from_tuesday_on(spark, today, n):
    weeks = spark.sql(f"select 'KW02' as week, date'{today}' as today union all select 'KW03', date'{today}' union all select 'KW04', date'{today}'")
    one = lambda w: spark.createDataFrame([(w,)], "week string")
    assert ingest.overdue(weeks, one("KW03"), one("KW04")).count() == n


def test_folding_covers_latin_letters(spark):
    row = spark.createDataFrame([("ÅŁŐ Ěščř Nguyễn café Straße",)], "s string")
    assert row.select(text.search_fold(F.col("s")).alias("x")).first().x == "ało escr nguyen cafe strasse"
    row = spark.createDataFrame([("je １２ m² Äpfel",)], "s string")
    assert row.select(text.norm_desc(F.col("s")).alias("x")).first().x == "12 m2 äpfel"
    row = spark.createDataFrame([("  Süße Äpfel & Öl!",)], "s string")
    assert row.select(text.slugify(F.col("s")).alias("x")).first().x == "suesse-aepfel-oel"


def test_previous_gap(spark):
    dates = spark.sql("select 'k' as key, date'2026-01-05' as d union all select 'k', date'2026-01-19'")
    assert sorted((r.gap or 0) for r in audit.previous_gap(dates).collect()) == [0, 14]


def test_sections_may_overlap(spark):
    row = spark.createDataFrame([("Veggie Radler", "Getränke", True)], "t string, c string, k boolean")
    assert row.select(digest.sections(F.col("t"), F.col("c"), F.col("k")).alias("s")).first().s == ["vegan", "beer", "flagged"]
