"""Postings, sketches, file listings, paged streams, German order and exact folding."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import digest, personal, postings, selection, sketch
from larder.sources import files, tables, versions
from larder.streaming import ingest


def hay(seed=4, n=300):
    r = random.Random(seed)
    return [(i, "".join(r.choice("ab c") for _ in range(r.randint(0, 40))) if i % 9 else None) for i in range(n)]


def test_postings_miss_nothing_and_verify(spark, tmp_path):
    rows = hay()
    table = spark.createDataFrame(rows, "id long, hay string")
    index = postings.Postings(spark, f"{tmp_path}/p", buckets=8)
    topics = spark.createDataFrame([("colour & abc", 0), ("colour & abc", 9)], "label string, id long")
    index.write(table, topics)
    for tokens in (["a"], ["ab"], ["abc", "c a"], ["aaaa", "bb", "b"], ["abcabc"], ["xyz"], ["a", "z"]):
        found = {r.id for r in table.join(index.candidates(tokens), "id", "left_semi").where(F.forall(F.array(*map(F.lit, tokens)), lambda t: F.contains("hay", t))).collect()}
        assert found == {i for i, h in rows if h and all(t in h for t in tokens)}, tokens
    assert {r.id for r in index.candidates(["colour"], ["colour & abc"]).collect()} == {0, 9}
    assert index.candidates(["co"], ["colour & abc"]).count() == 0  # too short to name a topic
    index.write(table.limit(0))
    assert index.candidates(["ab"]).count() == 0 and len(versions.listed(spark, f"{tmp_path}/p")) == 2


def test_postings_open_only_the_partitions_of_their_grams(spark, tmp_path):
    index = postings.Postings(spark, f"{tmp_path}/p", buckets=32)
    index.write(spark.createDataFrame(hay(), "id long, hay string"))
    read = index.read("postings", ["abc"])
    opened = {p.split("/bucket=")[1].split("/")[0] for p in read.inputFiles()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    got = {r.f.split("/bucket=")[1].split("/")[0] for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(got) == 1 and got <= opened


def test_sketched_quantiles_stay_within_their_rank_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.rand(3) * 100).alias("x"), F.expr("date_add(date'2026-01-05', cast(id % 8 as int) * 7)").alias("d"))
    rows = rows.withColumn("x", F.when(F.col("g") == 2, F.floor("x").cast("double")).otherwise(F.col("x")))
    found = sketch.quantiles(sketch.weekly_sketches(rows, "x", "g"), "g", at=(0.5, 0.0, 1.0))
    got = {r.g: r for r in sketch.rank_errors(rows, found, "x", "g").collect()}
    assert set(got) == {0, 1, 2} and all(r.error <= sketch.RANK_ERROR and r.n == 20_000 for r in got.values())
    assert got[0].q0 == got[0].q1 == got[0].q2 == 7.0


def test_files_that_exist(spark, tmp_path):
    for week, names in (("KW02", ["1", "2"]), ("KW03", ["3", "9"])):
        (tmp_path / week / "img").mkdir(parents=True)
        for name in names:
            (tmp_path / week / "img" / f"{name}.jpg").write_bytes(b"" if name == "2" else b"x")
    (tmp_path / "KW03" / "note.txt").write_text("no image")
    found = files.existing(spark, [f"{tmp_path}/KW02/img", f"{tmp_path}/KW03", f"{tmp_path}/none"], "*.jpg")
    offers = spark.createDataFrame([("2026-01-05", "1"), ("2026-01-05", "2"), ("2026-01-12", "3"), ("2026-01-12", None), ("2026-01-19", "4")], "d string, id string")
    assert sorted(r.name for r in found.collect()) == ["1", "3", "9"]  # an empty file holds no image
    assert sorted((r.d, r.have, r.total) for r in files.by_week(offers, found).collect()) == [("2026-01-05", 1, 2), ("2026-01-12", 1, 1), ("2026-01-19", 0, 1)]
    assert sorted(r.id for r in files.missing(offers, found).collect()) == ["2", "4"]
    assert [r.name for r in files.orphaned(offers, found).collect()] == ["9"]
    assert files.existing(spark, [f"{tmp_path}/none"]).count() == 0


def _pages(path):
    """A fetch over a file that holds how many rows there are, so that it can grow between runs."""

    def fetch(offset, limit):
        n = int(open(path).read())
        return {"data": [{"sku": f"s{k}"} for k in range(offset, min(n, offset + limit))], "total": n}

    return fetch


def test_a_paged_stream_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "n").write_text("130")
    spark.dataSource.register(tables.paged_stream("grown", "sku string", 60, _pages(str(tmp_path / "n"))))

    def run():
        got = []
        ingest.ingest(spark.readStream.format("grown").load(), lambda batch, epoch: got.extend(r.sku for r in batch.collect()), str(tmp_path / "state"))
        return got

    assert sorted(run()) == sorted(f"s{k}" for k in range(130))
    assert run() == []
    (tmp_path / "n").write_text("200")
    assert sorted(run()) == sorted(f"s{k}" for k in range(130, 200))
    (tmp_path / "n").write_text("150")
    with pytest.raises(Exception, match="shrunk"):
        run()


def test_german_order(spark):
    words = ["Zucker", "Äpfel", "Apfel", "apfel", "Apfelsaft", "Öl", "Oliven", "Ofen", "Straße", "Strasse", "Strudel", "", None]
    rows = spark.createDataFrame([(i, w, False) for i, w in enumerate(words)], "id int, title string, hidden boolean")
    expected = ["apfel", "Apfel", "Äpfel", "Apfelsaft", "Ofen", "Öl", "Oliven", "Strasse", "Straße", "Strudel", "Zucker"]
    assert [r.title for r in selection.browsed(rows).collect() if r.title] == expected
    up, down = ([r.title for r in rows.orderBy(*selection.table_order("title", up=u), "id").collect()] for u in (True, False))
    assert up[-2:] == ["", None] or up[-2:] == [None, ""]
    assert [w.lower() for w in down[:-2]] == [w.lower() for w in reversed(expected)] and not any(down[-2:])
    scored = rows.withColumn("score", F.when(F.col("title") == "Öl", 5).when(F.col("title") == "Ofen", 0).otherwise(1))
    assert [r.title for r in personal.best_of(scored.where("title <> ''"), 4).collect()] == ["Öl", "apfel", "Apfel", "Äpfel"]


def test_exact_folding_of_every_character(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    blocks = ["".join(chars[k : k + 64]) for k in range(0, len(chars), 64)] + [f"x{c}y" for c in chars[:3000]] + ["ﬁlet ½ ｶﾞ", "İstanbul", "ΣΑΣ", "", None]
    rows = spark.createDataFrame([(b,) for b in blocks], "s string").select("s", text.exact_fold(F.col("s")).alias("f"), text.exact_norm_desc(F.col("s")).alias("n")).collect()
    wrong = [(r.s, r.f) for r in rows if r.f != text.decomposed(r.s or "")]
    assert not wrong, wrong[:3]
    one = {r.s: r for r in rows}
    assert one["ﬁlet ½ ｶﾞ"].f == "filet 1⁄2 カ" and one["ﬁlet ½ ｶﾞ"].n == "1 2 filet ガ"


def test_merged_list_and_taste(spark):
    plan = spark.createDataFrame([("Milch", "pantry"), ("Brot ", "offer")], "name string, grp string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = sorted(map(tuple, personal.merged_list(plan, names("MILCH"), names("milch", "Eier", "Salz", " "), names("salz")).collect()))
    assert got == [("brot", "Brot ", "offer", ["plan"]), ("eier", "Eier", "custom", ["own"]), ("milch", "MILCH", "offer", ["basket", "own", "plan"])]
    i = spark.createDataFrame([("u", "beer", 2)], "user string, topic string, level int")
    v = spark.createDataFrame([("w", "Käse", -1)], "user string, title string, v int")
    b = spark.createDataFrame([("u", "Brot", 3), ("u", "Ei", 9), ("u", "Öl", 1)], "user string, name string, c int")
    assert sorted(map(tuple, digest.taste_summary(i, v, b, 2).collect())) == [("u", "beer", "", "", "", "", "Ei ×9, Brot ×3"), ("w", "", "", "", "", "Käse", "")]
