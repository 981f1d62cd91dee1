"""Postings as lists a block: few rows, texts read once, exact for any letters."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import postings
from larder.plans import archive, upkeep  # noqa: F401  (its queries join the archive's)


@pytest.mark.parametrize("letters", ["ab c", "äß€😀\0x", "".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x12000)]))])
def test_grams_of_a_block_are_those_of_its_texts(letters):
    r = random.Random(3)
    for n in (1, 2, 400):
        hays = ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(n)]
        want, got = {}, {}
        for place, hay in enumerate(hays):
            for gram in postings.grams_of(hay):
                want.setdefault(gram, []).append(place)
        for grams, offsets, places in postings.inverted(hays):
            for gram, a, b in zip(grams, offsets, offsets[1:]):
                got.setdefault(gram, []).extend(places[a:b].tolist())
        assert got == want


def test_blocks_keep_all_rows_whatever_their_lengths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_CHARS", 50)
    r = random.Random(5)
    rows = [(i, None if i % 7 == 0 else "q" * r.choice([0, 1, 3, 49, 50, 51, 200])) for i in range(300)]
    index = postings.Postings(spark, f"{tmp_path}/p", buckets=4)
    index.write(spark.createDataFrame(rows, "id long, hay string"))
    for token in ("q", "qq", "qqq"):
        assert sorted(x.id for x in index.candidates([token]).collect()) == [i for i, h in rows if h and token in h]


def test_a_gram_that_all_rows_have_is_a_row_a_block(spark, tmp_path):
    """a row a pair of gram and text was moved and sorted; ids other than numbers are kept alike."""
    index = postings.Postings(spark, f"{tmp_path}/p", buckets=4, kind="string")
    rows = spark.range(20_000).select(F.format_string("r%d", "id").alias("id"), F.concat(F.lit("ring "), F.col("id").cast("string")).alias("hay"))
    index.write(rows.repartition(3), rows.select(F.lit("things").alias("label"), "id"))
    assert index.read("postings", ["rin"]).count() <= 6
    assert index.read("counts", ["rin"]).first().n == 20_000
    assert index.candidates(["ring", "1234"]).count() == sum("1234" in str(i) for i in range(20_000))
    assert index.candidates(["thin"], ["things"]).count() == 20_000 and index.read("postings", ["topic:things"]).count() < 200


def test_titles_are_read_once_for_their_index(spark, tmp_path):
    """a range partitioning drew its sample by making every gram a first time."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(title):
        seen.add(1)
        return title

    rows = spark.range(1000).select("id", told(F.concat(F.lit("Ring "), F.col("id").cast("string"))).alias("hay"))
    postings.Postings(spark, f"{tmp_path}/p").write(rows)
    assert seen.value == 1000


@pytest.mark.parametrize("query, fold", [("q129_indexed_token_search", "translate("), ("q130_indexed_umlaut_search", "lower(")])
def test_a_search_folds_its_candidates_once_and_nothing_else(spark, query, fold):
    """all texts were folded again beside the index, and the folded text once a token."""
    plan = archive.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    folds = [i for i, line in enumerate(plan) if fold in line]
    assert len(folds) == 1 and folds[0] < next(i for i, line in enumerate(plan) if "Join LeftSemi" in line)
