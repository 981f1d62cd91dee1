"""Files that tasks write by name."""

from pyspark.sql import functions as F

from larder.plans import archive, upkeep
from larder.sources import files


def test_files_are_stored_by_name_and_found(spark, tmp_path):
    """a folder and a Parquet file a name, moved one by one by the driver, were written by four tasks."""
    rows = spark.range(-5, 300).select(F.format_string("%d/%d.img", F.pmod("id", F.lit(7)), "id").alias("path"), F.when(F.col("id") != 7, "ä").otherwise("").alias("content"))
    assert files.store(rows, f"file://{tmp_path}/f") == 305
    found = files.existing(spark, [f"file://{tmp_path}/f"], "*.img").collect()
    assert {int(r.name) for r in found if r.length == 2} == set(range(-5, 300)) - {7}
    assert (tmp_path / "f" / "2" / "-5.img").read_text() == "ä"
    assert files.store(rows.where("false"), f"file://{tmp_path}/g") == 0


def test_offers_of_files_are_joined_once(spark):
    """F8: the offers were joined anew for every use; files lie in few folders, which one job lists."""
    found = archive.QUERIES["q133_archived_files_by_week"](spark, "/root/testdata/sf0.001")
    assert "lineitem.parquet" not in found._jdf.queryExecution().optimizedPlan().toString() and "p_partkey" not in found._jdf.queryExecution().optimizedPlan().toString()
    offers, there = upkeep._archived(spark, "/root/testdata/sf0.001")
    assert 1 < there.select("folder").distinct().count() <= upkeep.FOLDERS
    lost = files.orphaned(offers, there)
    assert lost.count() == 10 and "Aggregate [name" in lost._jdf.queryExecution().optimizedPlan().toString()


def test_stored_files_are_listed_by_tasks(spark, tmp_path):
    """F8: the names of all files passed through the driver, and were read again by a task for some thirty of them."""
    rows = spark.range(400).select(F.format_string("%d/%d.%s", F.col("id") % 5, "id", F.when(F.col("id") % 3 == 0, "txt").otherwise("img")).alias("path"), F.when(F.col("id") != 7, "x").otherwise("").alias("content"))
    files.store(rows, f"file://{tmp_path}/f")
    folders = spark.range(0, 7, 1, 7).select(F.format_string(f"file://{tmp_path}/f/%d", "id").alias("folder"))
    got = {(r.folder, r.name, r.length) for r in files.listed(folders, r"([^/]+)\.img$").collect()}
    want = files.existing(spark, [f"file://{tmp_path}/f"], "*.img").selectExpr("replace(folder, 'file:/', 'file:///') as folder", "name", "length")
    assert len(got) == 400 - 134 - 1 and got == {tuple(r) for r in want.collect()}
    plan = archive.QUERIES["q133_archived_files_by_week"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "binaryFile" not in plan
    _, there = upkeep._archived(spark, "/root/testdata/sf0.001")
    assert there.rdd.getNumPartitions() == upkeep.FOLDERS
