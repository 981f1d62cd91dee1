"""Versions behind a pointer, and the product index kept up to date week by week."""

import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from larder.sources import tables, versions
from larder.streaming import ingest, product_index

SF = "/root/testdata/sf0.001"


def write(df):
    return lambda folder: df.write.parquet(folder)


def test_a_failed_write_or_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    versions.publish(spark, path, write(spark.range(5)))
    reader = versions.read(spark, path)  # opened before what follows
    with pytest.raises(Exception):
        versions.publish(spark, path, write(spark.range(9).select(F.raise_error(F.lit("broken")).alias("id"))))
    assert versions.read(spark, path).count() == 5
    with monkeypatch.context() as m:

        def fails(*_):
            raise OSError("no rename")

        m.setattr(versions, "_rename_over", fails)
        with pytest.raises(OSError):
            versions.publish(spark, path, write(spark.range(7)))
    assert versions.read(spark, path).count() == 5
    versions.publish(spark, path, write(spark.range(9)))
    assert versions.read(spark, path).count() == 9 and reader.count() == 5
    assert len(versions.listed(spark, path)) == 4
    assert len(versions.prune(spark, path, keep=1)) == 3 and versions.read(spark, path).count() == 9


def test_a_plain_folder_comes_back_when_its_swap_fails(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/export"
    versions.swapped(spark, path, write(spark.range(3)))

    def gone(beside):
        spark.range(4).write.parquet(beside)
        shutil.rmtree(beside)  # what is to be renamed is not there

    with pytest.raises(Exception):
        versions.swapped(spark, path, gone)
    assert spark.read.parquet(path).count() == 3
    versions.swapped(spark, path, write(spark.range(4)))
    assert spark.read.parquet(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["export"]


def test_built_only_when_the_week_is_new(spark, tmp_path):
    path, built = f"{tmp_path}/digest", []

    def build(week):
        def run():
            built.append(week)
            if week == "bad":
                raise ValueError
            return spark.createDataFrame([(week,)], "week string")

        return run

    assert ingest.rebuilt_when_stale(spark, path, "KW02", build("KW02"))
    assert not ingest.rebuilt_when_stale(spark, path, "KW02", build("KW02"))
    with pytest.raises(ValueError):
        ingest.rebuilt_when_stale(spark, path, "KW03", build("bad"))
    assert versions.read(spark, path, "rows").first().week == "KW02"
    assert ingest.rebuilt_when_stale(spark, path, "KW03", build("KW03")) and built == ["KW02", "bad", "KW03"]


@pytest.fixture
def archive(spark, tmp_path):
    """Twelve weeks of observations as files by week, and a writer of single weeks."""
    obs = tables.observations(spark, SF)
    weeks = [r.d for r in obs.select("d").distinct().orderBy("d").limit(12).collect()]
    folder = str(tmp_path / "archive")

    def put(rows):
        rows.repartition("d").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("d").parquet(folder)

    return obs.where(F.col("d").isin(weeks)), weeks, folder, put


def expected(rows):
    return sorted(map(tuple, product_index.merged(product_index.weekly_states(rows)).where("weeks >= 2").drop("named_at").collect()), key=str)


def held(index):
    return sorted(map(tuple, index.products().collect()), key=str)


def test_only_changed_weeks_are_read_and_the_index_is_the_same(spark, archive, tmp_path):
    obs, weeks, folder, put = archive
    index = product_index.ProductIndex(spark, folder, str(tmp_path / "index"))
    put(obs.where(F.col("d") < weeks[-1]))
    assert index.update().recomputed == weeks[:-1]
    assert held(index) == expected(obs.where(F.col("d") < weeks[-1])) != []
    assert index.update() == product_index.Report([], [], [])

    put(obs.where(F.col("d") == weeks[-1]))  # a new week
    assert index.update() == product_index.Report(weeks[-1:], weeks[-1:], [])
    assert held(index) == expected(obs)

    put(obs.where(F.col("d") == weeks[3]).orderBy("face"))  # the same rows in new files
    assert index.update() == product_index.Report([weeks[3]], [], [])
    assert held(index) == expected(obs)

    cheaper = obs.withColumn("gp", F.when(F.col("d") == weeks[4], F.col("gp") / 2).otherwise(F.col("gp"))).where(~((F.col("d") == weeks[4]) & (F.col("l_linenumber") == 1)))
    put(cheaper.where(F.col("d") == weeks[4]))  # a week replaced: prices fall, products go
    assert index.update() == product_index.Report([weeks[4]], [weeks[4]], [])
    assert held(index) == expected(cheaper)

    shutil.rmtree(f"{folder}/d={weeks[0]}")
    assert index.update() == product_index.Report([], [], [weeks[0]])
    assert held(index) == expected(cheaper.where(F.col("d") > weeks[0]))


def test_a_failed_update_leaves_the_index(spark, archive, tmp_path, monkeypatch):
    obs, weeks, folder, put = archive
    index = product_index.ProductIndex(spark, folder, str(tmp_path / "index"))
    put(obs.where(F.col("d") < weeks[5]))
    index.update()
    before = held(index)
    put(obs.where(F.col("d") == weeks[5]))
    with monkeypatch.context() as m:
        m.setattr(versions, "_rename_over", lambda *_: (_ for _ in ()).throw(OSError("no rename")))
        with pytest.raises(OSError):
            index.update()
    assert held(index) == before
    assert index.update().recomputed == [weeks[5]] and isinstance(weeks[5], datetime.date)
    assert held(index) == expected(obs.where(F.col("d") <= weeks[5]))
