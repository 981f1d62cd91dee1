"""Which files exist: a listing as a table, and what offers and files lack of each other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store(rows: DataFrame, folder: str) -> int:
    """Write rows (path, content) as files below a folder that all tasks share; gives their number.

    Tasks write the files where they belong, by Arrow's file systems (file, hdfs, s3, gs, abfs): names
    are given, none is moved by the driver, and a task that runs again writes the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                below = f"{root}/{path}".rpartition("/")[0]
                if below not in made:
                    files.create_dir(below)
                    made.add(below)
                with files.open_output_stream(f"{root}/{path}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def existing(spark: SparkSession, folders: list[str], glob: str = "*", named: str = r"([^/]+)\.[^./]*$") -> DataFrame:
    """Files below folders as a table: folder, name (by the pattern's first group), length, path.

    Only names, lengths and times are read, no content; many folders are listed by tasks.  Folders
    that do not exist have no files, and empty files, which hold no image, are passed over.
    """
    there = [f for f in folders if _is_there(spark, f)]
    empty = spark.createDataFrame([], "folder string, name string, length long, path string")
    if not there:
        return empty
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(there)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return listed.select(folder.alias("folder"), F.regexp_extract("path", named, 1).alias("name"), "length", "path").where("name <> ''")


def listed(folders: DataFrame, named: str = r"([^/]+)\.[^./]*$") -> DataFrame:
    """Files right in folders (folder) that ``store`` wrote to, as ``existing`` has them; empty ones are passed over.

    A task lists the folders of its partition, by the file systems of ``store``, so that no listing passes the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, root = fs.FileSystem.from_uri(folder)
                found = [f for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File and f.size]
                columns = [pa.array([folder] * len(found), pa.string()), pa.array([f.size for f in found], pa.int64()), pa.array([f"{folder}/{f.base_name}" for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["folder", "length", "path"])

    found = folders.select("folder").mapInArrow(run, "folder string, length long, path string")
    return found.select("folder", F.regexp_extract("path", named, 1).alias("name"), "length", "path").where("name <> ''")


def _is_there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def archived(offers: DataFrame, files: DataFrame) -> DataFrame:
    """Offers (d, id) with whether a file of their name is there; offers without an id have none to look for."""
    names = files.select(F.col("name").alias("id")).distinct().withColumn("there", F.lit(True))
    return offers.where("id is not null").join(names, "id", "left").select("d", "id", F.coalesce("there", F.lit(False)).alias("there"))


def by_week(offers: DataFrame, files: DataFrame) -> DataFrame:
    """Per week how many offers have their file, of how many; what ``audit.coverage`` reads."""
    return archived(offers, files).groupBy("d").agg(F.count_if("there").alias("have"), F.count(F.lit(1)).alias("total"))


def missing(offers: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of offers whose file is not there."""
    return offers.where("id is not null").select("id").distinct().join(files.select(F.col("name").alias("id")), "id", "left_anti")


def orphaned(offers: DataFrame, files: DataFrame) -> DataFrame:
    """Files that no offer names."""
    return files.join(offers.select(F.col("id").alias("name")).distinct(), "name", "left_anti").select("name", "path")
