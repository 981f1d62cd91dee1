"""Session helpers shared by the operators: shared folder, staged tables, stable chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Values of the hash by which bounded samples are drawn, fine enough for any number of rows.
DRAWS = 1 << 40


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is set only where a local session names none."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larder-shared-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts in UTF-8, by which tables are cut into groups of bounded size."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


#: Bytes of a piece of a batch on average, so that very long texts come in few rows.
PIECE_BYTES = 16 << 20


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of few rows, so that Python never holds many texts at once."""
    for batch in batches:
        step = max(1, min(rows, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()  # workers outlive their tasks


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
