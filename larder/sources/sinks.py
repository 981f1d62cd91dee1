"""Writers of the indexes, digests and exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import envelope, gathered
from ..operators.matching import resolve_collisions
from . import versions


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local session may name none."""
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="larder-shared-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_index(df: DataFrame, path: str, *order: str) -> None:
    """An index as Parquet, a version of its own; ``tables.index`` reads the current one."""
    versions.publish(df.sparkSession, path, lambda folder: (df.sortWithinPartitions(*order) if order else df).write.parquet(folder))


def history_export(products: DataFrame, path: str) -> None:
    """The product index with nested observations as JSON lines in a plain folder, the longest histories first."""
    versions.swapped(products.sparkSession, path, lambda beside: products.orderBy(F.desc("n_obs"), "title", "key").write.json(beside))


def write_history(obs: DataFrame, path: str) -> None:
    """The price history: products under ``path/products`` and its head (latest date, weeks) under ``path/head``."""
    write_index(gathered(obs), f"{path}/products", "title", "key")
    write_index(envelope(obs), f"{path}/head")


def as_json(df: DataFrame, columns: list[str], **meta: Column) -> DataFrame:
    """Rows as JSON text; metadata columns replace what a reply claims about itself."""
    kept = [F.col(c) for c in columns if c not in meta]
    return df.select(F.to_json(F.struct(*kept, *[v.alias(k) for k, v in meta.items()])).alias("value"))


def visible_rows(offers: DataFrame, predicate: Column) -> DataFrame:
    """The rows a reader sees, as JSON records."""
    return as_json(offers.where(predicate), ["title", "category", "price", "basic_price", "flagged", "description"])


def rekeyed(archive: DataFrame, key: Callable[[DataFrame], Column], by: str, price: str, arrival: Column) -> DataFrame:
    """An archive under recomputed ids; rows that now meet are resolved, so doing it twice changes nothing."""
    return resolve_collisions(archive.withColumn("id", key(archive)), [by, "id"], price, arrival)
