"""The product index, kept up to date from mergeable weekly states: only weeks that changed are read again."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

#: Columns of an observation that its week's hash covers.
STABLE = ("key", "title", "cat", "unit", "d", "gp", "gpf", "face", "flagged", "l_orderkey", "l_linenumber")
LEDGER = "d date, stamp string, hash string, n long, folder string"
PRODUCTS = "key string, title string, cat string, unit string, weeks long, n_obs long, low double, high double, latest double, latest_d date, first_d date, last_d date, named_at struct<d:date,l_orderkey:long,l_linenumber:int>"


@dataclass
class Report:
    """What an update did: weeks whose files it read, whose states it made anew, and that it dropped."""

    read: list[date]
    recomputed: list[date]
    dropped: list[date]


def week_hashes(rows: DataFrame) -> DataFrame:
    """Per week the number of rows and a hash of them in any order: sums of the halves of two row hashes.

    It tells changes apart within the index, where ``canonical_hash``, which is kept for others to
    compare, would spell every row as JSON.  Which columns are null is hashed too, as nulls are not.
    """
    columns = [F.col(c) for c in STABLE]
    nulls = F.array(*[c.isNull() for c in columns])
    both = [F.xxhash64(F.lit(seed), *columns, nulls) for seed in (1, 2)]
    halves = [half for h in both for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    sums = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), *[F.sum(half).alias(f"_{k}") for k, half in enumerate(halves)])
    return sums.select("d", "n", F.concat_ws("-", *[F.hex(f"_{k}") for k in range(len(halves))]).alias("hash"))


def weekly_states(obs: DataFrame) -> DataFrame:
    """Per product and week: last title and category with their place, observations, exact low, and the same as a span.

    Rows are dealt by week, as they are stored, once: a product has few rows a week, so that partial
    states would be sorted without becoming fewer.
    """
    at = F.struct("d", "l_orderkey", "l_linenumber")
    exact = F.when(F.col("gpf").isNull(), F.col("gp"))
    found = obs.repartition("d").groupBy("d", "key").agg(
        F.max_by("title", at).alias("title"), F.max_by("cat", at).alias("cat"), F.max("unit").alias("unit"),
        F.count(F.lit(1)).alias("n_obs"), F.min(exact).alias("low"), F.max(at).alias("named_at"),
    )
    week = F.when(F.col("low").isNotNull(), F.col("d"))
    return found.select("key", "title", "cat", "unit", F.lit(1).cast("long").alias("weeks"), "n_obs", "low", F.col("low").alias("high"), F.col("low").alias("latest"), week.alias("latest_d"), F.col("d").alias("first_d"), F.col("d").alias("last_d"), "named_at")


def merged(states: DataFrame) -> DataFrame:
    """States of the same products over different weeks as one state each; states of any span merge in any order."""
    return states.repartition("key").groupBy("key").agg(
        F.max_by("title", "named_at").alias("title"), F.max_by("cat", "named_at").alias("cat"), F.max("unit").alias("unit"),
        F.sum("weeks").alias("weeks"), F.sum("n_obs").alias("n_obs"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.max_by("latest", "latest_d").alias("latest"), F.max("latest_d").alias("latest_d"), F.min("first_d").alias("first_d"), F.max("last_d").alias("last_d"), F.max("named_at").alias("named_at"),
    )


class ProductIndex:
    """The index of an archive of Parquet files by week (``d=...`` folders), under ``path``.

    ``path`` holds a folder of weekly states a run and versions of (ledger, products) behind one
    pointer.  The ledger has a row a week: the stamp of its files (names, lengths, times), the hash
    of its rows, and the folder of its states.
    """

    def __init__(self, spark: SparkSession, archive: str, path: str):
        self.spark, self.archive, self.path = spark, archive.rstrip("/"), path.rstrip("/")

    def _stamps(self) -> dict[date, str]:
        """A stamp a week from file metadata alone; no file is opened."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.archive)
        files = listed.select(F.to_date(F.regexp_extract("path", r"/d=(\d{4}-\d{2}-\d{2})/", 1)).alias("d"), F.concat_ws("|", F.regexp_extract("path", "[^/]+$", 0), "length", F.unix_micros("modificationTime")).alias("file"))
        found = files.where("d is not null").groupBy("d").agg(F.md5(F.concat_ws(";", F.array_sort(F.collect_list("file"))).cast("binary")).alias("stamp"))
        return {r.d: r.stamp for r in found.collect()}  # a short row a week of the archive

    def _rows(self, weeks: list[date]) -> DataFrame:
        return self.spark.read.option("basePath", self.archive).parquet(*[f"{self.archive}/d={d}" for d in weeks]).withColumn("d", F.col("d").cast("date"))

    def _states(self, folders: list[tuple[date, str]]) -> DataFrame:
        paths = [f"{folder}/week={d}" for d, folder in folders]
        return self.spark.read.schema(PRODUCTS).parquet(*paths) if paths else self.spark.createDataFrame([], PRODUCTS)

    def ledger(self) -> DataFrame:
        return versions.read(self.spark, self.path, "ledger") if versions.current(self.spark, self.path) else self.spark.createDataFrame([], LEDGER)

    def products(self, least_weeks: int = 2) -> DataFrame:
        """The products with a history, as the current version has them."""
        return versions.read(self.spark, self.path, "products").where(F.col("weeks") >= least_weeks).drop("named_at")

    def update(self) -> Report:
        """Bring the index to the archive's present state.

        Weeks whose files have not changed are not opened.  A new week merges into the products as
        they are; where a week was replaced or removed, the products it has or had are merged anew
        from the states of their weeks.  The new version becomes current in one step; a failed run
        leaves the old one.
        """
        spark = self.spark
        known, stamps = {r.d: r for r in self.ledger().collect()}, self._stamps()
        dropped = sorted(set(known) - set(stamps))
        touched = sorted(d for d, stamp in stamps.items() if d not in known or known[d].stamp != stamp)
        hashes = {r.d: r for r in week_hashes(self._rows(touched)).collect()} if touched else {}
        changed = [d for d in touched if d not in known or known[d].hash != hashes[d].hash]
        if not touched and not dropped and known:
            return Report([], [], [])
        folder = f"{self.path}/states/{uuid.uuid4().hex}"
        if changed:
            weekly_states(self._rows(changed)).withColumn("week", F.col("first_d")).write.partitionBy("week").parquet(folder)
        fresh = self._states([(d, folder) for d in changed])
        entries = [(d, stamps[d], hashes[d].hash, hashes[d].n, folder) if d in changed else (d, stamps[d], known[d].hash, known[d].n, known[d].folder) for d in sorted(stamps)]
        stale = [(d, known[d].folder) for d in sorted({*dropped, *changed} & set(known))]
        before = versions.read(spark, self.path, "products") if known else spark.createDataFrame([], PRODUCTS)
        if stale:
            affected = self._states(stale).select("key").unionByName(fresh.select("key")).distinct()
            now = merged(self._states([(e[0], e[4]) for e in entries]).join(affected, "key", "left_semi"))
            products = before.join(affected, "key", "left_anti").unionByName(now)
        else:
            products = merged(before.unionByName(fresh))

        def write(version: str) -> None:
            products.write.parquet(f"{version}/products")
            spark.createDataFrame(entries, LEDGER).coalesce(1).write.parquet(f"{version}/ledger")

        versions.publish(spark, self.path, write)
        return Report(touched, changed, dropped)
