"""Incremental ingestion: canonical hashes, write guards, deduplicated streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions


def canonical_hash(rows: DataFrame, by: str, stable: list[str]) -> DataFrame:
    """Per group a hash of its rows that neither order nor volatile columns change.

    Row hashes are summed in three parts, which partial aggregation does before the shuffle; no
    group is ever gathered.
    """
    digest = F.md5(F.to_json(F.struct(*sorted(stable))).cast("binary"))
    part = lambda k: F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)"))
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[part(k).alias(f"_{k}") for k in range(4)])
    return sums.select(by, "n", F.md5(F.concat_ws("|", "n", *[f"_{k}" for k in range(4)]).cast("binary")).alias("hash"))


class WeekSink:
    """foreachBatch target: upserts weeks, never shrinks one, skips those that have not changed."""

    def __init__(self, spark: SparkSession, path: str, by: str, stable: list[str], least: int = 0):
        self.spark, self.path, self.by, self.stable, self.least = spark, path, by, stable, least

    def _stored(self, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, epoch: int = 0) -> None:
        batch = batch.persist()  # read for its hashes and again for its rows
        new = canonical_hash(batch, self.by, self.stable)
        old = canonical_hash(self._stored(batch.schema), self.by, self.stable).select(self.by, F.col("n").alias("old_n"), F.col("hash").alias("old_hash"))
        wanted = new.join(old, self.by, "left").where((F.col("n") >= self.least) & (F.col("old_n").isNull() | ((F.col("n") >= F.col("old_n")) & (F.col("hash") != F.col("old_hash")))))
        kept = batch.join(wanted.select(self.by), self.by, "left_semi")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)
        batch.unpersist()


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream to its present end through a guarded sink."""
    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def weekly_unique(events: DataFrame, id_column: str, ts: str, late: str = "7 days") -> DataFrame:
    """Counts by Monday-based week of events that count once, on batch or stream alike."""
    if events.isStreaming:
        events = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_column])
    else:
        events = events.dropDuplicates([id_column])
    weeks = events.groupBy(F.window(ts, "7 days", "7 days", "4 days")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.select(F.col("window.start").cast("date").alias("week"), "n")


def fresh_only(receipts: DataFrame, ledger: DataFrame, fingerprint: str) -> DataFrame:
    """Receipts whose fingerprint the ledger does not have."""
    return receipts.join(ledger.select(fingerprint).distinct(), fingerprint, "left_anti")


def admitted(weeks: DataFrame, least: int, share: float = 0.9) -> DataFrame:
    """Fetched weeks (n, declared) with the reason why one is turned away: too few offers, or a page lost."""
    reason = F.when(F.col("n") < least, "too few").when((F.col("declared") > 0) & (F.col("n") < share * F.col("declared")), "page lost")
    return weeks.withColumn("refused", reason)


def overdue(weeks: DataFrame, manifest: DataFrame, told: DataFrame) -> DataFrame:
    """Weeks (week, today) that the manifest lacks from Tuesday on, of which nobody has been told yet."""
    due = weeks.where(F.dayofweek("today").between(3, 7) | (F.dayofweek("today") == 1))
    return due.join(manifest.select("week"), "week", "left_anti").join(told.select("week"), "week", "left_anti")


def rebuilt_when_stale(spark: SparkSession, path: str, latest: str, build: Callable[[], DataFrame]) -> bool:
    """Build what is derived from the latest week and publish it under that week's label, unless the
    current version bears it already; says whether it was built.  A build that fails leaves the old one."""
    now = versions.current(spark, path)
    label = spark.read.text(f"{now}/label").first() if now else None
    if label and label.value == latest:
        return False

    def write(folder: str) -> None:
        build().write.parquet(f"{folder}/rows")
        spark.createDataFrame([(latest,)], "value string").coalesce(1).write.text(f"{folder}/label")

    versions.publish(spark, path, write)
    return True


def isolated(sources: dict[str, Callable[[], None]]) -> dict[str, str]:
    """Run every source; one that fails keeps none of the others from running.  Gives the errors by name."""
    errors = {}
    for name, run in sources.items():
        try:
            run()
        except Exception as e:  # whatever one source does wrong is its own
            errors[name] = f"{type(e).__name__}: {e}"
    return errors
