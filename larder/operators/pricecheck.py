"""Each week's price against the strictly earlier weeks of the same product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import EPS
from .sweep import swept


def with_prior(weekly: DataFrame) -> DataFrame:
    """Least price and number of the earlier weeks."""
    before = Window.partitionBy("key").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    return weekly.withColumns({"prior_low": F.min("gp").over(before), "prior": F.count(F.lit(1)).over(before)})


def tiers(weekly: DataFrame) -> DataFrame:
    """best / good / wait against the earlier low; null for what is unremarkable or has no history."""
    w = with_prior(weekly).withColumn("over_pct", F.when(F.col("prior_low") > 0, F.floor((F.col("gp") / F.col("prior_low") - 1) * 100 + 0.5)).otherwise(0))
    tier = F.when(F.col("prior") < 2, None).when(F.col("gp") <= F.col("prior_low") + EPS, "best").when(F.col("over_pct") <= 10, "good").when(F.col("over_pct") >= 20, "wait")
    return w.where("prior >= 2").select("key", "d", "gp", "prior_low", "prior", F.col("over_pct").cast("long").alias("over_pct"), tier.alias("tier"))


def run_length(weekly: DataFrame) -> DataFrame:
    """Consecutive weeks just before, all dearer than now: weeks since the last one that was not."""
    return swept(weekly).select("key", "d", "gp", "run")


def percentile_prior(weekly: DataFrame) -> DataFrame:
    """How many earlier weeks were cheaper, of how many (weeks with an earlier one)."""
    w = swept(weekly).where("n > 1").withColumn("prior", F.col("n") - 1)
    return w.select("key", "d", "cheaper", "prior", F.floor(F.col("cheaper") * 100 / F.col("prior") + 0.5).cast("long").alias("pctile"))


def percentile_full(weekly: DataFrame, least_weeks: int = 4) -> DataFrame:
    """Percent rank of each week in the product's whole history, of products with enough weeks."""
    whole = Window.partitionBy("key")
    ranked = weekly.select("key", "d", F.count(F.lit(1)).over(whole).alias("n"), F.percent_rank().over(whole.orderBy("gp")).alias("full"))
    return ranked.where(F.col("n") >= least_weeks).select("key", "d", "n", "full")


def evidence(weekly: DataFrame) -> DataFrame:
    """best flag, percent over the earlier low (0 at least), percentile of earlier weeks, their number."""
    w = swept(weekly).withColumn("prior", F.col("n") - 1).where("prior >= 2")
    over = F.when(F.col("prior_low") > 0, F.greatest(F.lit(0), F.floor((F.col("gp") / F.col("prior_low") - 1) * 100 + 0.5))).otherwise(0)
    return w.select("key", "d", (F.col("gp") <= F.col("prior_low") + EPS).alias("best"), over.cast("long").alias("over_pct"), F.floor(F.col("cheaper") * 100 / F.col("prior") + 0.5).cast("long").alias("pctile"), F.col("prior").alias("weeks"))
