"""Per-week and per-category aggregates behind the trend views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unitprice import round6


def category_counts(obs: DataFrame) -> DataFrame:
    return obs.where("cat is not null and cat <> ''").groupBy("d", "cat").agg(F.count(F.lit(1)).alias("n"))


def week_figures(obs: DataFrame, most: float) -> DataFrame:
    """Per week: offers, flagged and bonus offers, share with an exact unit price, mean and median sane face price."""
    face = F.when(F.col("face").between(0, most), F.col("face"))
    return obs.groupBy("d").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("flagged").alias("flagged"), F.count_if("bonus").alias("bonus"),
        round6(F.count_if(F.col("gpf").isNull()) / F.count(F.lit(1))).alias("coverage"), round6(F.avg(face)).alias("avg_face"), F.median(face).alias("med_face"),
    )


def trend_index(obs: DataFrame, most: float) -> DataFrame:
    """The trend index: a row a week with a map of its category counts."""
    counts = category_counts(obs).groupBy("d").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cat", "n")))).alias("counts"))
    return week_figures(obs, most).join(counts, "d", "left").orderBy("d")


def category_prices(obs: DataFrame, most: float) -> DataFrame:
    """Per category: offers, mean over the priced ones (0 if none), least, median, greatest, span."""
    face = F.when(F.col("face").between(0, most), F.col("face"))
    return obs.groupBy("cat").agg(
        F.count(F.lit(1)).alias("n"), round6(F.coalesce(F.avg(face), F.lit(0.0))).alias("mean"), F.min(face).alias("low"), F.median(face).alias("med"),
        F.max(face).alias("high"), (F.max(face) - F.min(face)).alias("span"),
    )


def delta_to_previous(counts: DataFrame) -> DataFrame:
    """Change of category counts from the last week before the latest to the latest."""
    days = counts.select("d").distinct().orderBy(F.desc("d")).limit(2)
    ends = F.broadcast(days.agg(F.max("d").alias("cur"), F.min("d").alias("prev")))
    near = counts.join(ends, F.col("d").isin(F.col("cur"), F.col("prev")))
    sums = near.groupBy("cat").agg(F.sum(F.when(F.col("d") == F.col("cur"), F.col("n")).otherwise(0)).alias("now"), F.sum(F.when((F.col("d") == F.col("prev")) & (F.col("prev") < F.col("cur")), F.col("n")).otherwise(0)).alias("before"))
    return sums.withColumn("delta", F.col("now") - F.col("before"))


def seasonality(counts: DataFrame) -> DataFrame:
    """Mean weekly count by month and category; a category missing in a week counts as 0 in it."""
    weeks = counts.select("d").distinct().groupBy(F.month("d").alias("month")).agg(F.count(F.lit(1)).alias("weeks"))
    sums = counts.groupBy(F.month("d").alias("month"), "cat").agg(F.sum("n").alias("n"))
    # Months (12 at most) by categories: the frame of the report, not of the data.
    frame = weeks.crossJoin(F.broadcast(counts.select("cat").distinct()))
    return frame.join(sums, ["month", "cat"], "left").select("month", "cat", round6(F.coalesce("n", F.lit(0)) / F.col("weeks")).alias("mean"))


def missing_weeks(dates: DataFrame) -> DataFrame:
    """Weeks that a gap of eleven days or more leaves out."""
    gaps = dates.withColumn("older", F.lag("d").over(Window.partitionBy("key").orderBy("d")))
    wide = gaps.where(F.datediff("d", "older") >= 11)
    return wide.select("key", F.explode(F.expr("sequence(date_add(older, 7), date_add(d, -4), interval 7 days)")).alias("missing"))
