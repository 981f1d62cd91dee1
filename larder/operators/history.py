"""Price histories: the weekly exact minimum and the statistics every ranking reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unitprice import round6

EPS = 1e-9


def weekly_exact(obs: DataFrame, *keys: str) -> DataFrame:
    """Smallest exact unit price of each product and week; ranges and lower bounds take no part."""
    keys = keys or ("key",)
    return obs.where("gpf is null and gp is not null").groupBy(*keys, "d").agg(F.min("gp").alias("gp"))


def product_stats(weekly: DataFrame) -> DataFrame:
    """Per product: number of weeks, least, median, latest price and its week."""
    return weekly.groupBy("key").agg(
        F.count(F.lit(1)).alias("weeks"), F.min("gp").alias("low"), F.max("gp").alias("high"), F.median("gp").alias("med"),
        F.max_by("gp", "d").alias("latest"), F.max("d").alias("latest_d"),
    )


def indexed(weekly: DataFrame) -> DataFrame:
    """Weeks numbered from 1 within a product, with the product's least price and number of weeks."""
    by_week, whole = Window.partitionBy("key").orderBy("d"), Window.partitionBy("key")
    return weekly.withColumns({"rn": F.row_number().over(by_week), "n": F.count(F.lit(1)).over(whole), "low": F.min("gp").over(whole)})


def weeks_since_low(weekly: DataFrame) -> DataFrame:
    """Offered weeks after the last one at the product's own low."""
    i = indexed(weekly)
    at_low = F.max(F.when(F.col("gp") <= F.col("low") + EPS, F.col("rn")))
    return i.groupBy("key").agg(F.max("n").alias("weeks"), (F.max("n") - at_low).alias("since_low"), F.max_by("gp", "d").alias("latest"), F.max("low").alias("low"))


def erosion(weekly: DataFrame) -> DataFrame:
    """Median of the last half of the weeks over that of the first, less 1; an odd middle is dropped."""
    i = indexed(weekly).where("n >= 4")
    first, last = F.median(F.when(F.expr("rn <= n div 2"), F.col("gp"))), F.median(F.when(F.expr("rn > n - n div 2"), F.col("gp")))
    return i.groupBy("key").agg(F.max("n").alias("weeks"), first.alias("first_med"), last.alias("last_med")).where("first_med > 0").withColumn("erosion", round6(F.col("last_med") / F.col("first_med") - 1))


def variation(weekly: DataFrame) -> DataFrame:
    """Coefficient of variation and regression slope over the week index, as shares of the mean."""
    i = indexed(weekly).where("n >= 4")
    found = i.groupBy("key").agg(F.max("n").alias("weeks"), F.avg("gp").alias("mean"), F.stddev_pop("gp").alias("sd"), F.regr_slope("gp", F.col("rn") - 1).alias("b"))
    return found.where("mean > 0").select("key", "weeks", round6(F.col("sd") / F.col("mean")).alias("cv"), round6(F.col("b") / F.col("mean")).alias("slope"))


def gathered(obs: DataFrame, least_weeks: int = 2) -> DataFrame:
    """The product index: identity, last title and category, number of distinct weeks, observations."""
    order = F.struct("d", "l_orderkey", "l_linenumber")
    found = obs.groupBy("key").agg(
        F.max_by("title", order).alias("title"), F.max_by("cat", order).alias("cat"), F.max("unit").alias("unit"),
        F.count_distinct("d").alias("weeks"), F.count(F.lit(1)).alias("n_obs"),
        F.array_sort(F.collect_list(F.struct("d", "gp", "gpf", "face", "flagged"))).alias("obs"),
    )
    return found.where(F.col("weeks") >= least_weeks)


def cadence(seen: DataFrame) -> DataFrame:
    """Gaps between a product's weeks: median, mean absolute deviation, regularity, next date."""
    order = Window.partitionBy("key").orderBy("d")
    gaps = seen.select("key", "d").distinct().withColumn("gap", F.datediff("d", F.lag("d").over(order)))
    med = gaps.withColumn("med", F.median("gap").over(Window.partitionBy("key")))
    found = med.groupBy("key").agg(F.max("d").alias("last"), F.count("gap").alias("gaps"), F.max("med").alias("med"), F.median(F.abs(F.col("gap") - F.col("med"))).alias("mad"))
    found = found.where("gaps >= 1")
    return found.select("key", "gaps", "med", "mad", (F.col("mad") > F.col("med") / 2).alias("irregular"), F.date_add("last", F.round("med").cast("int")).alias("next"))


def envelope(obs: DataFrame) -> DataFrame:
    """The head of the product index: the latest date and all weeks, ascending (one short row)."""
    return obs.select("d").distinct().agg(F.max("d").alias("latest"), F.array_sort(F.collect_list("d")).alias("weeks"))


def at_low(deals: DataFrame, eps: float = 0.001) -> DataFrame:
    """How many of the deals (key, over) are at their low, and the best one (ties: the smaller key)."""
    return deals.agg(F.count_if(F.col("over") <= eps).alias("at_low"), F.min_by("key", F.struct("over", "key")).alias("best"))


def newest(obs: DataFrame, by: str, *order: str, most: int = 30) -> DataFrame:
    """The newest observations of each product, newest first."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    return obs.withColumn("place", place).where(F.col("place") <= most)


def variants(obs: DataFrame, week: DataFrame) -> DataFrame:
    """The variants of each title: those offered in the week (one row, d) first, then the longest histories."""
    chosen = F.broadcast(week.select("d", F.lit(True).alias("chosen")))
    found = obs.join(chosen, "d", "left").groupBy("title", "key").agg(F.max(F.coalesce("chosen", F.lit(False))).alias("offered"), F.count(F.lit(1)).alias("n_obs"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("offered"), F.desc("n_obs"), "key")))


def weeks_offered(obs: DataFrame) -> DataFrame:
    """Per product its weeks, first and last date, and how many weeks of the archive came after the last."""
    seen = obs.groupBy("key").agg(F.count_distinct("d").alias("weeks"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    # One row a week of the archive, numbered from the newest: short whatever the number of products.
    after = obs.select("d").distinct().withColumn("since", (F.row_number().over(Window.orderBy(F.desc("d"))) - 1).cast("long"))
    return seen.join(F.broadcast(after.withColumnRenamed("d", "last_d")), "last_d")


def totals(offers: DataFrame) -> DataFrame:
    """Corpus totals by where the unit price comes from (offers: r, the resolved price, and native)."""
    found = F.col("r").isNotNull()
    derived = found & (F.col("r.flag") == "derived")
    return offers.agg(
        F.count(F.lit(1)).alias("offers"), F.count_if(found).alias("priced"), F.count_if(found & ~derived & F.col("native")).alias("native"),
        F.count_if(found & ~derived & ~F.col("native")).alias("described"), F.count_if(derived).alias("derived"),
        round6(F.count_if(derived) / F.count_if(found)).alias("derived_share"),
    )
