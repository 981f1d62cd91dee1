"""Personal lists: loyalty, affinity, recommendations, the merged shopping list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import german, norm_title

#: Receipt lines that are no products.
NO_PRODUCT = (
    r"(?iu)(pfand|\bleergut\b|\brabatt\b|\bcoupon\b|\bgutschein\b|\bsumme\b|\bgesamt\b|\bzwischensumme\b|\bpayback\b|\bkartenzahlung\b|"
    r"\bec[- ]?cash\b|\bwechselgeld\b|\br[uü]ckgeld\b|\bmwst\b|\bmehrwertsteuer\b|\bnetto\b|\bbrutto\b|\bbargeld\b|\bgegeben\b|\bvisa\b|"
    r"\bmastercard\b|\bgirocard\b|\bmaestro\b|\btrinkgeld\b)"
)
#: Groups of the shopping list, the strongest first.
GROUPS = ("offer", "custom", "pantry")


def loyalty(lines: DataFrame) -> DataFrame:
    """Per normalised name: purchases, quantity, money, last spelling (lines: name, norm, qty, spent, at).

    A quantity that is none, not positive or not finite counts as one, such a price as nothing; money
    is summed in whole cents, so that the order of the lines does not matter.
    """
    usable = lambda c, low: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & low
    qty = F.when(usable("qty", F.col("qty") > 0), F.col("qty")).otherwise(1.0)
    cents = F.when(usable("spent", F.col("spent") >= 0), F.floor(F.col("spent") * 100 + 0.5)).otherwise(0).cast("decimal(20,0)")
    kept = lines.where((F.trim("name") != "") & ~F.col("name").rlike(NO_PRODUCT) & (F.col("norm") != ""))
    sums = kept.groupBy("norm").agg(F.count(F.lit(1)).alias("c"), F.sum(qty).alias("qty"), F.sum(cents).alias("cents"), F.max_by("name", F.struct("at", "name")).alias("name"))
    return sums.select("norm", "c", "qty", (F.col("cents").cast("double") / 100).alias("spent"), "name")


def affinity(votes: DataFrame) -> DataFrame:
    """Sum of votes by tag (votes: tag, v), split by sign."""
    sums = votes.groupBy("tag").agg(F.sum("v").alias("total"))
    return sums.where("total <> 0").withColumn("side", F.when(F.col("total") > 0, "likes").otherwise("dislikes"))


def recommended(placed: DataFrame, scored: DataFrame, size: int) -> DataFrame:
    """Placed rows by rank, filled up to ``size`` with the best scored ones not among them."""
    a = placed.select("id", F.lit(0).alias("source"), F.col("rank").cast("double").alias("by"))
    b = scored.where("score > 0").join(placed.select("id"), "id", "left_anti").select("id", F.lit(1).alias("source"), (-F.col("score")).cast("double").alias("by"))
    return a.unionByName(b).orderBy("source", "by", "id").limit(size)


def best_of(scored: DataFrame, most: int) -> DataFrame:
    """The best scored rows (id, title, score), ties by title in German order."""
    return scored.where("score > 0").orderBy(F.desc("score"), german(F.coalesce("title", F.lit(""))), "title", "id").limit(most)


def merged_list(plan: DataFrame, basket: DataFrame, own: DataFrame, removed: DataFrame) -> DataFrame:
    """The shopping list of a plan's ingredients (name, grp), the basket (name) and a reader's own rows (name).

    A name that several bring is one line: of the strongest group, under that group's spelling, with
    the sources that named it; removed names go.
    """
    sources = (("plan", plan.select("name", "grp")), ("basket", basket.select("name", F.lit(GROUPS[0]).alias("grp"))), ("own", own.select("name", F.lit(GROUPS[1]).alias("grp"))))
    rows = reduce(DataFrame.unionByName, [df.select("*", F.lit(source).alias("source")) for source, df in sources])
    rows = rows.withColumn("norm", norm_title(F.col("name"))).where("norm <> ''").join(removed.select(norm_title(F.col("name")).alias("norm")), "norm", "left_anti")
    rank = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("grp"))
    best = rows.groupBy("norm").agg(F.min_by(F.struct("name", "grp"), F.struct(rank, "name")).alias("b"), F.array_sort(F.collect_set("source")).alias("sources"))
    return best.select("norm", "b.name", "b.grp", "sources")


def bought_offers(offers: DataFrame, items: DataFrame) -> DataFrame:
    """Offers (id, title) with how often a receipt had their title (items: norm, c), by normal form; 0 if never."""
    named = offers.withColumn("norm", norm_title(F.col("title")))
    return named.join(items.select("norm", "c"), "norm", "left").select("id", "title", F.coalesce("c", F.lit(0)).cast("long").alias("c"))


def shopping_list(rows: DataFrame) -> DataFrame:
    """One line a normalised name: the strongest group wins, removed names go (rows: norm, name, grp, removed)."""
    rank = F.when(F.col("grp") == GROUPS[0], 0).when(F.col("grp") == GROUPS[1], 1).otherwise(2)
    best = Window.partitionBy("norm").orderBy(rank, "name")
    gone = F.max(F.col("removed").cast("int")).over(Window.partitionBy("norm"))
    return rows.withColumns({"_at": F.row_number().over(best), "_gone": gone}).where("_at = 1 and _gone = 0").select("norm", "name", "grp")


def grouped_text(items: DataFrame) -> DataFrame:
    """The list as text, a block a group."""
    return items.groupBy("grp").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- [ ] "), F.col("name")))), "\n").alias("text"))


def most_bought(items: DataFrame, most: int = 20) -> DataFrame:
    """Names by how often they were bought (items: name, c; no count is one)."""
    return items.where("name <> ''").select("name", F.coalesce("c", F.lit(1)).alias("c")).orderBy(F.desc("c"), "name").limit(most)


def pruned_votes(votes: DataFrame, offers: DataFrame, category: str) -> DataFrame:
    """Votes (id, v) without the down-votes that a muted category makes redundant; up-votes and votes
    on what is not offered now stay."""
    redundant = offers.where(F.col("category") == category).select("id").distinct()
    return votes.where("v = -1").join(redundant, "id", "left_anti").unionByName(votes.where("v <> -1"))
