"""Joins of titles and sets: tolerant matches, ordered one-to-one matches, collisions, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_key, norm_title, token_key


def tolerant_matches(titles: DataFrame, products: DataFrame) -> DataFrame:
    """title -> products by exact, compact or sorted-word key, the first kind that hits each product."""
    hits = []
    for rank, form in enumerate((norm_title, compact_key, token_key)):
        left = titles.select("title", form(F.col("title")).alias("k")).where("k <> ''")
        right = products.select(F.col("key"), form(F.col("title")).alias("k"))
        hits.append(left.join(right, "k").select("title", "key", F.lit(rank).alias("how")))
    return reduce(DataFrame.unionByName, hits).groupBy("title", "key").agg(F.min("how").alias("how"))


def one_to_one(wanted: DataFrame, offers: DataFrame, on: str, wanted_order: Column, offer_order: Column) -> DataFrame:
    """Each wanted row takes the first offer of its title that none before it took."""
    w = wanted.withColumn("turn", F.row_number().over(Window.partitionBy(on).orderBy(wanted_order)))
    o = offers.withColumn("turn", F.row_number().over(Window.partitionBy(on).orderBy(offer_order)))
    return w.join(o, [on, "turn"]).drop("turn")


def resolve_collisions(rows: DataFrame, keys: list[str], price: str, arrival: Column) -> DataFrame:
    """One row a key: a priced one before an unpriced, then the cheaper, then the first."""
    order = Window.partitionBy(*keys).orderBy(F.col(price).asc_nulls_last(), arrival)
    return rows.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def first_wins(rows: DataFrame, key: str, arrival: Column) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    order = Window.partitionBy(key).orderBy(arrival)
    keyed = rows.where(F.col(key).isNotNull()).withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """What only one side has, with the side."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def marked_links(texts: DataFrame, titles: DataFrame, key: str, text: str) -> DataFrame:
    """[[title|label]] markers of each text with the title they name; unknown ones have none.

    A label that drops a diet word of its title is replaced by the title.
    """
    pair = r"\[\[([^|\]]+)\|([^\]]+)\]\]"
    marks = F.arrays_zip(F.regexp_extract_all(text, F.lit(pair), 1).alias("t"), F.regexp_extract_all(text, F.lit(pair), 2).alias("l"))
    each = texts.select(key, F.posexplode(marks).alias("at", "m")).select(key, "at", F.trim("m.t").alias("raw"), F.trim("m.l").alias("label"))
    first = titles.groupBy(norm_title(F.col("title")).alias("k")).agg(F.min("title").alias("title"))
    joined = each.withColumn("k", norm_title(F.col("raw"))).join(first, "k", "left")
    diet = "(?i)veggie|vegan|vegetarisch|fleischfrei"
    drops = F.col("title").rlike(diet) & ~F.col("label").rlike(diet)
    return joined.select(key, "at", "raw", "title", F.when(drops, F.col("title")).otherwise(F.col("label")).alias("label"))


def first_of_title(rows: DataFrame, offers: DataFrame, order: Column) -> DataFrame:
    """Each row with the first offer of its title, if there is one (rows: title; offers: title, id)."""
    first = offers.groupBy("title").agg(F.min_by("id", order).alias("offer"))
    return rows.join(first, "title", "left")


def basket(kept: DataFrame, offers: DataFrame) -> DataFrame:
    """Basket entries (id, kept_title) with this week's title and price, else the title they were kept under."""
    now = offers.select("id", F.col("title").alias("now"), F.col("price").alias("now_price"))
    joined = kept.join(now, "id", "left")
    return joined.select("id", F.coalesce("now", "kept_title").alias("name"), F.col("now").isNotNull().alias("offered"), F.col("now_price").alias("price"))


def ingredients(lines: DataFrame, offers: DataFrame) -> DataFrame:
    """Ingredient lines (meal, name, offer_title) with the group they belong to and the first offer of that title."""
    linked = first_of_title(lines.withColumnRenamed("offer_title", "title"), offers, F.col("id"))
    return linked.select("meal", "name", F.when(F.col("title").isNotNull(), "offer").otherwise("pantry").alias("grp"), "offer")


def current_brochures(brochures: DataFrame, retailers: DataFrame, monday: Column, most: int) -> DataFrame:
    """The first brochures of each retailer whose week is the current one or later.

    brochures: brochure, publisher, valid_from; retailers: retailer, publisher (exact names).
    """
    week = F.date_trunc("week", F.col("valid_from") + F.expr("interval 6 hours")).cast("date")
    mine = brochures.withColumn("week", week).where(F.col("week") >= monday).join(retailers, "publisher")
    place = F.row_number().over(Window.partitionBy("retailer").orderBy("valid_from", "brochure"))
    return mine.withColumn("place", place).where(F.col("place") <= most).select("retailer", "place", "brochure", "week")


def disagreements(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Verdicts of two engines side by side, column by column: key, column, left, right where they differ."""
    names = [c for c in left.columns if c != key]
    a = left.select(key, F.struct(*names).alias("a"))
    b = right.select(key, F.struct(*names).alias("b"))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"a.{n}").cast("string").alias("x"), F.col(f"b.{n}").cast("string").alias("y")) for n in names])
    each = a.join(b, key, "full").select(key, F.explode(pairs).alias("p"))
    return each.where(~F.col("p.x").eqNullSafe(F.col("p.y"))).select(key, "p.name", F.col("p.x").alias("left"), F.col("p.y").alias("right"))
