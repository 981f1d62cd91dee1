"""Digests for a text model and the validation of its replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detectors, scalars
from ..functions.text import slugify

#: Wording of the digest's sections.
SECTION_VEGAN = "(?iu)vegan|vegetar|tofu|tempeh|seitan|planted|hafer(drink|milch)|sojadrink|sojamilch|mandeldrink|pflanzlich|veggie"
SECTION_SOFT = "(?iu)spezi|bionade|booster"
SECTION_BEER = r"(?iu)(?<![\p{L}\p{N}])bier(?![\p{L}\p{N}])|pils|radler|alkoholfrei|0[,.]0\s*%"
PER_SECTION = 18


def diet_excluded(title: Column, description: Column, category: Column, muted: tuple[str, ...]) -> Column:
    """A muted diet topic hits title or shelf, and nothing says vegan."""
    tests = {
        "meat": detectors.looks_meat(title) | (category == detectors.MEAT_SHELF),
        "fish": detectors.looks_fish(title) | (category == detectors.FISH_SHELF),
        "spirits": detectors.looks_spirits(title),
    }
    hit = F.lit(False)
    for topic in muted:
        hit = hit | F.coalesce(tests[topic], F.lit(False))
    return hit & ~detectors.looks_vegan(title, description)


def sections(title: Column, category: Column, flagged: Column) -> Column:
    """The sections an offer belongs to; it may be in several."""
    beer = title.rlike(SECTION_SOFT) | ((category == detectors.CATEGORIES["drinks"]) & title.rlike(SECTION_BEER))
    parts = {"vegan": title.rlike(SECTION_VEGAN), "produce": category == detectors.CATEGORIES["produce"], "beer": beer, "flagged": flagged}
    return F.array_compact(F.array(*[F.when(c, name) for name, c in parts.items()]))


def sectioned(offers: DataFrame, muted: tuple[str, ...] = (), most: int = PER_SECTION) -> DataFrame:
    """Candidates by section: offers with evidence first, best ones before, then the lowest percentile.

    offers: id, title, description, category, flagged, best, pctile (null without evidence).
    """
    kept = offers.where(~diet_excluded(F.col("title"), F.col("description"), F.col("category"), muted))
    each = kept.withColumn("section", F.explode(sections(F.col("title"), F.col("category"), F.col("flagged"))))
    order = Window.partitionBy("section").orderBy(*by_evidence())
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def validated(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Recommendations (reply, rank, title, reason, tag) with verbatim titles, ranked anew from 1."""
    known = ranked.join(candidates.select("title").distinct(), "title", "left_semi")
    place = F.row_number().over(Window.partitionBy("reply").orderBy("rank", "title"))
    tag = F.when(F.col("tag").isin(*scalars.EVIDENCE_TAGS), F.col("tag")).otherwise("")
    return known.select("reply", "title", place.alias("rank"), scalars.shortened(F.coalesce("reason", F.lit(""))).alias("reason"), tag.alias("tag"))


def verbatim_share(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per reply the number of titled entries and the percentage that are candidates."""
    known = candidates.select("title").distinct().withColumn("known", F.lit(1))
    joined = ranked.where("title <> ''").join(known, "title", "left")
    return joined.groupBy("reply").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg(F.coalesce("known", F.lit(0))) * 100 + 0.5).cast("long").alias("verbatim_pct"))


def meals(raw: DataFrame, candidates: DataFrame, days: int = 7, bench: int = 5) -> DataFrame:
    """Meals (reply, pos, title, ingredients) with a title and ingredients, one a slug: a plan, then a bench.

    An ingredient whose offer is no candidate becomes a pantry item.  Replies with too few meals for
    the plan give none.
    """
    named = raw.where("trim(title) <> '' and size(ingredients) > 0").withColumn("slug", slugify(F.col("title")))
    first = Window.partitionBy("reply", "slug").orderBy("pos")
    one = named.withColumn("_at", F.row_number().over(first)).where("_at = 1")
    place, total = Window.partitionBy("reply").orderBy("pos"), Window.partitionBy("reply")
    one = one.withColumns({"place": F.row_number().over(place), "n": F.count(F.lit(1)).over(total)}).where((F.col("n") >= days) & (F.col("place") <= days + bench))
    each = one.select("reply", "place", "slug", "title", F.explode("ingredients").alias("i"))
    offers = candidates.select(F.col("title").alias("offer")).distinct()
    joined = each.join(offers, F.col("i.offerTitle") == F.col("offer"), "left")
    item = F.struct(F.trim("i.name").alias("name"), F.col("offer").alias("offerTitle"), F.col("offer").isNull().alias("pantry"))
    lists = joined.groupBy("reply", "place", "slug", "title").agg(F.array_sort(F.collect_list(item)).alias("ingredients"))
    return lists.withColumn("part", F.when(F.col("place") <= days, "day").otherwise("bench"))


def preference_summary(interests: DataFrame) -> DataFrame:
    """Interests (user, topic, level) as text: loves, likes, off."""
    names = lambda level: F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.col("topic")))), ", ")
    return interests.groupBy("user").agg(names(2).alias("loves"), names(1).alias("likes"), names(-1).alias("off"))


def taste_summary(interests: DataFrame, votes: DataFrame, bought: DataFrame, most: int = 20) -> DataFrame:
    """``preference_summary`` with the titles voted up and down (user, title, v) and the items most often bought (user, name, c)."""
    titles = lambda v: F.array_join(F.array_sort(F.collect_set(F.when(F.col("v") == v, F.col("title")))), ", ")
    voted = votes.groupBy("user").agg(titles(1).alias("up"), titles(-1).alias("down"))
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("c"), "name"))
    items = bought.withColumn("place", place).where(F.col("place") <= most).groupBy("user")
    loyal = items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("name", F.lit(" ×"), F.col("c").cast("string")).alias("shown")))), lambda x: x["shown"]), ", ").alias("loyal"))
    both = preference_summary(interests).join(voted, "user", "full").join(loyal, "user", "full")
    return both.select("user", *[F.coalesce(c, F.lit("")).alias(c) for c in ("loves", "likes", "off", "up", "down", "loyal")])


def effective_levels(defaults: dict[str, int], stored: DataFrame) -> DataFrame:
    """Default and stored interest levels (topic, level); a stored valid one wins, else the default, else 0."""
    spark = stored.sparkSession
    base = spark.createDataFrame(list(defaults.items()), "topic string, usual int")
    valid = stored.where(F.col("level").isin(*detectors.LEVEL_WEIGHTS)).select("topic", "level")
    return base.join(valid, "topic", "full").select("topic", F.coalesce("level", "usual", F.lit(0)).alias("level"))


#: Sections that a digest must introduce.
REQUIRED_SECTIONS = ("vegan", "obstgemuese", "bierspezi", "knueller")


def missing_sections(replies: DataFrame, required: tuple[str, ...] = REQUIRED_SECTIONS) -> DataFrame:
    """Per reply (reply, sections) the required sections it lacks, in order."""
    return replies.select("reply", F.array_sort(F.array_except(F.array(*map(F.lit, required)), "sections")).alias("missing")).where("size(missing) > 0")


def by_evidence() -> list[Column]:
    """Rows with evidence first, best prices before others, then the lowest percentile, then the id."""
    return [F.col("pctile").isNull(), F.coalesce(~F.col("best"), F.lit(True)), F.coalesce("pctile", F.lit(100)), F.col("id")]


def vegan_candidates(offers: DataFrame, most: int = 40) -> DataFrame:
    """Produce and whatever says vegan in its title, genuine deals first (offers as for ``sectioned``)."""
    picked = (F.col("category") == detectors.CATEGORIES["produce"]) | F.col("title").rlike(SECTION_VEGAN)
    return offers.where(picked).orderBy(*by_evidence()).limit(most)
