"""What a reader sees: category and flag filters, searches, the browse order, discoveries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_umlauts, german, search_fold

#: The categories that are hidden until a reader asks for them.
HIDDEN = ("Fleisch & Wurst", "Drogerie", "Tiernahrung", "Fisch & Meeresfrüchte")
#: Rows of a search result, and the shortest token that may name a topic.
MOST_HITS, TOPIC_TOKEN = 50, 3


def active_categories(seen: DataFrame, hidden: tuple[str, ...] = HIDDEN) -> DataFrame:
    """All categories that were ever seen, but for the hidden ones."""
    return seen.where(F.col("category").isNotNull() & ~F.col("category").isin(*hidden)).select("category").distinct()


def allowed(offers: DataFrame, active: DataFrame, only_flagged: bool = False) -> DataFrame:
    """The offers of active categories, of these the flagged ones if asked for."""
    kept = offers.where("flagged") if only_flagged else offers
    return kept.join(active, "category", "left_semi")


def title_or_description(offers: DataFrame, term: str, most: int = MOST_HITS) -> DataFrame:
    """The first offers, by title, whose title or description holds the term, whatever the case."""
    low = term.strip().lower()
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(low)) for c in ("title", "description")])
    return offers.where(hit).orderBy("title", "id").limit(most)


def all_tokens(hay: Column, query: str, topics: dict[str, Column]) -> Column:
    """Whether each token of a folded query is in the text or in the label of a topic that the offer has.

    topics: label -> test.  Tokens of fewer than ``TOPIC_TOKEN`` letters name no topic.
    """
    labels = F.array(*[F.when(test, search_fold(F.lit(label))) for label, test in topics.items()])
    of_topic = lambda token: F.exists(labels, lambda label: F.coalesce(F.contains(label, token), F.lit(False)))
    tokens = F.filter(F.split(F.trim(search_fold(F.lit(query))), r"\s+"), lambda t: t != "")
    return F.forall(tokens, lambda t: F.contains(hay, t) | ((F.char_length(t) >= TOPIC_TOKEN) & of_topic(t)))


def browsed(offers: DataFrame) -> DataFrame:
    """What is shown first, then what is hidden, each by title in German order (offers: id, title, hidden)."""
    return offers.orderBy("hidden", german(F.coalesce("title", F.lit(""))), "title", "id")


def table_order(column: str, up: bool = True, collated: bool = True) -> list[Column]:
    """Sort keys of one table column: what is missing ('' counts) comes last whatever the direction."""
    text = F.lower(F.coalesce(column, F.lit("")))
    key = german(text) if collated else text
    return [text == "", key.asc() if up else key.desc(), F.col(column).asc() if up else F.col(column).desc()]


def typeahead(products: DataFrame, term: str) -> DataFrame:
    """Products (key, title, cat, weeks) whose title or category holds the term, umlauts written out or not.

    They come grouped by category, '—' for none, with their place in its group: the longest histories first.
    """
    hay = fold_umlauts(F.concat_ws(" ", "title", F.coalesce("cat", F.lit(""))))
    hits = products.where(F.contains(hay, fold_umlauts(F.lit(term)))).withColumn("grp", F.coalesce(F.nullif("cat", F.lit("")), F.lit("—")))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("weeks"), "title", "key")))


def shown_and_hidden(offers: DataFrame) -> DataFrame:
    return offers.agg(F.count_if("hidden").alias("hidden"), F.count_if(~F.col("hidden")).alias("shown"))


def discoveries(offers: DataFrame, placed: DataFrame, most: int = 2) -> DataFrame:
    """Genuine deals outside a reader's interests: not placed, not vetoed, of score 0, not voted down.

    offers: id, vetoed, score, vote, tier; the best tier comes first.
    """
    open_ = offers.where("not vetoed and score = 0 and vote <> -1 and tier in ('best', 'good')")
    return open_.join(placed.select("id"), "id", "left_anti").orderBy(F.col("tier") != "best", "id").limit(most)
