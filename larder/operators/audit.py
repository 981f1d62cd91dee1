"""Data-quality checks; each gives rows of (check, severity, entity, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unitprice import QUOTED, with_derived, with_quoted
from .trend import missing_weeks


def finding(df: DataFrame, check: str, severity: str, entity: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), entity.cast("string").alias("entity"), detail.cast("string").alias("detail"))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def thin_weeks(counts: DataFrame, share: float = 0.6) -> DataFrame:
    """Weeks below a share of the upper median of the week counts (d, n)."""
    upper = counts.agg(F.element_at(F.sort_array(F.collect_list("n")), (F.count(F.lit(1)) / 2).cast("int") + 1).alias("upper"))
    return counts.join(F.broadcast(upper), F.col("n") < F.col("upper") * share).select("d", "n", "upper")


def swings(obs: DataFrame, most: float = 8.0) -> DataFrame:
    """Series whose exact positive unit prices differ by more than a factor."""
    ends = obs.where("gpf is null and gp > 0").groupBy("key").agg(F.min("gp").alias("low"), F.max("gp").alias("high"))
    return ends.where(F.col("high") > F.col("low") * most)


def contradictions(offers: DataFrame, text: str, face: str, most: float = 3.0) -> DataFrame:
    """Quoted exact unit prices that the pack size, read without the quote, contradicts."""
    bare = F.regexp_replace(text, rf"\(?{QUOTED}\)?", "")
    one = with_quoted(offers, F.col(text), "q").where("q.flag = 'exact' and q.value > 0")
    both = with_derived(one, bare, F.col(face), "dv").where("dv is not null and q.unit = dv.unit and dv.value > 0")
    ratio = F.col("dv.value") / F.col("q.value")
    return both.withColumn("ratio", ratio).where((F.col("ratio") > most) | (F.col("ratio") < 1 / most))


def report(obs: DataFrame) -> DataFrame:
    """All checks of an observation table in one table of findings."""
    weeks = obs.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    dates = obs.select(F.lit("archive").alias("key"), "d").distinct()
    found = [
        finding(repeated_keys(obs, "l_orderkey", "l_linenumber"), "repeated id", "note", F.concat_ws("/", "l_orderkey", "l_linenumber"), F.col("n")),
        finding(thin_weeks(weeks), "thin week", "fail", F.col("d"), F.col("n")),
        finding(swings(obs), "swing", "note", F.col("key"), F.floor(F.col("high") / F.col("low"))),
        finding(missing_weeks(dates), "missing week", "fail", F.col("missing"), F.lit("")),
        finding(obs.where("title is null or cat is null"), "no title or category", "fail", F.col("key"), F.lit("")),
    ]
    return reduce(DataFrame.unionByName, found)


def previous_gap(dates: DataFrame) -> DataFrame:
    """Days since the week before, by key."""
    return dates.withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy("key").orderBy("d"))))


def misfiled(snapshots: DataFrame) -> DataFrame:
    """Snapshots (file, year, kw, d, valid_from) whose folder and date are not those their offers begin with."""
    label = F.concat(F.lit("KW"), F.lpad(F.weekofyear("valid_from").cast("string"), 2, "0"))
    return snapshots.where(F.col("valid_from").isNull() | (F.col("kw") != label) | (F.col("valid_from") != F.col("d")))


def repeated_weeks(rows: DataFrame) -> DataFrame:
    """Dates that several files begin with, and how many titles all of them share (rows: valid_from, file, title)."""
    files = rows.groupBy("valid_from").agg(F.count_distinct("file").alias("files")).where("files > 1")
    each = rows.groupBy("valid_from", "title").agg(F.count_distinct("file").alias("held"))
    shared = each.join(files, "valid_from").groupBy("valid_from", "files")
    return shared.agg(F.count_if(F.col("held") == F.col("files")).alias("shared"))


def unusable(offers: DataFrame, most: float) -> DataFrame:
    """Offers (id, title, category, face) without a title or category, or with a price beyond reason."""
    named = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("category", F.lit("")) != "")
    lacks = finding(offers.where(~named), "no title or category", "fail", F.col("id"), F.col("title"))
    bad = finding(offers.where(F.col("face").isNull() | ~F.col("face").between(0, most)), "unusable price", "note", F.col("id"), F.col("face"))
    return lacks.unionByName(bad)


def coverage(weeks: DataFrame, share: float = 0.95) -> DataFrame:
    """Weeks (d, have, total) from the first archived one on whose images are not complete."""
    first = weeks.where("have > 0").agg(F.min("d").alias("first"))
    return weeks.join(F.broadcast(first), F.col("d") >= F.col("first")).where(F.col("total") > 0).where(F.col("have") / F.col("total") < share).select("d", "have", "total")


def gaps(dates: DataFrame, known: DataFrame) -> DataFrame:
    """Missing weeks by key, and whether each is known to be missing for good (known: missing)."""
    marked = known.select("missing", F.lit(True).alias("known")).distinct()
    return missing_weeks(dates).join(marked, "missing", "left").select("key", "missing", F.coalesce("known", F.lit(False)).alias("known"))


def sibling_report(snapshots: DataFrame, keys: DataFrame, known: DataFrame, least: int = 20, share: float = 0.9) -> DataFrame:
    """The checks of a sibling archive.

    snapshots: source, year, kw, d, week_start, total (declared, may be null), n; keys: source, d,
    key; known: missing.
    """
    label = F.concat(F.lit("KW"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    wrong = ~F.col("week_start").eqNullSafe(F.col("d")) | (F.dayofweek("d") != 2) | (F.col("kw") != label) | (F.col("year") != F.year("d").cast("string"))
    name, g = F.concat_ws("/", "source", "d"), gaps(snapshots.select(F.col("source").alias("key"), "d").distinct(), known)
    found = [
        finding(snapshots.where(wrong), "misfiled", "fail", name, F.col("week_start")),
        finding(g.where("not known"), "missed week", "fail", F.col("key"), F.col("missing")),
        finding(g.where("known"), "known gap", "note", F.col("key"), F.col("missing")),
        finding(snapshots.where(F.col("n") < least), "thin", "fail", name, F.col("n")),
        finding(snapshots.where((F.col("total") > 0) & (F.col("n") < share * F.col("total"))), "short of declared", "fail", name, F.col("n")),
        finding(repeated_keys(keys.where("key is not null"), "source", "d", "key"), "repeated key", "fail", F.concat_ws("/", "source", "d", "key"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, found)
