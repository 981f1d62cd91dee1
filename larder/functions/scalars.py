"""Small projections of offers, receipts and replies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Names of offer criteria, tags of recommendations, longest reason.
FLAG, BONUS, APP = "Superknüller", "PAYBACK", "App-Preis"
EVIDENCE_TAGS = ("bestprice", "cheap", "flag", "favorite", "loyal")
LONGEST_REASON = 90


def has_criterion(criteria: Column, name: str) -> Column:
    return F.coalesce(F.exists(criteria, lambda c: c["name"] == name), F.lit(False))


def badges(criteria: Column, points: Column, multiplier: Column) -> Column:
    """The bonus with its points, else its multiplier, and the app price."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    bonus = F.concat(F.lit(BONUS), F.coalesce(F.concat(F.lit(" +"), number(points), F.lit(" P")), F.concat(F.lit(" "), number(multiplier), F.lit("× P")), F.lit("")))
    return F.array_compact(F.array(F.when(has_criterion(criteria, BONUS), bonus), F.when(has_criterion(criteria, APP), APP)))


def shown_unit_price(basic: Column, r: Column) -> Column:
    """The quoted text, else the derived price (r, the resolved one) marked as such, else ''."""
    made = F.when(r["flag"] == "derived", F.concat(F.lit("≈ 1 "), r["unit"], F.lit(" = € "), F.format_string("%.2f", r["value"]))).otherwise("")
    return F.when(F.trim(F.coalesce(basic, F.lit(""))) != "", F.trim(basic)).otherwise(made)


def safe_url(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url)


def money(value: Column, style: str = "plain", unit: Column | None = None) -> Column:
    """12.34 €, €12.34/kg (style 'per') or 12,34 € (style 'comma')."""
    two = F.format_string("%.2f", value)
    if style == "per":
        return F.concat(F.lit("€"), two, F.lit("/"), unit)
    return F.concat(F.replace(two, F.lit("."), F.lit(",")) if style == "comma" else two, F.lit(" €"))


def finite(text: Column, comma: bool = False) -> Column:
    """A finite number from text; booleans, NaN and infinities are none."""
    t = F.trim(F.replace(text, F.lit(","), F.lit(".")) if comma else text)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def shortened(reason: Column, most: int = LONGEST_REASON) -> Column:
    return F.when(F.char_length(reason) > most, F.concat(F.rtrim(F.substring(reason, 1, most - 1)), F.lit("…"))).otherwise(reason)


def deal_prices(deals: Column) -> Column:
    """struct(price, price_max): of the first sales price; 0 is none, the maximum only if it differs."""
    sales = F.filter(deals, lambda d: d["type"] == "SALES_PRICE")[0]
    price, most = F.nullif(sales["min"], F.lit(0.0)), F.nullif(sales["max"], F.lit(0.0))
    return F.struct(price.alias("price"), F.when(~most.eqNullSafe(sales["min"]), most).alias("price_max"))


def receipt_fingerprint(store: Column, date: Column, items: Column) -> Column:
    """The same for one receipt in whatever order its lines and keys come."""
    line = lambda i: F.concat_ws("|", F.lower(F.trim(F.coalesce(i["name"], F.lit("")))), F.coalesce(i["qty"].cast("string"), F.lit("")), F.coalesce(i["price"].cast("string"), F.lit("")))
    lines = F.array_sort(F.transform(F.coalesce(items, F.array()), line))
    basis = F.struct(F.lower(F.trim(F.coalesce(store, F.lit("")))).alias("store"), F.trim(F.coalesce(date, F.lit(""))).alias("date"), lines.alias("items"))
    return F.sha2(F.to_json(basis).cast("binary"), 256)


def fresh(shown_week: Column, made_week: Column) -> Column:
    """Editorial text belongs to the week on screen, or one of the two is unknown."""
    a, b = F.coalesce(shown_week, F.lit("")), F.coalesce(made_week, F.lit(""))
    return (a == "") | (b == "") | (a == b)


def json_in(prefer: str | None = None):
    """A pandas UDF for the first JSON object that a reply holds, fenced or between prose; null if none.

    With ``prefer`` the first one that has a list of that name, if any has.
    """

    @F.pandas_udf(T.StringType())
    def find(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def objects(text: str):
            at = text.find("{")
            while at >= 0:
                try:
                    yield decoder.raw_decode(text, at)[0]
                except ValueError:
                    pass
                at = text.find("{", at + 1)

        def one(text: str | None) -> str | None:
            first = None
            for found in objects(text or ""):
                if prefer is None or isinstance(found.get(prefer), list):
                    return json.dumps(found, ensure_ascii=False)
                first = found if first is None else first
            return None if first is None else json.dumps(first, ensure_ascii=False)

        return texts.map(one)

    return find


def reply_json(text: Column, prefer: str | None = None) -> Column:
    """The JSON of a reply as VARIANT: in the JVM where the whole of it parses, else by search."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^`+[a-zA-Z]*\s*", ""), r"\s*`+$", "")
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(json_in(prefer)(text)))
