"""Worked values of the text, unit price and detector functions."""

import pytest
from pyspark.sql import functions as F

from larder.functions import detectors, text
from larder.functions import unitprice as up


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def added(spark, add, *columns, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return add(spark.createDataFrame([tuple(values.values())], schema), *map(F.col, columns), "x").first()["x"]


@pytest.mark.parametrize(("raw", "value"), [("12.50", 12.5), ("1,99", 1.99), ("1.234,56", 1234.56), ("1.2.3", None), ("1d", None), ("NaN", None), ("", None), (None, None)])
def test_parse_number(spark, raw, value):
    assert one(spark, text.parse_number(F.col("s")), s=raw) == value


def test_round2_is_half_up(spark):
    assert one(spark, up.round2(F.col("x")), x=0.495) == 0.5


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("1 kg = € 12.50", (12.5, "kg", "exact")), ("1 l = ab € 0.12", (0.12, "l", "lower")), ("1 l = € 15.27 / € 45.80", (15.27, "l", "range")),
        ("1 WA = € 0,20", (0.2, "WA", "exact")), ("1 Tab = € 0,20", (0.2, "Tab", "exact")), ("frisch", None), (None, None),
    ],
)
def test_quoted(spark, raw, expected):
    got = added(spark, up.with_quoted, "s", s=raw)
    assert (got and (got.value, got.unit, got.flag)) == expected


@pytest.mark.parametrize(
    ("raw", "face", "expected"),
    [
        ("1 kg Schale", 1.29, (1.29, "kg")), ("2 Stück Packung", 0.99, (0.5, "St")), ("6 x 0,33 l", 3.0, None), ("2 Stück à 50 g", 3.0, None),
        ("offene 400 g Schale", 3.0, None), ("je 200 g / 250 g Packung", 3.0, None), ("20 Stück = 1000 g Beutel", 4.0, (4.0, "kg")), ("", 1.0, None),
        ("30 Caps", 6.0, (0.2, "Tab")), ("1 Cap", 0.5, (0.5, "Tab")), ("30 Tabs", 6.0, (0.2, "Tab")), ("20 WL", 5.0, (0.25, "WA")), ("3 Stk", 3.0, (1.0, "St")),
    ],
)
def test_derived(spark, raw, face, expected):
    got = added(spark, up.with_derived, "s", "f", s=raw, f=face)
    assert (got and (got.value, got.unit)) == expected


@pytest.mark.parametrize(("raw", "bucket"), [("0,33 l", "v-1"), ("1,5 l", "v0"), ("250 ml", "v-1"), ("300 ml", "v-1"), ("je 36 - 64 Tabs", "c1"), ("Pfand", "?"), (None, "?")])
def test_size_bucket(spark, raw, bucket):
    assert added(spark, up.with_size_bucket, "s", s=raw) == bucket


def test_face_price(spark):
    f = lambda r, v=None: one(spark, up.face_price(F.col("r"), F.col("v")), r=r, v=v)
    assert f(0.0) == 0.0
    assert f(47150.0) is None
    assert one(spark, up.face_price(F.col("r").try_cast("double"), F.col("v")), r=None, v="2.5") == 2.5


@pytest.mark.parametrize(
    ("title", "meat", "fish", "spirits"),
    [
        ("Rumänien", False, False, False), ("Bacardi Rum", False, False, True), ("Limetten", False, False, False), ("WC-Ente", False, False, False),
        ("Wiener Boden", False, False, False), ("Wiener", True, False, False), ("HÄHNCHENBRUST", True, False, False), ("Lachsfilet", False, True, False),
        ("Jackdaniel's", False, False, True), ("Jack Daniel's", False, False, True),
    ],
)
def test_detectors(spark, title, meat, fish, spirits):
    t = F.col("t")
    assert (one(spark, detectors.looks_meat(t), t=title), one(spark, detectors.looks_fish(t), t=title), one(spark, detectors.looks_spirits(t), t=title)) == (meat, fish, spirits)


def test_vegan_exemption_and_topics(spark):
    at = lambda name, **v: one(spark, detectors.topic(name, *map(F.col, "tdc"), F.lit(False)), **({"t": "", "d": "", "c": ""} | v))
    assert at("meat", t="veggie Würstchen", c="Fleisch & Wurst") is False
    assert at("meat", t="Aufschnitt", c="Fleisch & Wurst") is True
    assert at("coffee", t="prodomo", d="gemahlener Bohnenkaffee") is True
    assert at("spezi", t="Fischspezialitäten") is False
    assert at("beer", t="Kellerbier", c="Getränke") is True


@pytest.mark.parametrize(("a", "b"), [("caffe", "Caffè"), ("kase", "Käse"), ("suss", "Süß")])
def test_search_fold(spark, a, b):
    assert one(spark, text.search_fold(F.col("s")), s=b) == a


def test_tolerant_titles(spark):
    assert one(spark, text.compact_key(F.col("s")), s="Schlemmer-Filet") == one(spark, text.compact_key(F.col("s")), s="Schlemmerfilet")
    assert one(spark, text.token_key(F.col("s")), s="Birne oder Apfel") == one(spark, text.token_key(F.col("s")), s="Apfel oder Birne")


def test_norm_desc(spark):
    assert one(spark, text.norm_desc(F.col("s")), s="je 8 x 25-g-Pckg.") == one(spark, text.norm_desc(F.col("s")), s="8 x 25-g-Pckg.")


@pytest.mark.parametrize(("s", "to"), [("Maisgrieß", "Maisgrieß"), ("Sojadrink", "Sojadrink"), ("Nudeln", "glutenfreie Nudeln"), ("Brot und Mehl", "glutenfreies Brot und glutenfreies Mehl"), (None, None)])
def test_ordered_replacement(spark, s, to):
    assert one(spark, text.gluten_free(F.col("s")), s=s) == to
