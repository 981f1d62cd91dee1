"""Unit prices from quoted text or pack sizes, and the product identity they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import norm, norm_title, once

#: Text formats of quoted unit prices and pack sizes, factors and display units.
QUOTED = r"1\s*([A-Za-z]{1,3})\s*=\s*(ab\s*)?€\s*([\d.,]+)(?:\s*/\s*€\s*([\d.,]+))?"
SIZE = r"(?iu)(\d+(?:[.,]\d+)?)\s*(ml|l|g|kg)(?![\p{L}\p{N}_])"
COUNT = r"(?iu)(\d+(?:[.,]\d+)?)\s*(WA|Tabs?|Caps?|St(?:ü|ue)ck|Stk|WL)(?![\p{L}\p{N}_])"
MULTIPACK = r"(?iu)\d\s*[x×]\s*\d|(?<![\p{L}\p{N}_])à(?![\p{L}\p{N}_])"
LOOSE = r"offen"
SHOWN = {"wa": "WA", "tab": "Tab", "st": "St", "stk": "St"}
COUNTED = {"stück": "st", "stueck": "st", "stk": "st", "st": "st", "wl": "wa", "wa": "wa", "tab": "tab", "cap": "tab"}
SANE_FACE = 500.0


def round2(x: Column) -> Column:
    """Half up on two decimals, as the same formula everywhere."""
    return F.floor(x * 100 + 0.5) / 100


def round6(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), key)


def sane(face: Column, most: float = SANE_FACE) -> Column:
    return F.when(face.between(0, most), face)


def face_price(raw: Column, text: Column, most: float = SANE_FACE) -> Column:
    """The numeric price (0 counts), else the parsed text; null beyond the sane ceiling."""
    parsed = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), text.try_cast("double"))
    return round2(sane(F.coalesce(raw, parsed), most))


def _dropped(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def _number(t: Column) -> Column:
    """Value of digits and marks, as ``parse_number`` reads them."""
    return F.when(t.rlike(r"^(\d+\.?\d*|\.\d+)$"), t.try_cast("double"))


def with_quoted(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add struct(value, unit, flag, low) of a quoted unit price; null where there is none.

    flag: exact, range (two values; the first is the value, the smaller one is low), lower ("ab").
    Steps are columns of their own, which the optimizer does not compute again where several later
    ones read them, and the result is one that filters are not pushed below: the pattern runs over a
    text once, its groups are read from the match alone.
    """
    at = f"_{name}_"
    c = lambda k: F.col(at + k)
    german = lambda t: F.replace(F.when(t.contains(".") & t.contains(","), F.replace(t, F.lit("."), F.lit(""))).otherwise(t), F.lit(","), F.lit("."))
    df = df.withColumn(at + "text", norm(text))
    df = df.withColumn(at + "match", F.when(c("text").contains("="), F.regexp_extract(c("text"), QUOTED, 0)))
    df = df.withColumn(at + "parts", F.when(c("match") != "", F.split(F.regexp_replace(c("match"), QUOTED, r"$1\|$2\|$3\|$4"), r"\|")))
    df = df.withColumns({at + "first": german(c("parts")[2]), at + "second": german(c("parts")[3]), at + "unit": F.lower(c("parts")[0])})
    df = df.withColumns({at + "value": _number(c("first")), at + "other": _number(c("second"))})
    flag = F.when(c("parts")[1] != "", "lower").when(c("parts")[3] != "", "range").otherwise("exact")
    made = F.struct(c("value").alias("value"), _lookup(SHOWN, c("unit")).alias("unit"), flag.alias("flag"), F.least(c("value"), c("other")).alias("low"))
    return _dropped(once(df, name, F.when(c("value").isNotNull(), made)), at)


def _with_measure(df: DataFrame, text: Column, at: str, needed: Column) -> DataFrame:
    """Add the first weight or volume of a needed text, else its first count: number, unit, and how many of each it has."""
    c = lambda k: F.col(at + k)
    df = df.withColumn(at + "text", norm(text))
    df = df.withColumn(at + "sizes", F.when(needed & c("text").rlike(r"\d"), F.regexp_extract_all(c("text"), F.lit(SIZE), 0)))
    df = df.withColumn(at + "counts", F.when(F.size(c("sizes")) == 0, F.regexp_extract_all(c("text"), F.lit(COUNT), 0)))
    df = df.withColumn(at + "first", F.coalesce(F.get(c("sizes"), 0), F.get(c("counts"), 0)))
    df = df.withColumn(at + "digits", F.regexp_extract(c("first"), r"^[\d.,]+", 0))
    unit = F.lower(F.ltrim(F.substring(c("first"), F.char_length(c("digits")) + 1, F.char_length(c("first")))))
    df = df.withColumns({at + "number": F.replace(c("digits"), F.lit(","), F.lit(".")).try_cast("double"), at + "unit": unit})  # the pattern allows one mark, a decimal one
    base = c("number") * F.when(c("counts").isNull() & c("unit").isin("ml", "g"), 0.001).otherwise(1.0)
    return df.withColumn(at + "base", F.when(base > 0, base))


#: Units of counts as they stand in a text, without a plural's s, and as they are shown.
_PIECES = {k: SHOWN.get(v, v) for k, v in COUNTED.items()}


def with_derived(df: DataFrame, text: Column, face: Column, name: str, needed: Column | None = None) -> DataFrame:
    """Add struct(value, unit) from face price over the single pack size in a text, where it is needed.

    Multipacks and loose goods have none.  Exactly one weight or volume gives a price per kg or l;
    without any, exactly one count gives one per piece; everything else is ambiguous.
    """
    at = f"_{name}_"
    c = lambda k: F.col(at + k)
    single = (face > 0) & ~norm(text).rlike(f"{MULTIPACK}|{LOOSE}")
    df = _with_measure(df, text, at, single if needed is None else needed & single)
    df = df.withColumn(at + "piece", F.when(F.size(c("counts")) == 1, F.regexp_replace(c("unit"), "s+$", "")))
    unit = F.when(F.size(c("sizes")) == 1, F.when(c("unit").isin("ml", "l"), "l").otherwise("kg")).otherwise(_lookup(_PIECES, c("piece")))
    df = df.withColumn(at + "shown", unit)
    return _dropped(once(df, name, F.when(c("base").isNotNull() & c("shown").isNotNull(), F.struct(round2(face / c("base")).alias("value"), c("shown").alias("unit")))), at)


def with_resolved(df: DataFrame, basic: Column, base_unit: Column, description: Column, face: Column, name: str) -> DataFrame:
    """Add struct(value, unit, flag): quoted (basic price, then description), else derived (base unit, then description)."""
    at = f"__{name}_"
    q, d = F.col(at + "quoted"), F.col(at + "derived")
    df = with_quoted(with_quoted(df, basic, at + "basic"), description, at + "told")
    df = df.withColumn(at + "quoted", F.coalesce(at + "basic", at + "told"))
    df = with_derived(df, base_unit, face, at + "unit", q.isNull())
    df = with_derived(df, description, face, at + "pack", q.isNull() & F.col(at + "unit").isNull())
    df = df.withColumn(at + "derived", F.coalesce(at + "unit", at + "pack"))
    as_quoted = F.when(q.isNotNull(), F.struct(q["value"].alias("value"), q["unit"].alias("unit"), q["flag"].alias("flag")))
    as_derived = F.when(d.isNotNull(), F.struct(d["value"].alias("value"), d["unit"].alias("unit"), F.lit("derived").alias("flag")))
    return _dropped(once(df, name, F.coalesce(as_quoted, as_derived)), at)


def with_size_bucket(df: DataFrame, base_unit: Column, name: str) -> DataFrame:
    """Add the order of magnitude of the pack: v or w by litres or kilograms, c by count, else '?'."""
    at = f"_{name}_"
    c = lambda k: F.col(at + k)
    df = _with_measure(df, base_unit, at, F.lit(True))
    kind = F.when(F.size(c("sizes")) == 0, "c").when(c("unit").isin("ml", "l"), "v").otherwise("w")
    return _dropped(once(df, name, F.coalesce(F.concat(kind, F.floor(F.log10(c("base"))).cast("int").cast("string")), F.lit("?"))), at)


def with_product_key(df: DataFrame, title: Column, unit: Column, base_unit: Column, name: str) -> DataFrame:
    """Add the product's identity: normal title, unit, size bucket."""
    df = with_size_bucket(df, base_unit, f"__{name}")
    return df.withColumn(name, F.concat_ws("|", norm_title(title), unit, f"__{name}")).drop(f"__{name}")
