"""Text identity: normal forms, tolerant keys, folding, numbers in German grouping."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters and digits of any script end a word; Java's \b does not know umlauts.
LEFT, RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def bounded(body: str) -> str:
    """A case-insensitive pattern that matches ``body`` between word boundaries of any script."""
    return f"(?iu){LEFT}(?:{body}){RIGHT}"


def norm(s: Column) -> Column:
    """No-break spaces become spaces and outer white space goes; null is ''."""
    return F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), " ", " "), r"^\s+|\s+$", "")


def norm_title(s: Column) -> Column:
    return F.regexp_replace(F.lower(norm(s)), r"\s+", " ")


def compact_key(s: Column) -> Column:
    """Letters and digits only: hyphen, space and compound spellings meet."""
    return F.regexp_replace(norm_title(s), "[^a-z0-9äöüß]", "")


def token_key(s: Column) -> Column:
    """Sorted words: reordered spellings meet."""
    words = F.split(F.replace(norm_title(s), F.lit("-"), F.lit("")), "[^a-z0-9äöüß]+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def fold_umlauts(s: Column) -> Column:
    """Lower case with ä, ö, ü, ß written out."""
    pairs = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, F.lower(s))


def _accents() -> tuple[str, str]:
    """Small accented Latin letters with their base letters, then the combining marks, which have none."""
    letters = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower()]
    bases = {c: unicodedata.normalize("NFKD", c) for c in letters}
    based = {c: d[0] for c, d in bases.items() if len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))}
    return "".join(based) + "".join(map(chr, range(0x300, 0x370))), "".join(based.values())


def _compatible() -> tuple[str, str]:
    """Characters whose compatible form (NFKC) is one other character, up to the enclosed and full-width ones."""
    pairs = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0xA0, 0x2500), *range(0xFF00, 0xFFF0)])}
    pairs = {c: d for c, d in pairs.items() if d != c and len(d) == 1}
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()
COMPATIBLE, COMMON = _compatible()


def search_fold(s: Column) -> Column:
    """Lower case without accents, ß as ss.

    It stays in the JVM: a table of all Latin letters and combining marks instead of NFKD.  Only
    compatible forms of several letters, such as ligatures, stay as they are.  ASCII texts, told by
    their lengths, have nothing to look up.
    """
    low = F.lower(F.coalesce(s, F.lit("")))
    folded = F.replace(F.translate(low, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))
    return F.when(F.octet_length(s) == F.char_length(s), low).otherwise(folded)


def _uncommon() -> str:
    """A pattern for the characters that the JVM's tables do not fold as NFKD does."""
    table = dict(zip(ACCENTED, [*PLAIN, *[""] * (len(ACCENTED) - len(PLAIN))]))
    common = [c for c in map(chr, [*range(0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00)]) if decomposed(c) == table.get(c.lower(), c.lower()).replace("ß", "ss")]
    codes = sorted(map(ord, common))
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if after != c + 1]
    # the many ranges are tried on characters beyond ASCII alone
    return r"(?=[^\x00-\x7F])[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends)) + "]"


@cache
def _marks() -> dict[int, None]:
    return dict.fromkeys(c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M")


def decomposed(s: str) -> str:
    """Lower case, NFKD, without marks, ß as ss: what a search compares."""
    return unicodedata.normalize("NFKD", s.lower()).translate(_marks()).replace("ß", "ss")


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else decomposed(t))


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


UNCOMMON = _uncommon()


def exact_fold(s: Column) -> Column:
    """``search_fold`` with compatible forms of several letters too (ligatures, fractions, half-width kana).

    Only texts with a character that the JVM's tables do not know go to Python; others pass it as nulls,
    and what comes back as null is folded by the tables.
    """
    return F.coalesce(_decomposed(F.when(s.rlike(UNCOMMON), s)), search_fold(s))


def exact_norm_desc(s: Column) -> Column:
    """``norm_desc`` of the whole NFKC form; texts of ASCII and Latin-1 letters never leave the JVM."""
    rare = F.coalesce(s.rlike(r"[^\x00-\x7F\xC0-\xFF]"), F.lit(False))
    return norm_desc(F.when(rare, _composed(F.when(rare, s))).otherwise(s))


def german(s: Column) -> Column:
    """A text that sorts as German readers expect: umlauts beside their vowels, case and accents last."""
    return F.collate(s, "de")


def slugify(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold_umlauts(norm(s)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read but never compute again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_number(s: Column) -> Column:
    """Number with German grouping: both marks mean dot groups and comma decimals; garbage is null."""
    dot, comma, t = F.lit("."), F.lit(","), F.regexp_replace(s, r"^\s+|\s+$", "")
    plain = F.replace(F.when(t.contains(".") & t.contains(","), F.replace(t, dot, F.lit(""))).otherwise(t), comma, dot)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


#: Words of offer descriptions that carry no identity.
FILLER = ("je", "ca", "versch", "sorten")


def norm_desc(s: Column) -> Column:
    """The sorted set of a description's words, without punctuation and filler.

    Compatible forms of one character (no-break space, ², full-width letters) become common ones.
    """
    common = F.translate(F.coalesce(s, F.lit("")), COMPATIBLE, COMMON)
    words = F.split(F.regexp_replace(F.lower(common), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*FILLER))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def minted_id(*parts: Column) -> Column:
    """First 12 hex digits of the sha1 of the parts joined by '|'."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")), 1, 12)


#: Gluten-free wording, tried in this order at each place of the original text.
GLUTEN_FREE = (
    (r"\bVollkornnudeln\b", "glutenfreie Nudeln"),
    (r"\bBandnudeln\b", "glutenfreie Bandnudeln"),
    (r"\bNudeln\b", "glutenfreie Nudeln"),
    (r"\bSpaghetti\b", "glutenfreie Spaghetti"),
    (r"\bTagliatelle\b", "glutenfreie Tagliatelle"),
    (r"\bPenne\b", "glutenfreie Penne"),
    (r"\bPasta\b", "glutenfreie Pasta"),
    (r"\bWeizenmehl\b", "glutenfreies Mehl"),
    (r"\bMehl\b", "glutenfreies Mehl"),
    (r"\bCouscous\b", "Quinoa"),
    (r"\bBulgur\b", "Quinoa"),
    (r"\bSeitan\b", "Tofu"),
    (r"\bGrie(?:ss|ß)(?!\w)", "Polenta"),
    (r"\bSoja(?:so(?:ß|ss)e|sauce)\b", "Tamari (glutenfrei)"),
    (r"\bBrötchen\b", "glutenfreie Brötchen"),
    (r"\bBaguette\b", "glutenfreies Baguette"),
    (r"\bBrot\b", "glutenfreies Brot"),
    (r"\bToast\b", "glutenfreier Toast"),
    (r"\bHaferflocken\b", "glutenfreie Haferflocken"),
    (r"\bTortillas?\b", "Mais-Tortillas"),
    (r"\bWraps?\b", "Mais-Wraps"),
)


def replace_once(rules: tuple[tuple[str, str], ...]):
    """A pandas UDF that replaces matches of ordered rules in one pass, never what it has written."""

    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        pattern = re.compile("|".join(f"({rule})" for rule, _ in rules), re.IGNORECASE)
        return texts.map(lambda t: None if t is None else pattern.sub(lambda m: rules[m.lastindex - 1][1], t))

    return apply


gluten_free = replace_once(GLUTEN_FREE)
