"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import documents, shuffle_width, stage

#: 2^8 bins by the top bits of a hash; 4 low-order bits of each bin's value are stored: 128 bytes.
BIN_BITS, STORED_BITS = 8, 4
BINS = 1 << BIN_BITS
SHINGLE = 5
_LOW = 64 - BIN_BITS
_MASK = (1 << _LOW) - 1
_BLANKS = " \t\n\x0b\f\r"
#: Tries of densification that are drawn for each bin before all bins are ranked for it.
TRIES = 8


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none in a blank text."""
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _empty(slot: Column) -> Column:
    return slot.bitwiseAND(F.lit(_MASK)) == _MASK


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the packed fingerprint of column ``text`` as a hex string; '' for texts without words.

    Each shingle (five words, or all of a shorter text) is hashed once.  The hashes are sorted
    together with the largest value of every bin, so the first value in each bin is its minimum or
    says that the bin is empty.  An empty bin takes the value of a filled one: the first filled one
    among ``TRIES`` bins drawn for it, else the filled bin of smallest rank for it.  Draws and ranks
    depend on the bin alone, so equal sets of filled bins are read alike.
    """
    draw = random.Random(5)
    drawn = [F.array(*[F.lit(draw.randrange(BINS)) for _ in range(BINS)]) for _ in range(TRIES)]
    words, hashes, slots, filled = (F.col(f"_{out}_{x}") for x in ("words", "hashes", "slots", "filled"))
    n = F.size(words)
    shingles = F.transform(F.slice(words, 1, F.greatest(n - (SHINGLE - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE)]))
    every = F.when(n >= SHINGLE, shingles).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))
    last = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), _LOW).bitwiseOR(F.lit(_MASK)))
    first = F.filter(hashes, lambda x, i: ~F.shiftright(x, _LOW).eqNullSafe(F.shiftright(F.get(hashes, i - 1), _LOW)))

    def fill(x: Column, i: Column) -> Column:
        tries = [F.get(slots, F.get(d, i)) for d in drawn]
        ranked = F.array_min(F.transform(filled, lambda y: F.struct(F.xxhash64(i, F.shiftright(y, _LOW)).alias("rank"), y.alias("y"))))["y"]
        return F.when(~_empty(x), x).otherwise(F.coalesce(*[F.when(~_empty(t), t) for t in tries], ranked))

    digits = F.transform(F.transform(slots, fill), lambda x: F.substring(F.lit("0123456789abcdef"), x.bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(1)))
    steps = df.withColumn(f"_{out}_words", words_of(F.col(text)))
    steps = steps.withColumn(f"_{out}_hashes", F.sort_array(F.concat(every, last)))
    steps = steps.withColumn(f"_{out}_slots", first)
    steps = steps.withColumn(f"_{out}_filled", F.filter(slots, lambda x: ~_empty(x)))
    steps = steps.withColumn(out, F.when(F.size(filled) == 0, "").otherwise(F.array_join(digits, "")))
    return steps.drop(*[f"_{out}_{x}" for x in ("words", "hashes", "slots", "filled")])


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of two fingerprints, 0 to 1.

    The share of equal stored values, less what chance gives 4-bit values, 1/16.  Two fingerprints
    of texts without words are alike (1); one such and any other are not (0); null with a null.
    """
    apart = F.lit(0)
    for at in range(1, BINS // 16 * 16, 16):
        x, y = (F.conv(F.substring(c, at, 16), 16, -10).cast("long") for c in (a, b))
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))
        apart = apart + F.bit_count(z)
    chance = 1 / (1 << STORED_BITS)
    share = F.greatest(F.lit(0.0), ((F.lit(BINS) - apart) / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(share)


def next_ids(docs: DataFrame) -> DataFrame:
    """For each distinct doc_id (not null) the next one in descending order, and after the last the first.

    Ids alone are dealt out by range and ordered within their range; the ranges' first ids, a row
    for each partition, close the gaps.  ``most`` is the most characters an edit takes.
    """
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 3)).alias("most"))
    dealt = ids.repartitionByRange(shuffle_width(spark), F.col("doc_id").desc()).withColumn("part", F.spark_partition_id())
    dealt = stage(spark, dealt, "fingerprint-order")
    # A row for each partition: its first id, and that of the partition after it (after the last, the first).
    one = Window.partitionBy(F.lit(0))
    firsts = dealt.groupBy("part").agg(F.max("doc_id").alias("first"))
    after = F.coalesce(F.lead("first").over(one.orderBy(F.desc("first"))), F.max("first").over(one))
    gaps = F.broadcast(firsts.select("part", after.alias("after")))
    within = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.col("doc_id").desc()))
    return dealt.withColumn("within", within).join(gaps, "part").select("doc_id", F.coalesce("within", "after").alias("next_id"), "most")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edit replaces the last third of the code points by the first as many (or all) of the next
    document by descending doc_id.  Null texts are empty.  Where a doc_id is repeated, each row has
    its result, and as a next document the row whose text has the smallest hash stands for the id.
    Rows without a doc_id have no next document: their text stays as it is and near_next is null.
    Other columns are ignored; an empty table gives an empty result.

    Texts are shuffled once by doc_id (the exchange serves both joins); only the heads that edits
    need go to the documents before them.
    """
    spark = docs.sparkSession
    # A cast that changes nothing would leave an alias in one of the two plans below, and so two exchanges.
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("long").alias("doc_id")
    base = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    known = base.where("doc_id is not null")
    ring = stage(spark, next_ids(base), "fingerprint-ring")
    asked = ring.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), F.col("most").cast("int").alias("most"), "next_id")
    heads = known.join(asked, "doc_id").select("for_id", "next_id", F.struct(F.xxhash64("text").alias("h"), F.expr("substring(text, 1, most)").alias("head")).alias("of"))
    heads = heads.groupBy("for_id").agg(F.min("of").alias("of"), F.first("next_id").alias("next_id"))
    both = known.join(heads.withColumnRenamed("for_id", "doc_id"), "doc_id", "left").select("doc_id", "text", F.col("of.head").alias("head"), "next_id")
    both = both.unionByName(base.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("string").alias("head"), F.lit(None).cast("long").alias("next_id")))
    n = F.char_length("text")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("cut", F.floor(n / 3).cast("int"))
    both = both.withColumn("edited", F.when(F.col("head").isNull(), F.col("text")).otherwise(F.concat(F.expr("substring(text, 1, n_chars - cut)"), F.expr("substring(head, 1, cut)"))))
    both = with_fingerprint(with_fingerprint(both, "text", "fingerprint"), "edited", "edited_fingerprint")
    made = both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_id", F.xxhash64("text").alias("h"))
    made = stage(spark, made, "fingerprints")
    others = made.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min(F.struct("h", "fingerprint")).alias("of"))
    paired = made.join(others.select("next_id", F.col("of.fingerprint").alias("next_fingerprint")), "next_id", "left")
    return paired.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
