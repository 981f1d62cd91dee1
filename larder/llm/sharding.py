"""Sharding by extendible hashing: only oversized buckets split on another bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, stage

#: Byte limit of a shard, and the bits of the hash that a bucket can split on.
LIMIT, BITS = 1 << 20, 60
#: Bits by which the table of byte counts is finer than an even split needs.
FINER = 6


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, its bytes of UTF-8 and 60 bits of the md5 of its decimal form (of '' for a null id)."""
    digest = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, BITS // 4)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.conv(digest, 16, 10).cast("long").alias("hash"))


def _leaves(spark: SparkSession, cells: DataFrame, depths: range, limit: int) -> DataFrame:
    """For each cell (a prefix of ``depths[-1]`` bits) the shallowest bucket above it that fits.

    A bucket fits if its bytes are within the limit or it holds one hash value only.  ``depth`` is
    null where no bucket of these depths fits.  Sums by bucket combine before they move; the cells
    look up only the depths that some fitting bucket has, so that no bucket near the root gathers
    them all.
    """
    top = depths[-1]

    def above(found: DataFrame, least: int) -> DataFrame:
        return found.select("*", F.explode(F.array(*[F.lit(d) for d in depths if d >= least])).alias("d")).withColumn("at", F.expr(f"shiftright(cell, {top} - d)"))

    sums = above(cells, depths[0]).groupBy("d", "at").agg(F.sum("bytes").alias("b"), F.min("low").alias("l"), F.max("high").alias("h"))
    fits = stage(spark, sums.where((F.col("b") <= limit) | (F.col("l") == F.col("h"))).select("d", "at"), "shard-fits")
    least = fits.agg(F.min("d")).first()[0]
    if least is None:
        return cells.withColumn("depth", F.lit(None).cast("int"))
    return cells.join(above(cells.select("cell"), least).join(fits, ["d", "at"]).groupBy("cell").agg(F.min("d").alias("depth")), "cell", "left")


def _directory(docs: DataFrame, limit: int) -> DataFrame:
    """A row per document: doc_id, n_bytes, part (of the input), bucket, depth, and large: whether the
    bucket, which then has a single hash value, holds several rows and more than the limit."""
    spark = docs.sparkSession
    rows = stage(spark, _hashed(docs).withColumn("part", F.spark_partition_id()), "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    even = max(0, (max(1, total) // max(1, limit)).bit_length())
    done, open_, start = None, rows, 0
    while True:
        top = min(BITS, (even if not start else start) + FINER)
        named = open_.withColumn("cell", F.shiftright("hash", BITS - top))
        cells = named.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        cells = stage(spark, cells, "shard-cells")
        directory = stage(spark, _leaves(spark, cells, range(start, top + 1), limit).select("cell", "depth"), "shard-directory")
        placed = named.join(directory, "cell").drop("cell")
        fitting = placed.where("depth is not null")
        done = fitting if done is None else done.unionByName(fitting)
        if top == BITS or directory.where("depth is null").isEmpty():
            break
        open_, start = placed.where("depth is null").drop("depth"), top + 1
    bucket = F.lpad(F.bin(F.expr(f"shiftright(hash, {BITS} - depth)")), F.col("depth"), "0")
    done = stage(spark, done.withColumn("bucket", F.when(F.col("depth") == 0, "").otherwise(bucket)), "shard-buckets")
    held = done.groupBy("bucket").agg(F.sum("n_bytes").alias("held"), F.count(F.lit(1)).alias("rows"))
    large = stage(spark, held.where((F.col("held") > limit) & (F.col("rows") > 1)).select("bucket", "held"), "shard-large")
    return done.join(large, "bucket", "left")


def _pages(rows: DataFrame, limit: int, *by: str, order_by: tuple[str, ...] = ()) -> DataFrame:
    """Overflow pages of rows (bucket, n_bytes), counted by ``by`` apart: half a limit a page, larger rows one each."""
    half = F.col("n_bytes") > limit // 2
    order = Window.partitionBy("bucket", *by, half).orderBy("n_bytes", *order_by)
    running = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    small = F.floor(F.greatest(running - 1, F.lit(0)) / F.lit(max(1, limit // 2)))
    page = F.when(half, F.concat(F.lit("r"), F.row_number().over(order).cast("string"))).otherwise(small.cast("string"))
    return rows.withColumn("page", F.concat_ws(".", F.lit("+"), *[F.col(c).cast("string") for c in by], page))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Give every document a shard by extendible hashing of its doc_id.

    The directory is indexed by the leading bits of the hash; a bucket splits on its next bit while
    its texts exceed ``limit`` bytes, so the shard of a document is the shallowest bucket above it
    that fits.  Byte counts are first summed by prefix in the map tasks (at most about 2^6 prefixes
    a shard), the buckets' depths follow from those sums alone, and the documents look up their
    shard in the directory; a round of six more bits follows only for buckets that are still too
    large.  Rows move no texts.  A bucket that holds a single hash value (copies of one id) cannot
    split by bits; its rows go to overflow pages, counted for each part of the input on its own, so
    that no task gathers them: rows of over half the limit to one page each, the others by running
    bytes, half a limit a page.  Only a shard of one row can exceed the limit.

    shard: the bucket's bits, then, if it has several, '+.' and the part and number of the page;
    local_depth: number of bits.  Null texts have 0 bytes; null ids share the hash of the empty
    string; an empty table has no shards; other columns are ignored.
    """
    rows = _directory(docs, limit)
    paged = _pages(rows.where("held is not null"), limit, "part")
    out = rows.where("held is null").withColumn("page", F.lit("")).unionByName(paged)
    return out.select("doc_id", F.concat("bucket", "page").alias("shard"), F.col("depth").cast("int").alias("local_depth"), "n_bytes")


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Write the documents, with all their columns, as one folder a shard, and read them back.

    The folders are ``shard=b<bits>`` (with ``+.`` and the page where a bucket has several), and
    keep the limit as in ``assign``: the copies of an id are dealt by their places in the staged
    input over as many groups as their bytes need, and paged in each; a task that runs again sees
    the same places.  Nulls and repeated rows as in ``assign``; columns may have any names but
    ``shard``, which is an error; an empty table gives no folder and an empty result.
    """
    if "shard" in [c.lower() for c in docs.columns]:
        raise ValueError("the documents have a column named shard, which would be that of the folders")
    spark = docs.sparkSession
    found = _directory(docs, limit).groupBy(F.col("doc_id").alias("id")).agg(F.min("bucket").alias("bucket"), F.min("held").alias("held"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    rows = stage(spark, rows.withColumn("place", F.monotonically_increasing_id()), "shard-documents")
    placed = rows.join(found, F.col("key").eqNullSafe(F.col("id")))
    groups = F.greatest(F.lit(1), F.ceil(F.col("held") / F.lit(max(1, limit))))
    paged = _pages(placed.where("held is not null").withColumn("share", F.pmod(F.xxhash64("place"), groups)), limit, "share", order_by=("place",)).drop("share")
    out = placed.where("held is null").withColumn("page", F.lit("")).unionByName(paged)
    out.select("row.*", F.concat(F.lit("b"), "bucket", "page").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)
    return spark.read.schema(T.StructType([*docs.schema.fields, T.StructField("shard", T.StringType())])).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))


#: Ids are unique in the documents, so that no bucket has overflow pages.
ORACLE = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS hash
  FROM documents),
every AS (SELECT *, hash >> ({BITS} - d) AS prefix FROM hashed, (SELECT unnest(generate_series(0, {BITS}))::INT AS d)),
buckets AS (SELECT d, prefix, sum(n_bytes) AS held, min(hash) = max(hash) AS single FROM every GROUP BY d, prefix),
leaf AS (
  SELECT doc_id, n_bytes, hash, min(d) AS depth
  FROM every JOIN buckets USING (d, prefix) WHERE held <= {LIMIT} OR single GROUP BY ALL)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(hash >> ({BITS} - depth)), depth, '0') END AS shard,
       depth AS local_depth, n_bytes FROM leaf
"""
