"""Readers of the archive's files and of the star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.scalars import receipt_fingerprint
from ..functions.text import norm_title
from . import versions

OFFER = T.StructType().add("id", "string").add("title", "string").add("category", T.StructType().add("name", "string")).add("price", T.StructType().add("rawValue", "double").add("value", "string"))
OFFER = OFFER.add("basicPrice", "string").add("baseUnit", "string").add("description", "string").add("criteria", T.ArrayType(T.StructType().add("name", "string")))
OFFER = OFFER.add("pbAdditionalPoints", "double").add("pbPointsMultiplier", "double").add("images", T.StructType().add("app", "string").add("original", "string"))
SNAPSHOT = T.StructType().add("validFrom", "string").add("validTill", "string").add("totalCount", "long").add("offers", T.ArrayType(OFFER))
PREFERENCES = (
    "version int, interests map<string,int>, votes map<string,struct<v:int,t:string>>, bought map<string,struct<c:int,t:string>>, "
    "meals map<string,struct<v:int,t:string,tags:array<string>>>, glutenFree boolean, updatedAt string"
)
#: Snapshots of other sources: their own week and count, and offers with the key they are told apart by.
SIBLING = "weekStart string, totalCount long, offers array<struct<sku:string,id:string,title:string,price:double,category:string>>"
RECEIPT = "store string, date string, items array<struct<name:string,qty:double,price:double>>"
#: How snapshot paths name year, week and date.
WEEK_PATH, DATE_PATH = r"(\d{4})/(KW\d+)/", r"(\d{4}-\d{2}-\d{2})"


def located(df: DataFrame, path: str = "path") -> DataFrame:
    """Add week (YYYY-KWnn) and date from the path; both fall back to the path itself."""
    p = F.col(path)
    year, week = F.regexp_extract(p, WEEK_PATH, 1), F.regexp_extract(p, WEEK_PATH, 2)
    date = F.regexp_extract(p, DATE_PATH, 1)
    return df.withColumn("week", F.when(year != "", F.concat_ws("-", year, week)).otherwise(p)).withColumn("date", F.when(date != "", date).otherwise(p))


def snapshots(spark: SparkSession, glob: str) -> DataFrame:
    """One row a snapshot file, with its partition columns; no match is an error."""
    read = spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "PERMISSIVE").json(glob)
    return located(read.select("*", F.col("_metadata.file_path").alias("path")))


def offers(snapshot_rows: DataFrame) -> DataFrame:
    """One row an offer, in file order."""
    return snapshot_rows.select("path", "week", "date", F.posexplode("offers").alias("pos", "o")).select("path", "week", "date", "pos", "o.*")


def latest_snapshot(snapshot_rows: DataFrame) -> DataFrame:
    """The snapshot of the greatest embedded date (not of the greatest path)."""
    newest = snapshot_rows.agg(F.max("date").alias("date"))
    return snapshot_rows.join(F.broadcast(newest), "date", "left_semi")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The listed files that lie in a week folder."""
    listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("path"))
    return located(listed.where(F.col("path").rlike(WEEK_PATH)))


def optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON source that may be missing or malformed: then an empty table, never an error."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def siblings(spark: SparkSession, glob: str, source: str) -> DataFrame:
    """Snapshots of a sibling archive: a row a file, as ``audit.sibling_report`` reads them, with their offers."""
    read = located(spark.read.schema(SIBLING).option("multiLine", True).json(glob).select("*", F.col("_metadata.file_path").alias("path")))
    year, kw = F.regexp_extract("path", WEEK_PATH, 1), F.regexp_extract("path", WEEK_PATH, 2)
    return read.select(
        F.lit(source).alias("source"), year.alias("year"), kw.alias("kw"), F.to_date("date").alias("d"), F.to_date("weekStart").alias("week_start"),
        F.col("totalCount").alias("total"), F.size(F.coalesce("offers", F.array())).cast("long").alias("n"), "offers",
    )


def receipt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Receipts that were read into JSON, a row a line, with the receipt's fingerprint; none where there are none."""
    r = optional(spark, path, RECEIPT).where("items is not null")
    r = r.withColumn("fp", receipt_fingerprint(F.col("store"), F.col("date"), F.col("items")))
    line = r.select("fp", "store", F.col("date").alias("at"), F.explode("items").alias("i"))
    return line.select("fp", "store", "at", F.trim("i.name").alias("name"), norm_title(F.col("i.name")).alias("norm"), F.col("i.qty").alias("qty"), F.col("i.price").alias("spent"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """An index as ``sinks.write_index`` leaves it; what reads it several times may cache it."""
    return versions.read(spark, path)


def paged_source(name: str, schema: str, limit: int, fetch: Callable[[int, int], dict]) -> type[DataSource]:
    """A data source that reads ``fetch(offset, limit)`` page by page, a task a page.

    A page is {"data": [row, ...], "total": n}.  The first one is read to plan the others; an empty
    page gives nothing, a malformed one is an error.  schema: columns of plain types as DDL.
    """
    names = [column.split()[0] for column in schema.split(",")]

    def page(offset: int) -> dict:
        got = fetch(offset, limit)
        if not isinstance(got.get("data"), list) or not isinstance(got.get("total"), int):
            raise ValueError(f"malformed page at offset {offset}")
        return got

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(offset) for offset in range(0, max(1, page(0)["total"]), limit)]

        def read(self, partition: InputPartition):
            for row in page(partition.value)["data"]:
                yield tuple(row.get(column) for column in names)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    return Paged


def date_labels(d: Column, week: Column) -> list[Column]:
    """31.12.2024, 31.12. and KW01 from a date and a week label as text; other text stays as it is."""
    dated = d.rlike(r"^\d+-\d+-\d+$")
    part = lambda k: F.get(F.split(d, "-"), k)
    long_ = F.when(dated, F.concat_ws(".", part(2), part(1), part(0))).otherwise(d)
    short = F.when(dated, F.concat(part(2), F.lit("."), part(1), F.lit("."))).otherwise(d)
    kw = F.regexp_extract(week, r"KW\d+", 0)
    return [long_.alias("long_date"), short.alias("short_date"), F.when(kw != "", kw).otherwise(week).alias("week_label")]


def preferences(df: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Preferences from JSON text, each field repaired to its default where it is unusable, beside columns to keep."""
    p = F.from_json(column, PREFERENCES)
    level = lambda k, v: v.isin(-1, 0, 1, 2)
    empty = lambda kind: F.create_map().cast(kind)
    return df.select(
        *keep, F.coalesce(F.map_filter(p["interests"], level), empty("map<string,int>")).alias("interests"),
        F.coalesce(F.map_filter(p["votes"], lambda k, v: v["v"].isin(-1, 1)), empty("map<string,struct<v:int,t:string>>")).alias("votes"),
        F.coalesce(F.map_filter(p["bought"], lambda k, v: v["c"] > 0), empty("map<string,struct<c:int,t:string>>")).alias("bought"),
        F.coalesce(p["glutenFree"], F.lit(False)).alias("gluten_free"),
    )


def embedded_json(html: DataFrame, column: str = "html", element: str = "__NEXT_DATA__") -> DataFrame:
    """The JSON that a page carries in a script element, as VARIANT."""
    raw = F.regexp_extract(F.col(column), rf'(?s)<script[^>]*id="{element}"[^>]*>(.*?)</script>', 1)
    return html.withColumn("data", F.try_parse_json(F.nullif(raw, F.lit(""))))


@F.udtf(returnType="node_id string, publisher string, valid_from string, node string")
class Brochures:
    """Walks nested JSON for nodes with publisher, id and validFrom; a hit is not walked further."""

    def eval(self, raw: str):
        import json

        try:
            todo, found = [json.loads(raw)], {}
        except (TypeError, ValueError):
            return
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                if node.get("publisher") and node.get("id") and node.get("validFrom"):
                    found[str(node["id"])] = node
                    continue
                todo.extend(reversed(list(node.values())))
            elif isinstance(node, list):
                todo.extend(reversed(node))
        for key, node in found.items():
            publisher = node["publisher"]
            name = publisher.get("name") if isinstance(publisher, dict) else publisher
            yield key, name, str(node["validFrom"]), json.dumps(node, ensure_ascii=False, sort_keys=True)


def flattened(brochures: DataFrame) -> DataFrame:
    """brochure -> pages -> offers, with the page number."""
    pages = brochures.select("brochure_id", F.posexplode("pages").alias("page", "p"))
    return pages.select("brochure_id", "page", F.explode("p.offers").alias("offer"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as the archive's observation table (one row an offer)."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"])
    unit = F.when(F.col("p_size") % 2 == 0, "kg").otherwise("l")
    bucket = F.concat(F.lit("w"), F.floor(F.log10("l_quantity")).cast("int").cast("string"))
    return joined.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"),
        F.col("p_partkey").alias("part"), F.col("p_name").alias("title"), F.col("p_type").alias("cat"), F.col("p_brand").alias("brand"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("d"),
        F.col("l_extendedprice").alias("face"),
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity") * 100 + 0.5) / 100).alias("gp"),
        unit.alias("unit"), bucket.alias("bucket"),
        F.concat_ws("|", F.col("p_partkey").cast("string"), unit, bucket).alias("key"),
        F.when(F.col("l_returnflag") == "N", "range").alias("gpf"),
        ((F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.05)).alias("flagged"),
        (F.col("l_tax") >= 0.05).alias("bonus"),
    )


def worded_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers whose unit price stands in a text, in six forms by line number."""
    o = observations(spark, sf_dir)
    gp, q = F.col("gp").cast("decimal(12,2)").cast("string"), F.col("qty").cast("int").cast("string")
    forms = {
        0: F.concat(F.lit("je "), q, F.lit(" g Packung (1 kg = € "), gp, F.lit(")")),
        1: F.concat(F.lit("1 kg = ab € "), gp),
        2: F.concat(F.lit("1 l = € "), gp, F.lit(" / € "), (F.col("gp") + 1).cast("decimal(12,2)").cast("string")),
        3: F.concat(F.lit("je "), q, F.lit(" ml Flasche")),
        4: F.concat(F.lit("6 x "), q, F.lit(" g")),
        5: F.concat(q, F.lit(" Stück Packung")),
    }
    form = F.col("l_linenumber") % 6
    wording = F.lit(None)
    for k, text in forms.items():
        wording = F.when(form == k, text).otherwise(wording)
    return o.withColumn("wording", wording)


def paged_stream(name: str, schema: str, limit: int, fetch: Callable[[int, int], dict]) -> type[DataSource]:
    """A streaming source over ``fetch(offset, limit)``, whose offsets are places in the list.

    Pages are as for ``paged_source``.  Each batch takes what the list has grown by, a task a page;
    a stream that stops goes on where its checkpoint says, so that no row comes twice and none is
    lost.  A list that has become shorter than what was read, and a page that is empty where the
    total says it is not, are errors: rows would be missing or shifted.
    """
    names = [column.split()[0] for column in schema.split(",")]

    def page(offset: int, size: int) -> dict:
        got = fetch(offset, size)
        if not isinstance(got.get("data"), list) or not isinstance(got.get("total"), int):
            raise ValueError(f"malformed page at offset {offset}")
        return got

    class Reader(DataSourceStreamReader):
        seen = 0

        def initialOffset(self) -> dict:
            return {"offset": 0}

        def latestOffset(self) -> dict:
            total = page(self.seen, limit)["total"]
            if total < self.seen:
                raise ValueError(f"the list has shrunk from {self.seen} to {total}")
            self.seen = total
            return {"offset": total}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.seen = max(self.seen, end["offset"])
            return [InputPartition((at, min(limit, end["offset"] - at))) for at in range(start["offset"], end["offset"], limit)]

        def read(self, partition: InputPartition):
            at, size = partition.value
            got = page(at, size)
            if got["total"] < at + size:
                raise ValueError(f"the list has shrunk from {at + size} to {got['total']}")
            if not got["data"]:
                raise ValueError(f"empty page at offset {at} of {got['total']}")
            for row in got["data"][:size]:
                yield tuple(row.get(column) for column in names)

        def commit(self, end: dict) -> None:
            pass

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return Reader()

    return Paged
