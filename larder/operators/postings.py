"""A persisted table of grams for substring searches: intersect the rarest postings, then verify."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

#: Longest gram; shorter ones are kept for tokens that are shorter themselves.
GRAM = 3
#: Grams of a token whose postings are read: the rarest, as hits are verified anyway.
RAREST = 3
#: Partitions of the table, by a hash of the gram.
BUCKETS = 64
#: Characters of a block of rows, within which a gram's ids are one list.
BLOCK_CHARS = 1 << 22
_TOPIC = "topic:"


def grams_of(text: str) -> set[str]:
    """All distinct grams of one, two and three characters."""
    return {text[i : i + n] for n in range(1, GRAM + 1) for i in range(len(text) - n + 1)}


def inverted(hays: list[str], first: int = 0) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """The grams of a block of texts, each once, with the places of the texts that have it: grams, offsets, places.

    Letters are numbered from 1 within the block, so that three of them and a place are one integer; a
    block for which it has too few bits is halved.  Grams at the end of a text are filled up with 0, by
    which shorter grams are what longer ones begin with.
    """
    codes = np.frombuffer("".join(hays).encode("utf-32-le"), np.uint32)
    letters = np.unique(codes)
    letter_bits, place_bits = len(letters).bit_length(), (len(hays) - 1).bit_length()
    if GRAM * letter_bits + place_bits > 63 and len(hays) > 1:
        half = len(hays) // 2
        yield from inverted(hays[:half], first)
        yield from inverted(hays[half:], first + half)
        return
    if not len(codes):
        return
    number = np.zeros(int(letters[-1]) + 1, np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    lengths = np.fromiter(map(len, hays), np.int64, len(hays))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # letters from here to the text's end
    own = number[codes]
    held = own.copy()
    for n in range(1, GRAM):
        held <<= letter_bits
        held[:-n] += np.where(left[:-n] > n, own[n:], 0)
    held = _distinct(held << place_bits | np.repeat(np.arange(len(hays)), lengths))
    for n in range(GRAM, 0, -1):
        gram, place = held >> place_bits, held & ((1 << place_bits) - 1)
        whole = gram & ((1 << letter_bits) - 1) != 0
        keys, places = gram[whole], place[whole]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        parts = [keys[starts] >> letter_bits * k & ((1 << letter_bits) - 1) for k in range(n - 1, -1, -1)]
        spelt = np.stack([letters[part - 1] for part in parts], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
        yield [spelt[i : i + n] for i in range(0, len(spelt), n)], np.append(starts, len(keys)), first + places
        if n > 1:
            held = _distinct((gram >> letter_bits) << place_bits | place)


def _distinct(held: np.ndarray) -> np.ndarray:
    held.sort()
    return held[np.concatenate(([True], held[1:] != held[:-1]))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows with a text, as ids and texts of about ``BLOCK_CHARS`` characters."""
    ids, hays, size = [], [], 0
    for batch in batches:
        lengths = np.cumsum(pc.utf8_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(lengths[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(lengths, before + BLOCK_CHARS - size, side="right")))
            part = batch.slice(at, end - at)
            part = part.filter(pc.fill_null(pc.not_equal(part.column(1), ""), False))
            ids.append(part.column(0))
            hays += part.column(1).to_pylist()
            size, at = size + int(lengths[end - 1]) - before, end
            if size >= BLOCK_CHARS or at < batch.num_rows:
                if hays:
                    yield pa.concat_arrays(ids), hays
                ids, hays, size = [], [], 0
    if hays:
        yield pa.concat_arrays(ids), hays


def _exploded(rows: DataFrame, kind: str) -> DataFrame:
    """Grams with lists of ids, a row a gram and block of rows, so that few rows are moved and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hays in _blocks(batches):
            for grams, offsets, places in inverted(hays):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.take(pa.array(places)))
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.diff(offsets)), lists], ["gram", "n", "ids"])

    return rows.select(F.col("id").cast(kind).alias("id"), "hay").mapInArrow(run, f"gram string, n long, ids array<{kind}>")


def _listed(members: DataFrame, kind: str) -> DataFrame:
    """Grams (gram, id) that rows have by other means, as lists of ids, a row a gram and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by("gram").aggregate([("id", "list"), ("id", "count")])
            yield from pa.table({"gram": found["gram"], "n": found["id_count"], "ids": found["id_list"]}).to_batches()

    return members.where("gram is not null and id is not null").mapInArrow(run, f"gram string, n long, ids array<{kind}>")


class Postings:
    """The postings of rows (id, hay) and of the topics they belong to, under ``path``, as versions.

    ``postings`` (gram, n, ids: lists of n ids, one a block of rows) and ``counts`` (gram, n) lie in
    folders by a hash of the gram and are sorted by it, so that a search opens only the folders, and
    reads only the row groups, of its own grams.  A folder that is large, as one with a gram that all
    rows have, fills several files.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, kind: str = "long"):
        self.spark, self.path, self.buckets, self.kind = spark, path, buckets, kind
        self.schemas = {"postings": f"gram string, n long, ids array<{kind}>, bucket int", "counts": "gram string, n long, bucket int"}

    def write(self, rows: DataFrame, topics: DataFrame | None = None) -> None:
        """Index rows (id, hay; folded as searches will be; null: none) and topics (label, id; labels folded alike)."""
        postings = _exploded(rows, self.kind)
        if topics is not None:
            postings = postings.unionByName(_listed(topics.select(F.concat(F.lit(_TOPIC), "label").alias("gram"), F.col("id").cast(self.kind).alias("id")), self.kind))
        postings = postings.withColumn("bucket", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(self.buckets)).cast("int"))

        def write(folder: str) -> None:
            # dealt by bucket and cut by size, without the sample that ranges would draw by making all grams twice
            dealt = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram")
            dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
            counts = self._at(folder, "postings").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
            counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/counts")

        versions.publish(self.spark, self.path, write)

    def read(self, part: str, grams: list[str]) -> DataFrame:
        """The rows of some grams, from their own partitions alone."""
        buckets = sorted({zlib.crc32(g.encode()) % self.buckets for g in grams})
        return self._at(versions.current(self.spark, self.path), part).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def _at(self, folder: str, part: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[part]).parquet(f"{folder}/{part}")

    def candidates(self, tokens: list[str], labels: list[str] = (), topic_token: int = GRAM) -> DataFrame:
        """Ids of rows that may hold every token, or belong to a topic whose label holds it.

        A superset of the hits, as a row may have a token's grams in different places; no row that is
        a hit is missing.  tokens are not empty, and folded as the rows were.
        """
        wanted = {t: sorted({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}) if len(t) >= GRAM else [t] for t in tokens}
        # a row a gram of the query: as many as the query has letters
        counted = {r.gram: r.n for r in self.read("counts", sorted({g for grams in wanted.values() for g in grams})).collect()}
        keys = []
        for number, (token, grams) in enumerate(wanted.items()):
            if all(g in counted for g in grams):
                rarest = sorted(grams, key=lambda g: (counted[g], g))[:RAREST]
                keys += [(g, number, "", len(rarest)) for g in rarest]
            keys += [(_TOPIC + label, number, label, 1) for label in labels if len(token) >= topic_token and token in label]
        lists = self.read("postings", sorted({k[0] for k in keys}))
        if not keys:
            return lists.select(F.explode("ids").alias("id")).where("false")
        query = F.broadcast(self.spark.createDataFrame(keys, "gram string, token int, way string, need int"))
        ids = lists.join(query, "gram").select("token", "way", "need", F.explode("ids").alias("id"))
        held = ids.groupBy("id", "token", "way", "need").agg(F.count(F.lit(1)).alias("has")).where("has = need")
        return held.groupBy("id").agg(F.count_distinct("token").alias("tokens")).where(F.col("tokens") == len(wanted)).select("id")


def any_of(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found).distinct()
