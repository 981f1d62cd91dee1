"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DRAWS, documents, small_batches, stage

#: Documented bound of the training sample, for each of the two labels: rows are taken where a hash
#: of the id falls under the share that gives about this many rows of the label.
TRAIN_ROWS = 6000
#: Documented bound of the features of all these rows together (4 bytes each on the driver): a sample
#: with more, as of very long texts, is thinned evenly, again by a hash of the id.
TRAIN_FEATURES = 20_000_000
#: Parts in which the sample comes to the driver, one after another.
SAMPLE_PARTS = 16
#: Size of the hashed feature space, so that the weights never exceed 4 MB, and passes over the sample.
BITS, EPOCHS = 20, 5
#: Per-coordinate rates and L1/L2 strengths of the learner.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.03
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class Words(dict):
    """From a word as it stands in a text to the hash of its lower-case form without edge marks."""

    LIMIT = 250_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        key = _EDGES.sub("", word.lower()) or word
        value = self[word] = zlib.crc32(key.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF
        return value


_words = Words()


def features(text: str) -> np.ndarray:
    """Hashed unigrams, bigrams and skip-grams (one word left out) of a whole text, repeats and all."""
    words = text.split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint32, len(words))
    pair = h[:-1] * np.uint32(0x85EBCA6B) + (h[1:] ^ np.uint32(0xB5297A4D))
    skip = h[:-2] * np.uint32(0xC2B2AE35) + (h[2:] ^ np.uint32(0x68E31DA4))
    return np.concatenate((h, pair * np.uint32(0x27D4EB2F), skip * np.uint32(0x165667B1))) >> np.uint32(32 - BITS)


class Ftrl:
    """FTRL-proximal: z and n per coordinate; a weight is zero until its z exceeds L1."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((2, (1 << BITS) + 1), np.float64)  # the last coordinate is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)  # the bias is not thinned out
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


class Model:
    """Sparse weights: only the coordinates that are not zero travel to the executors."""

    def __init__(self, at: np.ndarray, values: np.ndarray, bias: float):
        self.at, self.values, self.bias = at.astype(np.int32), values.astype(np.float32), bias
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def score(self, text: str) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.at] = self.values
        f = features(text)
        f = np.unique(f[self._dense[f] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self._dense[f].astype(np.float64).sum(), -35, 35))))


def learn(labels: list[int], flat: np.ndarray, sizes: list[int]) -> Model:
    """Fit on rows of distinct features, one after another in ``flat``; a fixed seed mixes their order anew at each pass."""
    model, order = Ftrl(), np.random.default_rng(7)
    seen = np.zeros(1 << BITS, np.int32)
    for at in range(0, len(flat), 1 << 20):
        seen += np.bincount(flat[at : at + (1 << 20)], minlength=1 << BITS).astype(np.int32)
    several = seen > 1  # what one row has alone moves z by less than L1 in all passes together
    ends = np.cumsum([0, *sizes]).tolist()
    for _ in range(EPOCHS):
        for i in order.permutation(len(labels)).tolist():
            f = flat[ends[i] : ends[i + 1]]
            model.learn(np.append(f[several[f]], 1 << BITS).astype(np.int64), labels[i])
    w = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(w[:-1])
    return Model(at, w[at], float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``rows`` documents of either label whose crc32(doc_id) mod 5 is not 0, as features."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0)
    for label in (0, 1):
        share = F.when(F.col("label") == label, F.lit(int(min(1.0, rows / max(1, counts.get(label, 0))) * DRAWS))).otherwise(share)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(DRAWS)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = [np.unique(features(t or "")).astype(np.uint32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["doc_id", "label", "raw"])

    few = F.broadcast(known)  # about 2 * rows ids at most, by the shares above
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(few, "doc_id")
    return texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, raw binary")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_FEATURES) -> Model:
    """Learn from a sample bounded in rows and in features; its hashed features, not its texts, come
    to the driver, a part at a time and into one buffer."""
    sample = stage(docs.sparkSession, training_rows(docs, labels, rows), "toxicity-sample")
    total = sample.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    if total > 4 * most:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit("thinned")), F.lit(DRAWS)) < F.lit(int(4 * most / total * DRAWS)))
    known, sizes, flat = [], [], bytearray()
    for row in sample.repartition(SAMPLE_PARTS, "doc_id").sortWithinPartitions("doc_id", "raw").toLocalIterator():
        known.append(row.label)
        sizes.append(len(row.raw) // 4)
        flat += row.raw
    return learn(known, np.frombuffer(flat, np.uint32), sizes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.  One pass, no shuffle.

    A null text is empty and gets the bias alone; null and repeated doc_ids pass through (a null id
    counts as held out, as no label can be learnt for it); without labels every score is 0.5 and
    nothing is called toxic by the pipeline; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = [model.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not model.values.size or model.score(t or "") < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
