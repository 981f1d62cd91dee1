"""Quality: a generalised additive model with pairwise interactions, as lookup tables over binned text statistics."""

from __future__ import annotations

import itertools
import operator
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DRAWS, documents, small_batches

#: Documented bound of the training sample, for each of the two labels: rows are taken where a hash of
#: the id falls under the share that gives about this many rows of the label.
TRAIN_ROWS = 6000
#: Bins of a feature, of either side of a pair; pairs that are kept; rounds over all features, over all pairs.
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS = 64, 12, 6, 120, 60
#: Step of a tree, ridge of a leaf, least weight (in rows) of a leaf.
RATE, RIDGE, LEAF = 0.1, 1.0, 5.0
#: A text is called good from this score on.
LEAST_SCORE = 0.3

FEATURES = (
    "log_words", "word_length", "distinct_words", "commonest_word", "word_again", "distinct_pairs", "upper_letters", "upper_words",
    "exclamations", "digits", "marks", "symbols", "blanks", "other_letters", "log_lines", "words_a_line", "repeated_lines", "ended_lines",
    "longest_word", "character_entropy",
)
_UPPER, _LOWER, _DIGIT, _MARK, _CALL, _SYMBOL, _BLANK, _OTHER = range(8)


def _kind(code: int) -> int:
    c = chr(code)
    if c in "!?":
        return _CALL
    if c in ".,;:'\"-()":
        return _MARK
    if c.isspace():
        return _BLANK
    if c.isdigit():
        return _DIGIT
    if c.isalpha():
        return _UPPER if c.isupper() else _LOWER
    return _SYMBOL if c in string.punctuation or unicodedata.category(c)[0] in "SPC" else _OTHER


#: Kinds of the characters of Latin script; all later ones are other letters.
_LATIN = 0x250
_KINDS = np.array([_kind(c) for c in range(_LATIN)] + [_OTHER], np.uint8)


def features(text: str) -> np.ndarray:
    """The statistics of a whole text, in the order of ``FEATURES``; all zero for a text without words."""
    words = text.split()
    if not words:
        return np.zeros(len(FEATURES), np.float32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(codes, _LATIN)
    kinds = np.bincount(_KINDS[low], minlength=8)
    chars, n = len(codes), len(words)
    letters = max(1, kinds[_UPPER] + kinds[_LOWER] + kinds[_OTHER])
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    share = np.bincount(low)
    share = share[share > 0] / chars
    return np.array(
        (
            np.log1p(n), (chars - kinds[_BLANK]) / n, len(counts) / n**0.75, max(counts.values()) / n, sum(map(operator.eq, words, words[1:])) / n,
            pairs / max(1, n - 1), kinds[_UPPER] / letters, sum(map(str.isupper, words)) / n, kinds[_CALL] / n, kinds[_DIGIT] / chars,
            kinds[_MARK] / n, kinds[_SYMBOL] / chars, kinds[_BLANK] / chars, kinds[_OTHER] / letters, np.log1p(len(lines)), n / max(1, len(lines)),
            1 - len(set(lines)) / max(1, len(lines)), sum(line.rstrip().endswith((".", "!", "?", ":", '"')) for line in lines) / max(1, len(lines)),
            np.log1p(max(map(len, counts))), -(share * np.log2(share)).sum(),
        ),
        np.float32,
    )


class Model:
    """Bin edges and one table a feature, and coarser edges and one table a pair; scores are sums of looked-up values."""

    def __init__(self, bias: float, edges: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int]], pair_tables: list[np.ndarray]):
        self.bias, self.edges, self.tables, self.coarse, self.pairs, self.pair_tables = bias, edges, tables, coarse, pairs, pair_tables

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, of rows of features."""
        total = np.full(len(rows), self.bias)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, rows[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], rows[:, i], "right"), np.searchsorted(self.coarse[j], rows[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.scores(np.stack([features(t or "") for t in texts])) if texts else np.zeros(0)


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of bins of about equal numbers of rows, between distinct values."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))
        return values
    return ((values[1:].astype(np.float64) + values[:-1]) / 2).astype(np.float32)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(h >= LEAF / 4, g * g / (h + RIDGE), -np.inf)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two; gain 0 where no cut helps."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gains.argmax())
    return (float(gains[at]), at + 1) if gains[at] > 0 else (0.0, 0)


def _step(g: np.ndarray, h: np.ndarray) -> float:
    return RATE * float(g.sum() / (h.sum() + RIDGE))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over the bins of one feature, as a value a bin."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), _step(g, h))
    return np.concatenate((_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)))


def _pair_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over the cells of a pair, each node cut along the better side."""
    rows, columns = (_best_cut(g.sum(axis=1), h.sum(axis=1)), _best_cut(g.sum(axis=0), h.sum(axis=0))) if depth else ((0.0, 0), (0.0, 0))
    if not max(rows[0], columns[0]):
        # a first cut may help only together with the second, as in a checkerboard
        if depth == 2 and min(g.shape) > 1:
            at = g.shape[0] // 2
            return np.vstack((_pair_tree(g[:at], h[:at], 1), _pair_tree(g[at:], h[at:], 1)))
        return np.full(g.shape, _step(g, h))
    if rows[0] >= columns[0]:
        return np.vstack((_pair_tree(g[: rows[1]], h[: rows[1]], depth - 1), _pair_tree(g[rows[1] :], h[rows[1] :], depth - 1)))
    return np.hstack((_pair_tree(g[:, : columns[1]], h[:, : columns[1]], depth - 1), _pair_tree(g[:, columns[1] :], h[:, columns[1] :], depth - 1)))


def learn(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
    """Boost one shallow tree a feature in turn, round after round, then the pairs that gain most, in the same way."""
    n, width = rows.shape
    edges = [_edges(rows[:, j], BINS) for j in range(width)] if n else [np.zeros(0, np.float32)] * len(FEATURES)
    coarse = [_edges(rows[:, j], PAIR_BINS) for j in range(width)] if n else edges
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not n:
        return Model(0.0, edges, tables, coarse, [], [])
    weights = weights / weights.mean()
    good = float(np.clip((weights * labels).sum() / weights.sum(), 1e-4, 1 - 1e-4))
    bias = float(np.log(good / (1 - good)))
    binned = [np.searchsorted(e, rows[:, j], "right") for j, e in enumerate(edges)]
    total = np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return weights * (labels - p), weights * p * (1 - p)

    for _ in range(ROUNDS):
        for j, at in enumerate(binned):
            g, h = slopes()
            step = _tree(np.bincount(at, g, len(tables[j])), np.bincount(at, h, len(tables[j])))
            tables[j] += step
            total += step[at]
    cells = [np.searchsorted(e, rows[:, j], "right") for j, e in enumerate(coarse)]
    sizes = [len(e) + 1 for e in coarse]
    g, h = slopes()

    def of(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(cells[i] * sizes[j] + cells[j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    def gained(i: int, j: int) -> float:
        tree = _pair_tree(of(i, j, g), of(i, j, h)) / RATE
        return float((of(i, j, g) * tree - of(i, j, h) * tree**2 / 2).sum())

    pairs = sorted(itertools.combinations([j for j in range(width) if sizes[j] > 1], 2), key=lambda p: -gained(*p))[:PAIRS]
    pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(pairs, pair_tables):
            g, h = slopes()
            step = _pair_tree(of(i, j, g), of(i, j, h))
            table += step
            total += step[cells[i], cells[j]]
    return Model(bias, edges, tables, coarse, pairs, pair_tables)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``rows`` documents of either label whose crc32(doc_id) mod 5 is not 0, as features, with the
    number of labelled rows that each stands for."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    known = known.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("label").isin(0, 1))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {label: min(1.0, rows / n) for label, n in counts.items()}
    of = lambda values: F.when(F.col("label") == 1, F.lit(values.get(1, 0))).otherwise(F.lit(values.get(0, 0)))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(DRAWS)) < of({k: int(s * DRAWS) for k, s in share.items()}))
    known = known.withColumn("weight", of({k: 1 / s for k, s in share.items()}).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = [features(t or "").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], ["doc_id", "label", "weight", "raw"])

    few = F.broadcast(known)  # about 2 * rows ids at most, by the shares above
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id")
    return texts.select("doc_id", "label", "weight", "text").mapInArrow(run, "doc_id long, label int, weight double, raw binary")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from a bounded sample; 80 bytes of features a row come to the driver, no texts."""
    found = sorted(training_rows(docs, labels, rows).collect(), key=lambda r: (r.doc_id, r.raw))
    table = np.frombuffer(b"".join(r.raw for r in found), np.float32).reshape(-1, len(FEATURES))
    return learn(table, np.array([r.label for r in found], np.float64), np.array([r.weight for r in found]))


def score(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.  One pass, no shuffle.

    A null text is empty; a text without words has all features 0 and is looked up like any other;
    null and repeated doc_ids pass through (a null id counts as held out, as no label can be learnt
    for it); without labels every score is 0.5; with labels of one kind all scores are near it; an
    empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
