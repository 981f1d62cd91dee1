"""Language ID: blended-spectrum string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DRAWS, documents, small_batches, stage

#: Documented bounds of the training sample and of the landmarks taken from it.
TRAIN_ROWS, LANDMARKS = 1500, 192
#: Documented bound of the sample's n-grams on the driver, 4 bytes each: a sample with more, as of very
#: long texts, is thinned evenly, again by a hash of the id.
TRAIN_GRAMS = 40_000_000
#: Documented bound of the languages: those with the most documents are learnt, ties by name.  The
#: model has 1 MB a language, so that it never exceeds 64 MB.
LANGUAGES = 64
#: Parts in which the sample comes to the driver, one after another.
SAMPLE_PARTS = 16
#: Hashed n-gram space, longest n-gram, ridge.
BITS, LONGEST, RIDGE = 18, 3, 1e-3
#: Landmarks whose presence rows stand in memory at once (1 MB each).
BLOCK = 32
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Hashed character n-grams of a whole text, n from 1 to 3; everything but letters is one blank."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not low.isalpha():
        ascii_other = (codes < 97) | ((codes > 122) & (codes < 128))
        high = codes > 127
        if high.any():
            kinds = {c: not chr(c).isalpha() for c in np.unique(codes[high]).tolist()}
            for c, other in kinds.items():
                if other:
                    ascii_other |= codes == c
        codes = np.where(ascii_other, np.uint32(32), codes)
        blank = codes == 32
        codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]
    out, rolling = [], np.zeros(len(codes), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        rolling = rolling[: len(codes) - n + 1] * np.uint32(0x01000193) + (codes[n - 1 :] + np.uint32(n * 0x3779))
        out.append(rolling * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


_seen = np.zeros(1 << BITS, bool)


def present(text: str) -> np.ndarray:
    """The distinct n-grams of a text, ascending: its presence vector."""
    found = grams(text)
    if len(found) < 2000:
        return np.unique(found)
    _seen[found] = True
    out = np.flatnonzero(_seen).astype(np.uint32)
    _seen[out] = False
    return out


class Model:
    """Landmark kernel and ridge weights, multiplied out to one column a language over the n-grams.

    With presence vectors x and landmarks L, k(x, l) = |x & l| / sqrt(|x| |l|).  The scores
    k(x, L) @ W are x @ (L' D W) / sqrt(|x|), so the product L' D W is taken once and a batch of
    texts is scored by one product of their presence rows with it.  2^18 rows of float32 a language.
    """

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def scores(self, texts: list[str]) -> np.ndarray:
        sets = [present(t) for t in texts]
        sizes = np.array([len(s) for s in sets])
        sums = np.zeros((len(texts), len(self.languages)), np.float64)
        if sizes.sum():
            rows, full = self.table[np.concatenate(sets)], np.flatnonzero(sizes)
            starts = np.cumsum(sizes)[full] - sizes[full]
            sums[full] = np.add.reduceat(rows, starts, axis=0, dtype=np.float64) / np.sqrt(sizes[full])[:, None]
        return sums

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        margins = self.scores([t or "" for t in texts])
        best = margins.argmax(axis=1)
        said = [self.languages[b] if t and has_letter(t) else UNKNOWN for b, t in zip(best.tolist(), texts)]
        sure = np.clip((margins.max(axis=1) + 1) / 2, 0, 1).tolist()
        return said, [0.0 if s == UNKNOWN else p for s, p in zip(said, sure)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def learn(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS) -> Model:
    """Kernel ridge regression, one language against the rest, in the landmarks' Nyström space."""
    languages = sorted({lang for lang, _ in rows})
    data = [(lang, np.frombuffer(raw, np.uint32)) for lang, raw in rows]
    data = [(lang, s) for lang, s in data if len(s)]
    if not data:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    turns = {lang: 0 for lang in languages}
    place = []
    for lang, _ in data:  # landmarks take turns between the languages
        place.append((turns[lang], lang))
        turns[lang] += 1
    chosen = sorted(range(len(data)), key=place.__getitem__)[:landmarks]
    blocks = [chosen[at : at + BLOCK] for at in range(0, len(chosen), BLOCK)]

    def rows_of(block: list[int]) -> np.ndarray:
        """The presence rows of some landmarks, a column each."""
        table = np.zeros((1 << BITS, len(block)), np.float32)
        for column, i in enumerate(block):
            table[data[i][1], column] = 1 / np.sqrt(len(data[i][1]))
        return table

    kernel = np.hstack([np.stack([table[s].sum(axis=0, dtype=np.float64) / np.sqrt(len(s)) for _, s in data]) for table in map(rows_of, blocks)])
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ root
    signs = np.array([[1.0 if lang == one else -1.0 for one in languages] for lang, _ in data])
    beta = np.linalg.solve(phi.T @ phi + RIDGE * len(data) * np.eye(phi.shape[1]), phi.T @ signs)
    weights, out = (root @ beta).astype(np.float32), np.zeros((1 << BITS, len(languages)), np.float32)
    for k, block in enumerate(blocks):
        out += rows_of(block) @ weights[k * BLOCK : k * BLOCK + len(block)]
    return Model(languages, out)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_GRAMS, languages: int = LANGUAGES) -> Model:
    """Learn from about ``rows`` documents with a lang whose crc32(doc_id) mod 5 is not 0.

    Languages have their shares of that number, but each a quarter of an equal one at least (all its
    documents, if it has fewer), so that a rare one is learnt at any size of the table.  Of more than
    ``languages`` values those with the most documents are learnt.  The sample is taken by a hash of
    the id; presence vectors (1 MB a document at most, ``most`` n-grams in all), not texts, come to
    the driver, a part at a time.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null and doc_id is not null and text is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return learn([])
    share = rows / sum(counts.values())
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, max(share, max(1.0, rows / len(counts) / 4) / n)) * DRAWS))])
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(DRAWS)) < F.try_element_at(shares, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = [present(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary())], ["doc_id", "lang", "raw"])

    sample = stage(docs.sparkSession, known.mapInArrow(run, "doc_id long, lang string, raw binary"), "language-sample")
    total = sample.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    if total > 4 * most:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit("thinned")), F.lit(DRAWS)) < F.lit(int(4 * most / total * DRAWS)))
    found = [(r.doc_id, r.lang, r.raw) for r in sample.repartition(SAMPLE_PARTS, "doc_id").toLocalIterator()]
    return learn([(lang, raw) for _, lang, raw in sorted(found)])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The language of every whole text: doc_id, held_out, lang_pred, score.  One pass, no shuffle.

    ``und`` with score 0 for null texts, texts without a letter, and where nothing could be learnt.
    Null and repeated doc_ids pass through (a null id counts as held out); other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            said, sure = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def reject(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The documents with a known language and a score of at least ``least``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            said, sure = model.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([s != UNKNOWN and p >= least for s, p in zip(said, sure)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))
