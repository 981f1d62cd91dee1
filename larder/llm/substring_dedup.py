"""Substring dedup: matching statistics of word windows against FM-index shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches
from .fm_index import FmIndex
from .inverted import answers, blocks_of, chunk_answer, firsts_of, mixed, range_bits, short, window_hashes, word_hashes

WINDOW = 13
#: Words of the grams whose smallest hash gives a window its key.
GRAM = 5
#: Windows of a segment at most, and windows of a chunk of segments about.
SEGMENT, CHUNK_WINDOWS = 48, 400_000
#: Keys that occur more often than this give each window a segment and a shard of its own.
HOT_KEY = 1000
#: Hash bytes of the keys' inverted index: a chance match only sends a window to the index in vain.
KEY_BYTES = 4
#: Bytes of a word's hash by which shards tell words apart.
WORD_BYTES = 6
_U = np.uint64
_NO_ID = np.iinfo(np.int64).max


def window_keys(words: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each whole window and the word at which it starts; a window's key depends on it alone.

    The key is the smallest hash of the window's five-word grams.  Neighbouring windows often share
    it, so a text has about a key every five words; equal windows have equal keys.
    """
    grams = window_hashes(words, GRAM)
    n = max(0, len(words) - window + 1)
    least = np.full(n, np.iinfo(_U).max, _U)
    for k in range(window - GRAM + 1):
        np.minimum(least, grams[k : k + n], out=least)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(of[:n] == of[window - 1 :]) if n else np.zeros(0, np.int64)
    return mixed(least[inside]), inside


def _shared_keys(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """For each document with any: its keys (short form, ascending) that others have too, and how many do."""

    def fill(batch: pa.RecordBatch, chunk) -> None:
        words, bounds = word_hashes(batch.column(2), lower=False)
        keys, at = window_keys(words, bounds, window)
        cuts = np.searchsorted(at, bounds).tolist()
        for doc_id, h, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cuts, cuts[1:]):
            chunk.add((doc_id, h), np.unique(keys[a:b]))

    def by_document(key: tuple, table: pa.Table) -> pa.Table:
        rows, tokens, owners, counts = chunk_answer(table, 2, bits, KEY_BYTES)
        order = np.lexsort((tokens, owners))
        tokens, counts, owners = tokens[order], counts[order], owners[order]
        cuts = np.searchsorted(owners, np.arange(len(rows) + 1)).tolist()
        out = [(doc_id, h, tokens[a:b].tobytes(), counts[a:b].tobytes()) for (doc_id, h), a, b in zip(rows.tolist(), cuts, cuts[1:]) if b > a]
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "h", "keys", "counts"])

    found = answers(blocks_of(docs, fill, bits, KEY_BYTES), low=KEY_BYTES).groupBy("chunk").applyInArrow(by_document, "doc_id long, h long, keys binary, counts binary")
    return found.groupBy("doc_id", "h").agg(F.first(F.struct("keys", "counts")).alias("shared"))


def _coded(words: np.ndarray) -> bytes:
    """The low bytes of word hashes that shards compare."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()


def _decoded(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, WORD_BYTES)
    return out.reshape(-1).view("<u8")


def _keyed(docs: DataFrame) -> dict[str, Column]:
    """What texts are told apart by: doc_id (the largest long for null), and h, a hash of the text
    whose last bit says that doc_id is null."""
    h = F.shiftleft(F.xxhash64("text"), 1).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    return {"doc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "h": h}


class _Segments:
    """Segments of one chunk of documents: distinct contents for the shards, places to keep."""

    def __init__(self, number: int):
        self.number, self.windows = number, 0
        self.docs: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []  # segment, key, document, start, windows, words

    def rows(self, bits: int, window: int) -> pa.RecordBatch:
        segment, key, doc, start, windows, words = (np.concatenate(x) for x in zip(*self.parts))
        sizes = windows + window - 1
        offsets = np.cumsum(sizes) - sizes
        ids = np.array([d for d, _ in self.docs], np.int64)[doc]
        shard = (key >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        order = np.lexsort((ids, segment, shard))  # a shard's segments together, the smallest id first
        new = np.concatenate(([True], segment[order][1:] != segment[order][:-1]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        one = order[new]
        own = shard[one]
        taken = sizes[one]
        flat = words[np.repeat(offsets[one], taken) + np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)]
        ends = np.concatenate(([0], np.cumsum(taken)))
        kept = (np.array(self.docs, "<i8").tobytes(), place.astype("<u4").tobytes(), doc.astype("<u2").tobytes(), start.astype("<u4").tobytes(), windows.astype("u1").tobytes())
        # The chunk's own row has a group of its own, below 0, and goes through it back to the chunk.
        out = [(-1 - self.number, self.number, *kept)]
        starts = firsts_of(own)
        for r, a, b in zip(own[starts].tolist(), starts.tolist(), np.append(starts[1:], len(own)).tolist()):
            out.append((r, self.number, segment[one[a:b]].tobytes(), ids[one[a:b]].tobytes(), windows[one[a:b]].astype("u1").tobytes(), _coded(flat[ends[a] : ends[b]]), None))
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["range", "chunk", "a", "b", "c", "d", "e"])


def _segments(texts: DataFrame, bits: int, window: int, hot_key: int) -> DataFrame:
    """Runs of windows with one shared key, chunk by chunk: contents by shard, places for the chunk."""

    def find(batch: pa.RecordBatch, chunk: _Segments) -> None:
        words, bounds = word_hashes(batch.column(2), lower=False)
        keys, at = window_keys(words, bounds, window)
        cuts = np.searchsorted(at, bounds).tolist()
        often = np.zeros(len(keys), np.int64)
        for shared, a, b in zip(batch.column(3).to_pylist(), cuts, cuts[1:]):
            known, counts = np.frombuffer(shared["keys"], "<u8"), np.frombuffer(shared["counts"], "<u2")
            own = short(keys[a:b], bits, KEY_BYTES)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            often[a:b] = np.where(known[place] == own, counts[place], 0)
        some = often > 0
        keys, at, hot = keys[some], at[some], often[some] > hot_key
        first_doc = len(chunk.docs)
        chunk.docs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if not len(at):
            return
        if hot.any():
            keys = np.where(hot, window_hashes(words, window)[at], keys)
        doc = np.searchsorted(bounds, at, side="right") - 1
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])))
        first = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        first = np.flatnonzero(within % SEGMENT == 0)
        windows = np.diff(np.append(first, len(at)))
        start, sizes = at[first], windows + window - 1
        offsets = np.cumsum(sizes) - sizes
        inner = np.arange(sizes.sum()) - np.repeat(offsets, sizes)
        taken = words[np.repeat(start, sizes) + inner]
        with np.errstate(over="ignore"):
            hashes = mixed(np.add.reduceat(mixed(taken + inner.astype(_U) * _U(0xA0761D6478BD642F)), offsets) + sizes.astype(_U))
        chunk.parts.append((hashes, keys[first], first_doc + doc[first], start - bounds[doc[first]], windows, taken))
        chunk.windows += len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        chunk = _Segments(part << 24)
        for batch in small_batches(batches, 1024):
            find(batch, chunk)
            if chunk.windows >= CHUNK_WINDOWS or len(chunk.docs) > 60_000:
                if chunk.parts:
                    yield chunk.rows(bits, window)
                count += 1
                chunk = _Segments(part << 24 | count)
        if chunk.parts:
            yield chunk.rows(bits, window)

    return texts.mapInArrow(run, "range long, chunk long, a binary, b binary, c binary, d binary, e binary")


def _search(window: int):
    names = ["chunk", "range", "a", "b", "c", "d", "e"]

    def search(key: tuple, table: pa.Table) -> pa.Table:
        """Index a shard's distinct segments and stream them against it.

        For each chunk, in its order of segments: the smallest doc_id of each segment's windows if
        one holds for all, else each window's.
        """
        if key[0].as_py() < 0:
            return table.select(names)
        rows = table.to_pylist()
        counts = [len(r["a"]) // 8 for r in rows]
        segments = np.concatenate([np.frombuffer(r["a"], "<u8") for r in rows])
        owners = np.concatenate([np.frombuffer(r["b"], "<i8") for r in rows])
        windows = np.concatenate([np.frombuffer(r["c"], "u1") for r in rows]).astype(np.int64)
        words = np.concatenate([_decoded(r["d"]) for r in rows])
        sizes = windows + window - 1
        offsets = np.cumsum(sizes) - sizes
        order = np.lexsort((owners, segments))
        new = np.concatenate(([True], segments[order][1:] != segments[order][:-1]))
        one = order[new]
        alike = np.empty(len(order), np.int64)
        alike[order] = np.cumsum(new) - 1
        low = window_owners(words, offsets[one], sizes[one], owners[one], window)
        n = windows[one]
        firsts = np.cumsum(n) - n
        least, most = np.minimum.reduceat(low, firsts), np.maximum.reduceat(low, firsts)
        out, at = [], 0
        for r, count in zip(rows, counts):
            own = alike[at : at + count]
            at += count
            varied = (least[own] != most[own]).astype("u1")
            v = own[varied == 1]
            each = low[np.repeat(firsts[v], n[v]) + np.arange(n[v].sum()) - np.repeat(np.cumsum(n[v]) - n[v], n[v])]
            out.append((r["chunk"], r["range"], least[own].tobytes(), varied.tobytes(), each.tobytes(), None, None))
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return search


def window_owners(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """For each window of each segment the smallest owner of a segment that holds it.

    The segments are indexed, and all are streamed against the index: where the matching statistic
    reaches a whole window, the interval of its places has the smallest owner.
    """
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    _, codes = np.unique(words[np.repeat(starts, sizes) + within], return_inverse=True)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    text[np.repeat(begins, sizes) + within] = codes + 1
    index = FmIndex(text, window, np.repeat(owners, sizes + 1))
    n = sizes - window + 1
    firsts = np.cumsum(n) - n
    out = np.full(int(n.sum()), _NO_ID)
    for stretch, at, matched, lo in index.stream(text, begins + sizes, sizes):
        full = matched == window
        some = stretch[full]
        out[firsts[some] + at[full] - begins[some]] = index.least_of(lo[full])
    return out


def _runs(window: int):
    def runs(key: tuple, table: pa.Table) -> pa.Table:
        """For each document of a chunk the stretches of words (start, end) that repeated windows cover."""
        kept, found = None, []
        for row in table.to_pylist():
            if row["range"] < 0:
                kept = row
            else:
                found.append((row["range"], row))
        docs = np.frombuffer(kept["a"], "<i8").reshape(-1, 2)
        place, doc, start, windows = (np.frombuffer(kept[c], k).astype(np.int64) for c, k in (("b", "<u4"), ("c", "<u2"), ("d", "<u4"), ("e", "u1")))
        found = [r for _, r in sorted(found, key=lambda x: x[0])]
        least = np.concatenate([np.frombuffer(r["a"], "<i8") for r in found])
        varied = np.concatenate([np.frombuffer(r["b"], "u1") for r in found]).astype(bool)
        each = np.concatenate([np.frombuffer(r["c"], "<i8") for r in found])
        n = np.zeros(len(least), np.int64)
        n[place] = windows
        width = np.where(varied, n, 0)
        begin = np.cumsum(width) - width
        mine = docs[doc, 0]
        whole = np.flatnonzero(~varied[place] & (least[place] < mine))
        part = np.flatnonzero(varied[place])
        many = windows[part]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        hit = each[np.repeat(begin[place[part]], many) + inner] < np.repeat(mine[part], many)
        lines = np.concatenate((doc[whole], np.repeat(doc[part], many)[hit]))
        a = np.concatenate((start[whole], (np.repeat(start[part], many) + inner)[hit]))
        b = np.concatenate((start[whole] + windows[whole] + window - 1, (np.repeat(start[part], many) + inner)[hit] + window))
        order = np.lexsort((a, lines))
        lines, pairs = lines[order], np.column_stack((a, b))[order].astype("<i4")
        cuts = np.searchsorted(lines, np.arange(len(docs) + 1)).tolist()
        out = [(d, h, pairs[x:y].tobytes()) for (d, h), x, y in zip(docs.tolist(), cuts, cuts[1:]) if y > x]
        columns = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "h", "found"])

    return runs


def repeated_windows(docs: DataFrame, window: int = WINDOW, hot_key: int = HOT_KEY) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, h, text) and, by document, the stretches of words that repeated windows cover."""
    texts = docs.select(*[c.alias(n) for n, c in _keyed(docs).items()], F.coalesce("text", F.lit("")).alias("text"))
    bits = range_bits(docs)
    with_keys = texts.join(_shared_keys(texts, window, bits), ["doc_id", "h"]).select("doc_id", "h", "text", "shared")
    answered = _segments(with_keys, bits, window, hot_key).groupBy("range").applyInArrow(_search(window), "chunk long, range long, a binary, b binary, c binary, d binary, e binary")
    hits = answered.groupBy("chunk").applyInArrow(_runs(window), "doc_id long, h long, found binary")
    return texts, hits.groupBy("doc_id", "h").agg(F.first("found").alias("found"))


def _kept(text: str, found: bytes | None) -> tuple[list[bytes], list[bytes]]:
    words = text.encode().split()  # bytes are split at ASCII white space only
    if not found:
        return words, words
    pairs = np.frombuffer(found, "<i4").reshape(-1, 2)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, pairs[:, 0], 1)
    np.add.at(edges, pairs[:, 1], -1)
    return words, list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True, hot_key: int = HOT_KEY) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a smaller doc_id.

    Gives doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by
    one space).  Over all documents and whole texts; words are compared by 48 bits of their hash:

    1. each window has a key made from its own words; an inverted index over keys leaves the windows
       whose key other documents have;
    2. runs of such windows with one key are segments; equal segments of a chunk of documents become
       one with its smallest doc_id before anything moves, so that copies never meet in one task;
    3. the key's hash sends a segment to an index shard, where equal windows meet (windows with a
       very frequent key go by their own hash); the shard builds an FM-index (wavelet tree over the
       suffix-ordered words) and streams its distinct segments against it: matching statistics, an
       interval that each word before a match extends and shrinks, report the windows that occur
       whole, and their interval has the smallest doc_id;
    4. the shards' answers return to the chunks, whose documents lose the windows with a smallest
       doc_id below their own.

    Null texts have no words.  Rows of one doc_id take nothing from each other.  A null doc_id
    counts as the largest long: its repeated words go, it takes none from smaller ids.  Empty tables
    give empty results; other columns are ignored.
    """
    texts, found = repeated_windows(docs, window, hot_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for doc_id, h, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                words, kept = _kept(text, runs)
                joined = b" ".join(kept)
                rows.append((None if h & 1 else doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = texts.join(found, ["doc_id", "h"], "left").select("doc_id", "h", "text", "found")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their columns, where repeated words are gone from ``text``.

    A text that loses words becomes its kept words joined by one space, and ``n_chars``, if there is
    such a column, its length; other texts stay as they are, null ones too.  Nulls and repeated rows
    as in ``dedup``; columns may have any names.
    """
    _, found = repeated_windows(docs, window)
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in _keyed(docs).items()])
    joined = rows.join(found, ["doc_id", "h"], "left").select("row", "found")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns = dict(zip(names, batch.column(0).flatten()))
            runs, new = batch.column(1).to_pylist(), []
            for text, found_ in zip(columns["text"].to_pylist(), runs):
                new.append(b" ".join(_kept(text, found_)[1]).decode() if found_ and text else text)
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                sizes = [len(t or "") if f else n for t, f, n in zip(new, runs, columns["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return joined.mapInArrow(run, docs.schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), with_text=False).drop("kept_text")
