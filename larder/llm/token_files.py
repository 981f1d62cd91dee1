"""Token-id shards: raw id payloads with a minimal perfect hash index for keyed access."""

from __future__ import annotations

import bisect
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_path, shuffle_width, small_batches, stage, text_bytes
from .inverted import null_safe
from .tokens import encoder, vocabulary_path

_U = np.uint64
#: Bytes of text of a shard, about, and of ids that one read of a file takes.
SHARD_BYTES, READ_BYTES = 256 << 20, 8 << 20
MANIFEST = "shard long, file string, n_docs long, n_ids long, first long, last long, nulls boolean"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mixer, another one for each seed."""
    with np.errstate(over="ignore"):
        x = x + _U(seed) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def keys_of(doc_ids: pa.Array, ordinals: np.ndarray) -> np.ndarray:
    """64-bit keys of (doc_id, how many equal ids came before)."""
    ids, gone = null_safe(doc_ids)
    ids, salt = ids.view(_U), (2 * ordinals + gone).astype(_U)
    return np.where(salt == 0, _mix(ids, 1), _mix(_mix(ids, 1) ^ _mix(salt, 2), 3))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit arrays by level, ranked by running popcounts.

    At each level the keys that fall on a bit alone keep it; the others go on to the next level.  A
    key's number is the count of bits set before its own, so n keys get 0 to n-1.
    """

    LEVELS = 48

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys) and len(sizes) < cls.LEVELS:
            size = max(64, -(-2 * len(keys) // 64) * 64)
            at = (_mix(keys, 11 + len(sizes)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            keys = keys[~alone[at]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flat, bitorder="little").view(np.uint64), np.sort(keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 where no level has a bit for the key."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes.tolist(), self.starts.tolist())):
            at = start + (_mix(keys[open_], 11 + level) % _U(size)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(_U)
            hit = (self.bits[word] >> bit) & _U(1) == 1
            low = self.bits[word] & ((_U(1) << bit) - _U(1))
            out[open_[hit]] = (self.rank[word] + np.bitwise_count(low))[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.rank[-1] + at[hit]
        return out


class Shard:
    """A shard opened for keyed access: a key's number gives its offset, length and fingerprint."""

    def __init__(self, files: fs.FileSystem, path: str):
        with files.open_input_file(path + ".index") as f, np.load(io.BytesIO(f.read())) as z:
            self.hash = PerfectHash(z["sizes"], z["bits"], z["rest"])
            self.offsets, self.lengths, self.prints = z["offsets"], z["lengths"], z["prints"]
            self.width = np.dtype(str(z["width"]))
        self.payload = files.open_input_file(path + ".ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether its fingerprint is there, the offset in ids, the count of ids."""
        at = self.hash(keys)
        there = at >= 0
        there[there] = self.prints[at[there]] == (_mix(keys[there], 7) >> _U(32)).astype(np.uint32)
        return there, np.where(there, self.offsets[at], -1), np.where(there, self.lengths[at], -1)

    def read(self, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of documents in ascending order of their offsets; neighbours come by one read."""
        size = self.width.itemsize
        ends = offsets + lengths
        new = np.concatenate(([True], offsets[1:] != ends[:-1])) if len(offsets) else np.zeros(0, bool)
        k = 0
        while k < len(offsets):
            last = k + 1
            while last < len(offsets) and not new[last] and (ends[last] - offsets[k]) * size <= READ_BYTES:
                last += 1
            raw = np.frombuffer(self.payload.read_at(int(ends[last - 1] - offsets[k]) * size, int(offsets[k]) * size), self.width)
            for a, b in zip((offsets[k:last] - offsets[k]).tolist(), (ends[k:last] - offsets[k]).tolist()):
                yield raw[a:b]
            k = last


def _write(files: fs.FileSystem, path: str, keys: np.ndarray, lengths: np.ndarray, width: str) -> None:
    perfect = PerfectHash.build(keys)
    slot = perfect(keys)
    offsets = np.cumsum(lengths) - lengths
    table = {"offsets": offsets, "lengths": lengths, "prints": (_mix(keys, 7) >> _U(32)).astype(np.uint32)}
    by_slot = {k: np.empty_like(v) for k, v in table.items()}
    for k, v in table.items():
        by_slot[k][slot] = v
    raw = io.BytesIO()
    np.savez(raw, sizes=perfect.sizes, bits=perfect.bits, rest=perfect.rest, width=width, **by_slot)
    with files.open_output_stream(path + ".index") as f:
        f.write(raw.getvalue())


def write_shards(docs: DataFrame, root: str, path: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encode documents and write their ids in ascending doc_id order; the shards' manifest comes back.

    Documents are range-partitioned by doc_id into shards of about ``SHARD_BYTES`` of text (as many as
    the shuffle's width at least); each task sorts its range, streams the ids to
    ``<file>.ids`` (unsigned 16-bit where the vocabulary allows it, else 32-bit) and the index to
    ``<file>.index``.  File names are unique to the attempt, and only those in the manifest count,
    so tasks that run twice or fail half-way leave no trace in the result.

    Null texts are empty; null ids come first; equal ids are told apart by their order of text.
    """
    spark = docs.sparkSession
    n = shards or max(shuffle_width(spark), -(-text_bytes(docs) // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder("word", path)
        files, base = fs.FileSystem.from_uri(root)
        files.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        width = "<u2" if max(len(tool.ends_word), end_id + 1) <= 1 << 16 else "<u4"
        name, out = f"{base}/shard-{part:05d}-{uuid.uuid4().hex}", None
        ids, lengths = [], []
        for batch in small_batches(batches, 2048):
            out = out or files.open_output_stream(name + ".ids")
            encoded = tool.encode_all(batch.column(1))
            out.write(np.concatenate([part for got in encoded for part in (got, [end_id])]).astype(width).tobytes())
            ids.append(batch.column(0))
            lengths.append(np.array([len(got) + 1 for got in encoded], np.int64))
        if out:
            out.close()
            all_ids, all_lengths = pa.concat_arrays(ids), np.concatenate(lengths)
            known = all_ids.drop_null()
            _write(files, name, keys_of(all_ids, ordinals(all_ids)), all_lengths, width)
            ends = [known[0].as_py(), known[-1].as_py()] if len(known) else [None, None]
            row = {"shard": [part], "file": [name], "n_docs": [len(all_ids)], "n_ids": [int(all_lengths.sum())], "first": ends[:1], "last": ends[1:], "nulls": [all_ids.null_count > 0]}
            kinds = {"shard": pa.int64(), "file": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64(), "first": pa.int64(), "last": pa.int64(), "nulls": pa.bool_()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in row.items()})

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stage(spark, ordered.mapInArrow(run, MANIFEST), "token-manifest")


def ordinals(sorted_ids: pa.Array) -> np.ndarray:
    """How many equal ids stand before each id of a sorted array."""
    ids, gone = null_safe(sorted_ids)
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (gone[1:] != gone[:-1]))) if len(ids) else np.zeros(0, bool)
    at = np.arange(len(ids))
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(ids) else at


def read_documents(keys: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """Look up every row of ``keys`` (doc_id, how_many) by its key; one row per document found.

    The manifest (a row per shard, so its size is the number of files) goes to the driver, which
    turns id counts into the shards' starts.
    """
    shards = sorted(manifest.collect(), key=lambda r: r.shard)
    starts = np.cumsum([0] + [s.n_ids for s in shards]).tolist()
    firsts = [s.first for s in shards if s.first is not None]
    numbers = [k for k, s in enumerate(shards) if s.first is not None]
    names = [s.file for s in shards]
    with_nulls = next((k for k, s in enumerate(shards) if s.nulls), 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = [with_nulls if d is None or not firsts else numbers[max(0, bisect.bisect_right(firsts, d) - 1)] for d in ids]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column(0), batch.column(1)], ["shard", "doc_id", "how_many"])

    def read(key: tuple, table: pa.Table) -> pa.Table:
        files, _ = fs.FileSystem.from_uri(root)
        number = key[0].as_py()
        shard = Shard(files, names[number])
        many = table["how_many"].to_numpy()
        ids = table["doc_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(many)), many)))
        before = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        there, offsets, lengths = shard.find(keys_of(ids, before))
        order = np.flatnonzero(there)
        order = order[np.argsort(offsets[order])]
        offsets, lengths = offsets[order], lengths[order]
        crcs = [zlib.crc32(got.astype("<u4").tobytes()) for got in shard.read(offsets, lengths)]
        columns = {"doc_id": ids.take(pa.array(order)), "start": pa.array(starts[number] + offsets), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64()), "shard": pa.array(np.full(len(order), number))}
        return pa.table(columns)

    placed = keys.select(F.col("doc_id").cast("long"), F.col("how_many").cast("long")).mapInArrow(place, "shard long, doc_id long, how_many long")
    return placed.repartition(max(1, len(shards)), "shard").groupBy("shard").applyInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = documents(spark, sf_dir), shared_path(spark, "token-shards")
    manifest = write_shards(docs, root, vocabulary_path("word_bpe_49k.json"))
    keys = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("how_many"))
    return read_documents(keys, manifest, root)
