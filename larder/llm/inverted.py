"""A distributed inverted index over hashed word windows, in compact sorted blocks.

Tasks cut their documents into chunks.  A chunk gives its distinct window hashes, sorted, to ranges
of the hash space as one block a range, with the document that has each, or how many have it: which
ones these are stays in the chunk's own row.  A range merges its blocks and tells each chunk which
of its windows also occur elsewhere.  Rows are blocks, not windows, so the shuffle holds about 9
bytes a window, and a window that a third of all documents have is one entry a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches, text_bytes
from .tokens import words_of

#: Windows and documents of a chunk at most (but a chunk holds one document at least).
CHUNK_WINDOWS, CHUNK_DOCS = 1_500_000, 60_000
#: Bytes of text whose windows one range of the hash space gets, about, whatever the shuffle's width.
RANGE_BYTES = 4 << 20
#: Bytes of a hash that a block stores besides its range, where windows are to be told apart (from
#: 256 ranges on, all 64 bits); fewer serve where a chance match does no harm.
EXACT_BYTES = 7
BLOCKS = "range long, chunk long, n int, docs binary, tokens binary, counts binary, owners binary"
#: Owner of a window that several documents of a chunk have.
SEVERAL = 0xFFFF
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(29))) * _U(0x9FB21C651E98DF25)
        return x ^ (x >> _U(32))


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the texts' bounds in them."""
    texts = pc.fill_null(texts, "")
    codes, bounds, words = words_of(pc.ascii_lower(texts) if lower else texts)
    by_code = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    return by_code[codes] if len(words) else np.zeros(0, _U), bounds


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the window of ``width`` words that starts at each word (its own end excepted)."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _U(0x9E3779B97F4A7C15) + words[k : k + n]
    return mixed(out)


def _packed(tokens: np.ndarray, low: int) -> bytes:
    """The low bytes of ascending tokens, one plane a byte, highest first: high planes compress."""
    planes = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, low - 1 :: -1]
    return np.ascontiguousarray(planes.T).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    out, low = np.zeros((n, 8), np.uint8), len(raw) // max(1, n)
    out[:, low - 1 :: -1] = np.frombuffer(raw, np.uint8).reshape(low, n).T
    return out.reshape(-1).view("<u8")


def range_bits(df: DataFrame) -> int:
    """Bits of a hash that name its range: by the bytes of all texts, and as many as the shuffle's width at least."""
    ranges = max(shuffle_width(df.sparkSession), -(-text_bytes(df) // RANGE_BYTES))
    return min(40, max(0, (ranges - 1).bit_length()))


def rest_bits(bits: int, low: int) -> int:
    """Bits of a hash that blocks store besides the range's."""
    return min(8 * low, 64 - bits)


def short(hashes: np.ndarray, bits: int, low: int = EXACT_BYTES) -> np.ndarray:
    """What is left of hashes in blocks: the bits of the range and those stored."""
    return hashes >> _U(64 - bits - rest_bits(bits, low))


def firsts_of(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in an ordered array."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


class _Chunk:
    """Windows of one chunk until it is full."""

    def __init__(self, number: int):
        self.number, self.rows, self.tokens, self.owners, self.windows = number, [], [], [], 0

    def add(self, row: tuple, tokens: np.ndarray) -> None:
        self.tokens.append(tokens)
        self.owners.append(np.full(len(tokens), len(self.rows), np.uint16))
        self.rows.append(row)
        self.windows += len(tokens)

    def full(self) -> bool:
        return self.windows >= CHUNK_WINDOWS or len(self.rows) >= CHUNK_DOCS

    def blocks(self, bits: int, low: int) -> pa.RecordBatch:
        tokens = short(np.concatenate(self.tokens) if self.tokens else np.zeros(0, _U), bits, low)
        owners = np.concatenate(self.owners) if self.owners else np.zeros(0, np.uint16)
        order = np.argsort(tokens)
        tokens, owners = tokens[order], owners[order]
        first = firsts_of(tokens)
        counts = np.diff(np.append(first, len(tokens)))
        several = counts > 1
        mine = np.repeat(several, counts)
        # The chunk's own row has a group of its own, below 0, and goes through it back to the chunk.
        docs = np.array(self.rows, dtype="<i8").tobytes()
        rows = [(-1 - self.number, self.number, len(self.rows), docs, tokens[first][several].astype("<u8").tobytes(), counts[several].astype("<u2").tobytes(), owners[mine].astype("<u2").tobytes())]
        own = np.where(several, SEVERAL, owners[first]).astype("<u2")
        tokens, counts = tokens[first], counts.astype("<u2")
        ranges = (tokens >> _U(rest_bits(bits, low))).astype(np.int64)
        starts = firsts_of(ranges)
        for r, a, b in zip(ranges[starts].tolist(), starts.tolist(), np.append(starts[1:], len(tokens)).tolist()):
            rows.append((r, self.number, b - a, None, _packed(tokens[a:b], low), counts[a:b].tobytes(), own[a:b].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["range", "chunk", "n", "docs", "tokens", "counts", "owners"])


def blocks_of(docs: DataFrame, fill: Callable[[pa.RecordBatch, _Chunk], None], bits: int, low: int = EXACT_BYTES) -> DataFrame:
    """Blocks by range of the windows that ``fill`` adds to chunks for each batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        chunk = _Chunk(part << 24)
        for batch in small_batches(batches, 2048):
            fill(batch, chunk)
            if chunk.full():
                yield chunk.blocks(bits, low)
                count += 1
                chunk = _Chunk(part << 24 | count)
        if chunk.rows:
            yield chunk.blocks(bits, low)

    return docs.mapInArrow(run, BLOCKS)


ANSWERS = "chunk long, range long, n int, docs binary, tokens binary, counts binary, owners binary"


def answers(blocks: DataFrame, least: int = 2, low: int = EXACT_BYTES) -> DataFrame:
    """For each chunk, its windows that at least ``least`` documents of all chunks together have.

    Rows as in ``blocks_of``, but the counts are those of all chunks (up to 65535).
    """
    names = ["chunk", "range", "n", "docs", "tokens", "counts", "owners"]
    kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * 4

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        if r < 0:
            return table.select(names)
        sizes = table["n"].to_numpy()
        tokens = np.concatenate([_unpacked(raw, n) for raw, n in zip(table["tokens"].to_pylist(), sizes.tolist())])
        each, owners = (np.concatenate([np.frombuffer(raw, "<u2") for raw in table[c].to_pylist()]) for c in ("counts", "owners"))
        order = np.argsort(tokens, kind="stable")
        first = firsts_of(tokens[order])
        sums = np.add.reduceat(each[order].astype(np.int64), first)
        total = np.empty(len(order), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(order))))
        rows = []
        for chunk, n, end in zip(table["chunk"].to_pylist(), sizes.tolist(), np.cumsum(sizes).tolist()):
            at = end - n + np.flatnonzero(total[end - n : end] >= least)
            if len(at):
                rows.append((chunk, r, len(at), None, _packed(tokens[at], low), np.minimum(total[at], 0xFFFF).astype("<u2").tobytes(), owners[at].tobytes()))
        columns = list(zip(*rows)) or [()] * 7
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return blocks.groupBy("range").applyInArrow(merge, ANSWERS)


def chunk_answer(table: pa.Table, columns: int, bits: int, low: int = EXACT_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk: its documents' rows, and tokens, owners and counts of its answered windows."""
    found = table.select(["range", "n", "docs", "tokens", "counts", "owners"]).to_pylist()
    own = next(row for row in found if row["range"] < 0)
    rest = rest_bits(bits, low)
    tokens, counts, owners = [np.zeros(0, _U)], [np.zeros(0, "<u2")], [np.zeros(0, "<u2")]
    for row in found:
        if row["range"] >= 0:
            tokens.append(_unpacked(row["tokens"], row["n"]) & _U((1 << rest) - 1) | _U(row["range"] << rest))
            counts.append(np.frombuffer(row["counts"], "<u2"))
            owners.append(np.frombuffer(row["owners"], "<u2"))
    tokens, counts, owners = map(np.concatenate, (tokens, counts, owners))
    several = np.flatnonzero(owners == SEVERAL)  # which documents these are, the chunk's own row says
    held = np.frombuffer(own["counts"], "<u2").astype(np.int64)
    at = np.searchsorted(np.frombuffer(own["tokens"], "<u8"), tokens[several])
    many = held[at]
    entries = np.repeat((np.cumsum(held) - held)[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    again = np.repeat(several, many)
    one = owners != SEVERAL
    all_owners = np.concatenate((owners[one], np.frombuffer(own["owners"], "<u2")[entries]))
    docs = np.frombuffer(own["docs"], "<i8").reshape(-1, columns)
    return docs, np.concatenate((tokens[one], tokens[again])), all_owners, np.concatenate((counts[one], counts[again]))


def null_safe(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids with 0 for null, and where they are null."""
    gone = pc.is_null(ids).to_numpy(zero_copy_only=False)
    return pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), gone


def long_id(column: str = "doc_id"):
    return F.col(column).cast("long").alias(column)
