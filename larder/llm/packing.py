"""Packing by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches
from .tokens import CACHED, encoder, vocabulary_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"


def binary_lengths(n: int, limit: int) -> list[int]:
    """Powers of two of at most ``limit`` that add up to ``n``, longest first.

    >>> binary_lengths(2048 * 2 + 5, 2048)
    [2048, 2048, 4, 1]
    """
    tail = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]


def pack(docs: DataFrame, path: str, limit: int = 2048, end_id: int = 1, with_ids: bool = True, cached: int = CACHED) -> DataFrame:
    """Split every document's ids into pieces of power-of-two length and bucket equal lengths.

    Each piece is a whole sequence of its bucket (``bucket`` is the exponent of its length), so no
    sequence crosses documents and none needs padding.  One pass over the input, no shuffle; a
    task's memory is that of a few thousand documents.  Sequence ids are unique and come from the
    input partition and the place in it, so a task that runs again gives the same ids.  ``cached``
    bounds the pieces whose ids a worker keeps.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed
    once each; an empty table gives an empty result; all other columns are ignored.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder("byte", path, cached), np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, 2048):
            columns: list[list] = [[] for _ in range(9)]
            for doc_id, found in zip(batch.column(0).to_pylist(), tool.encode_all(batch.column(1))):
                ids = found.tobytes() + end
                total, start = len(ids) // 4, 0
                for length in binary_lengths(total, limit):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(piece), total, sequence, 0, length.bit_length() - 1, piece if with_ids else None)
                    for column, value in zip(columns, row):
                        column.append(value)
                    start += length
                    sequence += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), with_ids=False).drop("ids")
