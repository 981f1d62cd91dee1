"""One sorted sweep over each product's weeks: earlier low, run of dearer weeks, rank among earlier weeks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import EPS

SCHEMA = "key string, d date, gp double, n long, prior_low double, run long, cheaper long"


def cheaper_before(prices: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each price the number of smaller ones before it in its own series; series begin at ``starts``.

    Counted by merging: at each level blocks of twice the length are put in order of price, and a
    price of a right half finds how many of its left half stand before it.
    """
    n = len(prices)
    series = np.repeat(np.arange(len(starts)), np.diff(starts, append=n))
    place = np.arange(n) - starts[series]
    longest = int(place.max(initial=-1)) + 1
    found = np.zeros(n, np.int64)
    # Equal prices: right halves first, so that they do not count; both sorts below are stable.
    order = np.lexsort((-place, prices))
    half = 1
    while half < longest:
        block = series * (longest // (2 * half) + 1) + place // (2 * half)
        ranked = order[np.argsort(block[order], kind="stable")]
        left = place[ranked] // half % 2 == 0
        before = np.cumsum(left) - left
        first = np.flatnonzero(np.diff(block[ranked], prepend=-1))
        base = np.repeat(before[first], np.diff(first, append=n))
        right = ~left
        found[ranked[right]] += before[right] - base[right]
        half *= 2
    return found


class Carried:
    """What the weeks of a product so far mean for the next ones: their number, low, stack and ordered prices.

    The prices are kept as sorted runs of falling length, merged as they grow alike, so that a rank
    costs a search in each of a logarithmic number of runs.
    """

    def __init__(self) -> None:
        self.n, self.low = 0, np.inf
        self.stack: list[tuple[float, int]] = []
        self.runs: list[np.ndarray] = []

    def smaller(self, prices: np.ndarray) -> np.ndarray:
        return sum((np.searchsorted(run, prices) for run in self.runs), np.zeros(len(prices), np.int64))

    def add(self, prices: np.ndarray) -> None:
        new = np.sort(prices)
        while self.runs and len(self.runs[-1]) <= 2 * len(new):
            new = np.sort(np.concatenate((self.runs.pop(), new)), kind="stable")
        self.runs.append(new)

    def runs_of(self, prices: list[float]) -> list[int]:
        """For each next week the weeks since the last one that was not dearer, by a stack of rising prices."""
        out, stack = [], self.stack
        for price in prices:
            while stack and stack[-1][0] > price + EPS:
                stack.pop()
            out.append(self.n - (stack[-1][1] if stack else 0))
            while stack and stack[-1][0] >= price:
                stack.pop()
            self.n += 1
            stack.append((price, self.n))
        return out


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, carried = None, Carried()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, prices = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
        cheaper = cheaper_before(prices, starts)
        n, low, run = np.empty(len(keys), np.int64), np.empty(len(keys)), np.empty(len(keys), np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            own = prices[a:b]
            if keys[a] != key:
                key, carried = keys[a], Carried()
            cheaper[a:b] += carried.smaller(own)
            n[a:b] = np.arange(carried.n + 1, carried.n + 1 + b - a)
            low[a:b] = np.minimum.accumulate(np.concatenate(([carried.low], own[:-1])))
            run[a:b] = carried.runs_of(own.tolist())
            carried.low = min(carried.low, own.min())
            if b == len(keys):  # only a series that may go on in the next batch is carried
                carried.add(own)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(low, mask=np.isinf(low)), pa.array(run), pa.array(cheaper)], ["key", "d", "gp", "n", "prior_low", "run", "cheaper"])


def swept(weekly: DataFrame) -> DataFrame:
    """Each week (key, d, gp) with its number n in its product, the least earlier price, the run of dearer
    weeks just before it and the number of cheaper earlier weeks.

    One exchange by product and one sort; a product's weeks stream through in Arrow batches, and a
    series longer than a batch is carried over, so that w weeks cost O(w log w) steps and a task holds
    the prices of one product.  Prices are finite; weeks are distinct within a product.
    """
    rows = weekly.select("key", "d", F.col("gp").cast("double").alias("gp"))
    return rows.repartition("key").sortWithinPartitions("key", "d").mapInArrow(_swept, SCHEMA)
