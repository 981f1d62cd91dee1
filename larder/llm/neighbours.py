"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stage

#: Trees, bits of a hash string after its first symbol, and entries of a sorted array that one partition holds.
TREES, BITS, PART_ROWS = 96, 24, 60_000
#: Levels of a string: the root, its first symbol, and each bit.
LEVELS = 1 + BITS
#: Entries of a block and queries of a task where dense buckets are scored whole; how many times the
#: share of patternless data, and what part of the budget, a bucket exceeds to be dense (of a smaller
#: one the trees, each with other entries, see all but exp(-8) of it).  Where a tree has none, one of a whole
#: string, looked at beyond the budget too, is dense above a tree's part of it: the rest keep within it together.
BLOCK_ROWS, BLOCK_QUERIES, DENSE, PART_OF_BUDGET = 4096, 2048, 4, 8


EMPTY = pa.table({"asker": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})


def budget_for(n: int) -> int:
    """Entries that all trees together give a query: with the square root of the index, recall stays on patternless data."""
    return math.ceil(28 * math.sqrt(n))


def turns_for(dims: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """For each tree a random rotation, and the normals of its planes, side by side."""
    rng = np.random.default_rng(seed)
    turns = np.hstack([np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(TREES)]).astype(np.float32)
    return turns, rng.standard_normal((dims, TREES * BITS)).astype(np.float32)


def hash_strings(vectors: np.ndarray, turns: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each vector and tree a string: the nearest signed axis after a rotation, then sides of planes.

    Strings are packed from the highest bit down, so number order is string order.
    """
    dims = vectors.shape[1]
    out = np.zeros((len(vectors), TREES), np.int64)
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for a in range(0, len(vectors), 128):
        x = vectors[a : a + 128].astype(np.float32)
        y = (x @ turns).reshape(-1, TREES, dims)
        axis = np.abs(y).argmax(axis=2)
        symbol = 2 * axis + (np.take_along_axis(y, axis[..., None], 2)[..., 0] > 0)
        out[a : a + 128] = symbol << BITS | ((x @ planes).reshape(-1, TREES, BITS) > 0) @ weights
    return out


def prefixes(strings: np.ndarray, level: int | np.ndarray) -> np.ndarray:
    """What strings begin with, down to a level; the root's prefix is 0."""
    return np.where(np.asarray(level) > 0, strings >> (LEVELS - np.maximum(level, 1)), 0)


def bucket_bounds(strings: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first string of the bucket that each string is in at its level, and the first one behind it."""
    shift = np.where(levels > 0, LEVELS - levels, 62).astype(np.int64)
    first = strings >> shift << shift
    return first, first + (np.int64(1) << shift)


def _as_matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


class Reached:
    """Candidates of queries, as columns: asker, rep, block, low and high bound of the cosine."""

    NAMES, SCHEMA = ["asker", "rep", "block", "low", "high"], "asker long, rep long, block long, low float, high float"

    def __init__(self, k: int):
        self.k = k
        self.columns: list[list[np.ndarray]] = [[] for _ in self.NAMES]

    def look(self, rows: dict[str, np.ndarray], q: int, near: np.ndarray) -> None:
        """Of the entries ``near`` those that may be among the k + 1 best of place q."""
        off, x = rows["off"], rows["x"]
        scores = x[near] @ x[q]
        error = off[q] + off[near] + off[q] * off[near]
        low, high = scores - error, scores + error
        some = high >= (np.partition(low, -self.k - 1)[-self.k - 1] if len(low) > self.k else -np.inf)
        found = (np.full(some.sum(), rows["asker"][q]), rows["rep"][near[some]], rows["block"][near[some]], low[some], high[some])
        for column, value in zip(self.columns, found):
            column.append(value)

    def batch(self) -> pa.RecordBatch | None:
        return _wider({n: np.concatenate(c) for n, c in zip(self.NAMES, self.columns)}, *_columns(self.SCHEMA)) if self.columns[0] else None


def _wider(own: dict[str, np.ndarray], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    m = len(next(iter(own.values())))
    return pa.RecordBatch.from_arrays([pa.array(own[n]).cast(k) if n in own else pa.nulls(m, k) for n, k in zip(names, kinds)], names)


def _columns(schema: str) -> tuple[list[str], list[pa.DataType]]:
    types = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}
    pairs = [column.split(" ") for column in schema.split(", ")]
    return [n for n, _ in pairs], [types[t] for _, t in pairs]


COUNTED = "tree int, level int, prefix long, asker long, others long, block long, held long"
#: The block of a marker, which is no entry, and the ids by which markers stand before and behind all entries of a string.
MARKER, BEFORE, BEHIND = -1, -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists(e, lambda x: x != 0))


def counted(arrays: DataFrame, most_sparse: list[float]) -> DataFrame:
    """How many entries share each prefix of each query, from the sorted arrays (tree, string, rep, block, asked).

    A query gets ``others`` where its run of one prefix lies within a range; where the run may go on in
    another range, or is long, the run's entries are given by block (block, held) beside its queries.
    """
    names, kinds = _columns(COUNTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        trees, strings, reps, blocks, asked = (table[c].to_numpy() for c in ("tree", "string", "rep", "block", "asked"))
        cuts = np.flatnonzero(np.concatenate(([True], trees[1:] != trees[:-1], [True]))).tolist()
        for a, b in zip(cuts, cuts[1:]):
            tree, asks = int(trees[a]), np.flatnonzero(asked[a:b])
            for level in range(0 if tree == 0 else 1, LEVELS + 1):
                prefix = prefixes(strings[a:b], level)
                ends = np.flatnonzero(np.concatenate((prefix[1:] != prefix[:-1], [True]))) + 1
                starts = np.concatenate(([0], ends[:-1]))
                wide = (ends - starts > most_sparse[level]) | ((starts == 0) & (a == 0)) | ((ends == b - a) & (b == len(strings)))
                run = np.searchsorted(ends, asks, side="right")
                alike = (ends - starts)[run] - 1
                own = {"tree": np.full(len(asks), tree), "level": np.full(len(asks), level), "prefix": prefix[asks], "asker": reps[a:b][asks]}
                inside = ~wide[run] & (alike > 0)
                if inside.any():
                    yield _wider({n: v[inside] for n, v in own.items()} | {"others": alike[inside]}, names, kinds)
                if wide[run].any():
                    yield _wider({n: v[wide[run]] for n, v in own.items()}, names, kinds)
                for lo, hi in zip(starts[wide].tolist(), ends[wide].tolist()):
                    ids, sizes = np.unique(blocks[a + lo : a + hi], return_counts=True)
                    same = {"tree": tree, "level": level, "prefix": prefix[lo]}
                    yield _wider({n: np.full(len(ids), v) for n, v in same.items()} | {"block": ids, "held": sizes}, names, kinds)

    return arrays.mapInArrow(count, COUNTED)


def ascent(counts: DataFrame, k: int, budget: int) -> DataFrame:
    """How far each query ascends in each tree: asker, tree, level, others there, and gained by all trees so far.

    ``counts`` holds asker, tree, level, prefix and others.  All trees ascend together, a level after the
    other and a tree after the other within it, as long as their entries, counted in every tree that
    gives them, are within ``budget``; and beyond it while no bucket holds k entries beside the query.
    """
    deeper = Window.partitionBy("asker", "tree").orderBy(F.desc("level"))
    so_far = Window.partitionBy("asker").orderBy(F.desc("level"), "tree")
    steps = counts.withColumn("gain", F.col("others") - F.coalesce(F.lag("others").over(deeper), F.lit(0)))
    steps = steps.withColumn("gained", F.sum("gain").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("before", F.coalesce(F.max("others").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = steps.where((F.col("gained") <= budget) | (F.col("before") < k) | (F.col("level") == LEVELS))
    top = F.min(F.struct("level", "prefix", "others")).alias("top")
    return taken.groupBy("asker", "tree").agg(top, F.max("gained").alias("gained")).select("asker", "tree", "top.level", "top.prefix", "top.others", "gained")


class Forest:
    """The entries of one length of vectors, hashed and in blocks, and how far each query ascends."""

    def __init__(self, entries: DataFrame, dims: int, k: int, budget: int | None = None):
        spark = entries.sparkSession
        self.dims, self.k, self.spark = dims, k, spark
        self.n = n = entries.count()
        self.budget = budget or budget_for(n)
        shares = [1.0] + [1 / (2 * dims) / 2**bit for bit in range(LEVELS)]
        self.most_sparse = [math.inf] + [max(self.budget / PART_OF_BUDGET, DENSE * n * share) for share in shares[1:]]
        self.most_equal = max(self.budget / TREES, DENSE * n * shares[LEVELS])

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns, planes = turns_for(dims)
            for batch in batches:
                for a in range(0, batch.num_rows, 2000):
                    part = batch.slice(a, 2000)
                    x = _as_matrix(part.column(2), dims)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    strings = hash_strings(x, turns, planes)
                    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
                    small = np.rint(x / scale[:, None]).astype(np.int8)
                    off = np.linalg.norm(x - small * scale[:, None].astype(np.float64), axis=1) + 1e-5  # and float32 sums
                    held = [pa.array([v.tobytes() for v in m], pa.binary()) for m in (strings, small)]
                    made = [pa.array(strings[:, 0]), pa.array(scale), pa.array(off.astype(np.float32)), *held]
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "first", "scale", "off", "strings", "small"])

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, part = 0, TaskContext.get().partitionId() << 32
            for batch in batches:
                block = part + np.arange(at, at + batch.num_rows) // BLOCK_ROWS
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "block"])

        base = "rep long, ids array<long>, embedding array<double>, asked boolean"
        more = ", first long, scale float, off float, strings binary, small binary"
        entries = stage(spark, entries.select("rep", "ids", "embedding", "asked").mapInArrow(hashed, base + more), "forest-strings")
        ranges = max(1, min(shuffle_width(spark), -(-n // BLOCK_ROWS)), -(-n // (16 * BLOCK_ROWS)))
        entries = entries.repartitionByRange(ranges, "first", "rep").sortWithinPartitions("first", "rep").mapInArrow(numbered, base + more + ", block long")
        self.entries = stage(spark, entries, "forest-blocks")

        self.bucket = bucket = ["tree", "level", "prefix"]
        light = self.arrays(self.entries, ["asked"], "asked boolean").select("tree", "string", "rep", "block", "asked")
        self.counts = counts = stage(spark, counted(self.sorted(light), [*self.most_sparse[:LEVELS], self.most_equal]), "forest-counts")
        self.runs = counts.where("held is not null").groupBy(*bucket, "block").agg(F.sum("held").alias("held"))
        self.totals = stage(spark, self.runs.groupBy(*bucket).agg(F.sum("held").alias("total")), "forest-totals")
        self.open = counts.where("asker is not null and others is null").select(*bucket, "asker")
        joined = self.open.join(self.totals, bucket).select("asker", *bucket, (F.col("total") - 1).alias("others")).where("others > 0")
        known = counts.where("others is not null").select("asker", *bucket, "others").unionByName(joined)
        limit = F.element_at(F.array(*[F.lit(float(m)) for m in self.most_sparse]), F.col("level") + 1)
        dense = self.totals.withColumn("usual", F.col("total") > limit).where(F.col("usual") | ((F.col("level") == LEVELS) & (F.col("total") > self.most_equal)))
        deepest = self.open.join(dense.drop("total"), bucket).groupBy("asker", "tree").agg(F.max(F.struct("usual", "level", "prefix")).alias("at"))
        self.deepest = stage(spark, deepest.select("asker", "tree", "at.level", "at.prefix"), "forest-deepest")
        within = self.deepest.select("asker", "tree", F.col("level").alias("dense"))
        self.ascents = stage(spark, ascent(known, k, self.budget).join(within, ["asker", "tree"], "left"), "forest-ascents")

    def sorted(self, rows: DataFrame) -> DataFrame:
        """The trees' arrays, cut into ranges that hold several budgets, so that a run within it meets two at most."""
        each, n = max(PART_ROWS, 4 * self.budget), self.n * TREES
        parts = max(1, min(shuffle_width(self.spark) * 4, n // each), n // (4 * each))
        return rows.repartitionByRange(parts, "tree", "string", "rep").sortWithinPartitions("tree", "string", "rep")

    def arrays(self, entries: DataFrame, names: list[str], schema: str) -> DataFrame:
        """A row for each entry and tree, with columns ``names``.

        ``levels``, a number a tree, becomes ``level`` and ``asker``.  A query that has a level also gets two
        markers, before and behind all entries of the bucket there, so that the ranges in which its run
        begins and ends have a row of it, wherever the arrays are cut.
        """

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 2000):
                    part = batch.slice(a, 2000)
                    strings = np.frombuffer(b"".join(part.column(0).to_pylist()), np.int64).reshape(-1, TREES)
                    for tree in range(TREES):
                        own = {"tree": pa.array(np.full(len(strings), tree, np.int32)), "string": pa.array(strings[:, tree])}
                        own |= {n: part.column(n) for n in ["rep", "block", *names] if n != "levels"}
                        if "levels" in names:
                            own["level"] = pc.list_element(part.column("levels"), tree)
                            own["asker"] = pc.if_else(own["level"].is_valid(), own["rep"], pa.scalar(None, pa.int64()))
                        made = pa.RecordBatch.from_pydict(own)
                        yield made
                        if "levels" in names and (asks := made.filter(own["level"].is_valid())).num_rows:
                            first, behind = bucket_bounds(asks["string"].to_numpy(), asks["level"].to_numpy())
                            for string, rep in ((first, BEFORE), (behind - 1, BEHIND)):
                                mark = {"string": string, "rep": np.full(len(string), rep), "block": np.full(len(string), MARKER)}
                                yield pa.RecordBatch.from_arrays([pa.array(mark[n]) if n in mark else asks[n] for n in own], list(own))

        return entries.select("strings", "rep", "block", *names).mapInArrow(grow, f"tree int, string long, rep long, block long, {schema}")

    def blocks_wanted(self) -> DataFrame:
        """Queries and the blocks they are scored against whole (asker, block), each pair once.

        These hold the deepest dense bucket of the query in each tree, and any bucket that the query
        ascends to and that exceeds the budget.
        """
        over = self.ascents.where(F.col("others") > self.budget).select("asker", *self.bucket)
        return self.deepest.unionByName(over).join(self.runs.select(*self.bucket, "block"), self.bucket).select("asker", "block").distinct()

    def found(self) -> DataFrame:
        """Candidates from the sorted arrays (asker, rep, block, low, high): the runs that queries ascend to.

        A run that goes on in another range is looked at there too, by the query's marker: queries
        cross the edges of ranges, entries do not.  A run within a dense bucket is left to the blocks,
        which hold all of it: the 8 bits do not tell near copies apart, so that each tree would hand
        all of them to each of their queries.
        """
        k, dims = self.k, self.dims

        def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            rows = {c: table[c].to_numpy() for c in ("tree", "string", "rep", "block", "off")}
            small = np.frombuffer(b"".join(table["small"].to_pylist()), np.int8).reshape(-1, dims).astype(np.float32)
            rows |= {"asker": table["asker"].fill_null(-1).to_numpy(), "level": table["level"].fill_null(-1).to_numpy(), "x": small * table["scale"].to_numpy()[:, None]}
            reached, trees = Reached(k), rows["tree"]
            cuts = np.flatnonzero(np.concatenate(([True], trees[1:] != trees[:-1], [True]))).tolist()
            for a, b in zip(cuts, cuts[1:]):
                entries, asks = a + np.flatnonzero(rows["block"][a:b] != MARKER), a + np.flatnonzero(rows["level"][a:b] >= 0)
                asks = asks[np.unique(rows["asker"][asks], return_index=True)[1]]  # once, however many rows it has here
                bounds = bucket_bounds(rows["string"][asks], rows["level"][asks])
                starts, ends = (np.searchsorted(rows["string"][entries], bound) for bound in bounds)
                for q, lo, hi in zip(asks.tolist(), starts.tolist(), ends.tolist()):
                    if lo < hi:
                        reached.look(rows, q, entries[lo:hi])
            if (batch := reached.batch()) is not None:
                yield batch

        # buckets beyond the budget, and those within a dense one, are scored whole, by blocks
        looks = self.ascents.where(F.col("others") <= self.budget).where("dense is null or level < dense")
        tops = looks.groupBy("asker").agg(F.map_from_entries(F.collect_list(F.struct("tree", "level"))).alias("tops"))
        tops = tops.select(F.col("asker").alias("rep"), F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.element_at("tops", t)).alias("levels"))
        entries = self.entries.drop("embedding", "ids").join(tops, "rep", "left")
        arrays = self.arrays(entries, ["scale", "off", "small", "levels"], "scale float, off float, small binary, level int, asker long")
        found = stage(self.spark, self.sorted(arrays).mapInArrow(climb, Reached.SCHEMA), "forest-found")
        return found.groupBy("asker", "rep", "block").agg(F.max("low").alias("low"), F.min("high").alias("high"))

    def scored(self) -> DataFrame:
        """The k + 1 best entries of each query at least, with exact cosines: asker, ids, score."""
        k, dims = self.k, self.dims
        wanted = stage(self.spark, self.blocks_wanted(), "forest-dense")
        reached = self.found().join(wanted, ["asker", "block"], "left_anti").withColumn("at", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("low"), "rep")))
        least = F.max(F.when(F.col("at") == k + 1, F.col("low"))).over(Window.partitionBy("asker"))
        best = reached.withColumn("least", least).where("least is null or high >= least")
        one = self.entries.where("asked").select(F.col("rep").alias("asker"), F.col("embedding").alias("own"))
        pairs = best.select("asker", "rep").join(one, "asker").join(self.entries.select("rep", "ids", "embedding"), "rep").select("asker", "ids", "own", "embedding")

        def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = cosines(_as_matrix(batch.column(2), dims), _as_matrix(batch.column(3), dims))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["asker", "ids", "score"])

        def whole(left: pa.Table, right: pa.Table) -> pa.Table:
            """The k + 1 best entries of a block for each query sent to it."""
            if not left.num_rows or not right.num_rows:
                return EMPTY
            askers, own = left["asker"].to_numpy(), _as_matrix(left["own"].combine_chunks(), dims)
            reps, all_ = right["rep"].to_numpy(), _as_matrix(right["embedding"].combine_chunks(), dims)
            unit = lambda v: v / np.abs(v).max(axis=1, keepdims=True) / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True)
            turned, rows, picked, scores = unit(all_).T, [], [], []
            for a in range(0, len(own), 256):
                for q, near in enumerate(unit(own[a : a + 256]) @ turned, a):
                    some = np.flatnonzero(near >= np.partition(near, -k - 1)[-k - 1] - 1e-12) if len(near) > k else np.arange(len(near))
                    score = cosines(np.broadcast_to(own[q], (len(some), dims)), all_[some])
                    best = np.lexsort((reps[some], -score))[: k + 1]
                    rows.append(np.full(len(best), askers[q]))
                    picked.append(some[best])
                    scores.append(score[best])
            ids = right["ids"].combine_chunks().take(pa.array(np.concatenate(picked)))
            return pa.table({"asker": np.concatenate(rows), "ids": ids, "score": np.concatenate(scores)})

        scored = pairs.mapInArrow(exact, "asker long, ids array<long>, score double")
        if wanted.isEmpty():
            return scored
        shares = wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("shares"))
        sent = wanted.join(shares, "block").join(one, "asker").select("block", F.pmod(F.xxhash64("asker"), F.col("shares")).cast("int").alias("share"), "asker", "own")
        held = self.entries.select("block", "rep", "ids", "embedding").join(shares, "block").select("block", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), "rep", "ids", "embedding")
        both = sent.groupBy("block", "share").cogroup(held.groupBy("block", "share"))
        return scored.unionByName(both.applyInArrow(whole, "asker long, ids array<long>, score double"))


def forest_of(rows: DataFrame, dims: int, k: int, query: str, budget: int | None = None) -> tuple[Forest, DataFrame]:
    """The forest of the vectors of one length, and its query rows (vec_id, asker).

    Equal vectors become one entry with its k + 1 smallest ids.
    """
    rows = rows.where(F.size("embedding") == dims).dropDuplicates(["vec_id", "embedding"])
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = rows.withColumn("at", first).where(F.col("at") <= k + 1).groupBy("embedding")
    entries = entries.agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(query)
    entries = entries.join(asked.groupBy("embedding").agg(F.lit(True).alias("asked")), "embedding", "left")
    entries = stage(rows.sparkSession, entries.select("rep", "ids", "embedding", F.coalesce("asked", F.lit(False)).alias("asked")), "forest-entries")
    asks = asked.join(entries.where("asked").select("embedding", F.col("rep").alias("asker")), "embedding")
    return Forest(entries, dims, k, budget), asks.select(F.col("vec_id").alias("query_id"), "asker")


def nearest(vectors: DataFrame, k: int = 5, query: str = "vec_id % 50 = 0", budget: int | None = None) -> DataFrame:
    """The ``k`` nearest rows by cosine to each query row: query_id, rank, vec_id, score.

    * Equal vectors become one entry with its k + 1 smallest ids (ties go to smaller ids, and a query
      takes itself out), so copies never meet in one place and each distinct query is searched once.
    * Each tree is one sorted array of hash strings, cut into ranges.  A first pass counts how many
      entries share each prefix of each query; from its longest matches a query ascends in all trees
      together, a level at a time, until they give ``budget`` entries (``ascent``).  A second pass over
      the arrays, whose entries carry the vector in 8 bits a component and that vector's distance from
      it, looks at all entries of the buckets so reached, and none else.
    * A bucket above one ``PART_OF_BUDGET``-th of the budget (of whole strings, in a tree that has no
      such: one ``TREES``-th), and ``DENSE`` times what patternless data would give its level, is dense.
      Its entries stand in blocks by the string of the first tree; a query is scored exactly against
      every entry of all blocks its deepest dense buckets touch, each block once, so no pair is scored
      twice and the most work is that of brute force; the second pass leaves such buckets out.  Buckets
      beyond the budget, to which a query ascends that has no k entries beside it below, are scored so too.
    * Of the other candidates all whose approximate cosine, with its error bound, may belong to the
      k + 1 best get exact ones in double precision.

    Vectors that are null, zero, or hold null or non-finite components take no part; neither do rows
    without vec_id.  A cosine needs vectors of one length, so that each length is a forest of its own,
    one after the other.  Repeated rows are one; an id with several vectors counts by the nearest of
    them, as query and as neighbour.  With fewer than k candidates all are given.  An empty table gives
    an empty result.
    """
    rows = usable(vectors)
    lengths = [r["dims"] for r in rows.where(query).select(F.size("embedding").alias("dims")).distinct().orderBy("dims").toLocalIterator()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def each(dims: int) -> DataFrame:
        forest, asks = forest_of(rows, dims, k, query, budget)
        top = forest.scored().withColumn("at", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("at") <= k + 1)
        return asks.join(top.select("asker", "score", F.explode("ids").alias("vec_id")), "asker").where("vec_id <> query_id").drop("asker")

    scored = reduce(DataFrame.unionByName, map(each, lengths)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
