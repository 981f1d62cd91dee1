"""Conversation prefix trie: succinct level-order tries by prefix shard, rolled up from below."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stage
from .louds import LABEL, Louds

#: Conversations a prefix may have to stand in a shard; those with more make the upper levels.
LIMIT = 256
#: Upper prefixes at most (4 MB of keys, one task's trie): LIMIT doubles until they are no more.
UPPER = 1 << 18
#: Levels that a shard's trie spans; longer conversations go on in further shards.
LEVELS = 32
#: Turns taken from the family's first conversation, below this number; conversations of a family.
HEADS, FAMILY = 9, 5
#: Bytes of ids in a piece of a node's list.
PIECE = 1 << 20
ROOT = bytes(LABEL)

_BLOCKS = "conv_id long, block int, before binary, keys binary, labels binary, sizes binary, n int, last boolean"
_PLACED = "bucket int, block int, key binary, parent binary, depth int, label binary, size long, ends long, least long"
_NODES = "key binary, parent binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _turns(conversations: DataFrame) -> DataFrame:
    """Each turn as the digest of its role and text and the text's bytes, so that no text is shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    id_ = F.col("conv_id").cast("long")
    return conversations.where(id_.isNotNull()).select(
        id_.alias("conv_id"), (id_ - id_ % FAMILY).alias("family"), F.col("turn").cast("long").alias("turn"), label.alias("label"), F.octet_length(text).cast("long").alias("size")
    )


class _Path:
    """The prefix keys of one rebuilt conversation, given out in blocks of some levels."""

    def __init__(self, conv_id: int, levels: int, out: list[tuple]):
        self.conv_id, self.levels, self.out, self.block = conv_id, levels, out, 0
        self.before, self.keys, self.labels, self.sizes = ROOT, [], [], []

    def add(self, label: bytes, size: int) -> None:
        if len(self.keys) == self.levels:
            self.end(last=False)
            self.block, self.before = self.block + 1, self.keys[-1]
            self.keys, self.labels, self.sizes = [], [], []
        self.keys.append(hashlib.blake2b((self.keys[-1] if self.keys else self.before) + label, digest_size=LABEL).digest())
        self.labels.append(label)
        self.sizes.append(size)

    def end(self, last: bool = True) -> None:
        sizes = np.array(self.sizes, "<i8").tobytes()
        self.out.append((self.conv_id, self.block, self.before, b"".join(self.keys), b"".join(self.labels), sizes, len(self.keys), last))


def _rebuilt(conversations: DataFrame, levels: int) -> DataFrame:
    """Every conversation as its first turns of the family's first one and its own later ones, in blocks of prefix keys.

    A family's rows come to one task in order and stream through it: no more than a block of one
    conversation and the first turns of the family stand in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("before", pa.binary()), ("keys", pa.binary()), ("labels", pa.binary()), ("sizes", pa.binary()), ("n", pa.int32()), ("last", pa.bool_())])
        out: list[tuple] = []
        family, path, heads, seen, taken = None, None, [], 0, 0

        def begin(conv_id: int) -> None:
            nonlocal path, seen, taken
            finish()
            path, seen, taken = _Path(conv_id, levels, out), 0, 0 if conv_id == family else zlib.crc32(str(conv_id).encode()) % HEADS
            for head in heads[:taken]:
                path.add(*head)

        def finish() -> None:
            if path is not None:
                path.end()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in small_batches(batches, 4096):
            for of, conv_id, label, size in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if of != family:
                    finish()
                    family, path, heads = of, None, []
                if path is None or conv_id != path.conv_id:
                    begin(conv_id)
                seen += 1
                if conv_id == family and seen < HEADS:
                    heads.append((label, size))
                if seen > taken:
                    path.add(label, size)
            if len(out) >= 2048:
                yield made()
        finish()
        if out:
            yield made()

    turns = _turns(conversations).repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("turn"), "label")
    return turns.select("family", "conv_id", "turn", "label", "size").mapInArrow(run, _BLOCKS)


def _upper(blocks: DataFrame, limit: int, most: int) -> tuple[set[bytes], int]:
    """The prefixes of more than ``limit`` conversations, and that limit, doubled until they are ``most`` or fewer."""
    every = blocks.where("n > 0").select("keys", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    counts = every.groupBy(F.expr(f"substring(keys, {LABEL} * i + 1, {LABEL})").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    heavy = stage(blocks.sparkSession, counts.where(F.col("n") > limit), "trie-upper")
    while heavy.where(F.col("n") > limit).count() > most:
        limit *= 2
    return {r.key for r in heavy.where(F.col("n") > limit).select("key").toLocalIterator()}, limit


def _placed(blocks: DataFrame, upper: set[bytes], buckets: int, levels: int) -> DataFrame:
    """A row for each turn: in bucket -1 where its prefix is an upper one, else in that of the shortest prefix which is not."""
    known = blocks.sparkSession.sparkContext.broadcast(upper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in _PLACED.split(", ")]
        for batch in small_batches(batches, 1024):
            rows: list[tuple] = []
            for conv_id, block, parent, keys, labels, sizes, n, last in zip(*(c.to_pylist() for c in batch.columns)):
                bucket = -1
                for k, size in enumerate(np.frombuffer(sizes, "<i8").tolist()):
                    key, label = keys[LABEL * k : LABEL * (k + 1)], labels[LABEL * k : LABEL * (k + 1)]
                    if bucket < 0 and key not in known.value:
                        bucket = int.from_bytes(key[:8]) % buckets
                    ends = int(last and k == n - 1)
                    rows.append((bucket, block, key, parent, block * levels + k + 1, label, size, ends, conv_id if ends else None))
                    parent = key
                if not n:
                    rows.append((-1, 0, ROOT, b"", 0, ROOT, 0, 1, conv_id))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return blocks.mapInArrow(run, _PLACED)


def _trie(table: pa.Table) -> tuple[Louds, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The trie of a shard's rows under a root of its own, whose edges bear whole prefixes (keys) instead of
    turns; the first row of each distinct key, the key of each row, the key of each numbered node, and the keys."""
    keys = table.column("key").combine_chunks().dictionary_encode()
    node = keys.indices.to_numpy()
    own = np.flatnonzero(table.column("parent").is_valid().to_numpy())
    first = np.zeros(len(keys.dictionary), np.int64)
    first[node[own]] = own
    above = pc.fill_null(pc.index_in(table.column("parent").take(pa.array(first)), keys.dictionary), -1).to_numpy()
    depths = table.column("depth").to_numpy()[first]
    levels = np.zeros(len(first) + 1, np.int64)  # the last place is that of the shard's own root
    order = np.argsort(depths, kind="stable")
    bounds = np.flatnonzero(np.diff(depths[order], prepend=-1, append=depths.max(initial=0) + 1))
    for a, b in zip(bounds, bounds[1:]):
        levels[order[a:b]] = levels[above[order[a:b]]] + 1
    edges = pc.if_else(pa.array(above < 0), table.column("key").take(pa.array(first)), table.column("label").take(pa.array(first)))
    labels = b"".join(edges.to_pylist())
    trie, placed = Louds.build(above, levels[:-1], labels)
    return trie, first, node, placed, keys.dictionary


def _rolled_up(table: pa.Table) -> pa.Table:
    """The nodes of a shard with counts of conversations, children, leaves and saved bytes.

    Rows with a parent are turns (``ends`` conversations end there, the smallest of them is ``least``);
    rows without one bring a node what the shards below it have counted.  Levels are added to their
    parents from the lowest up.
    """
    trie, first, node, placed, keys = _trie(table)
    n, column = len(first), lambda name: pc.fill_null(table.column(name), 0).to_numpy()
    number = np.empty(n, np.int64)
    number[placed] = np.arange(1, n + 1)
    at = number[node]
    convs, below, leaves, saved = np.zeros((4, n + 1), np.int64)
    least, none = np.full(n + 1, np.iinfo(np.int64).max), np.iinfo(np.int64).max
    for total, name in ((convs, "ends"), (below, "children"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(total, at, column(name))
    np.minimum.at(least, at, pc.fill_null(table.column("least"), none).to_numpy())
    size = np.concatenate(([0], column("size")[first[placed]]))
    below += trie.degrees()
    up = np.concatenate(([0], trie.parents()))
    for a, b in reversed(trie.levels()):
        leaves[a:b] += below[a:b] == 0
        saved[a:b] += (convs[a:b] - 1) * size[a:b]
        for total in (convs, leaves, saved):
            np.add.at(total, up[a:b], total[a:b])
        np.minimum.at(least, up[a:b], least[a:b])
    rows = pa.array(first[placed])
    return pa.table({
        "key": keys.take(pa.array(placed)), "parent": table.column("parent").take(rows), "depth": table.column("depth").take(rows), "conv_id": pa.array(least[1:]),
        "parent_conv_id": pa.array(least[up[1:]], mask=up[1:] == 0), "n_convs": pa.array(convs[1:]), "n_children": pa.array(below[1:]), "n_leaves": pa.array(leaves[1:]), "saved_tokens": pa.array(saved[1:]),
    })


def _above(nodes: DataFrame) -> DataFrame:
    """What the topmost nodes of shards bring to their parents, as rows for ``_rolled_up``."""
    tops = nodes.where("parent_conv_id is null").groupBy(F.col("parent").alias("key"))
    return tops.agg(F.sum("n_convs").alias("ends"), F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


class Trie:
    """The trie of all rebuilt conversations, cut into shards; made by ``build``."""

    def __init__(self, blocks: DataFrame, placed: DataFrame, upper: set[bytes], levels: int):
        self.blocks, self.placed, self.upper, self.levels = blocks, placed, upper, levels

    def shards(self) -> DataFrame:
        """Every shard below the upper levels as a succinct trie: bucket, block, n, louds, labels.  Labels are
        digests of turns, those at the top of a shard keys of the whole prefixes that lead there."""

        def run(key: tuple, table: pa.Table) -> pa.Table:
            trie = _trie(table)[0]
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(trie) - 1]), "louds": [trie.pack()], "labels": [trie.labels]})

        return self.placed.where("bucket >= 0").groupBy("bucket", "block").applyInArrow(run, "bucket int, block int, n long, louds binary, labels binary")

    def nodes(self) -> DataFrame:
        """Every node: key and parent's key, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens."""
        spark = self.blocks.sparkSession
        empty = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
        base = self.placed.select("*", *empty)
        blocks = self.placed.agg(F.max("block")).first()[0]
        if blocks is None:
            return spark.createDataFrame([], _NODES)
        light, brought = None, None
        for block in range(blocks, -1, -1):  # from the lowest; nearly always there is one
            rows = base.where((F.col("block") == block) & (F.col("bucket") >= 0))
            if brought is not None:
                homes = rows.select("key", "bucket").distinct()
                rows = rows.unionByName(brought.join(homes, "key"), allowMissingColumns=True)
            found = stage(spark, rows.groupBy("bucket").applyInArrow(_rolled_up, _NODES), "trie-nodes")
            light = found if light is None else light.unionByName(found)
            brought = _above(found)
        upper = base.where("bucket = -1").groupBy("key", "parent", "depth", "label", "size").agg(F.sum("ends").alias("ends"), F.min("least").alias("least"))
        root = spark.createDataFrame([(bytearray(ROOT), bytearray(b""), 0, bytearray(ROOT), 0, 0)], "key binary, parent binary, depth int, label binary, size long, ends long")
        upper = upper.unionByName(root, allowMissingColumns=True).select("*", *empty)
        above = stage(spark, _above(light), "trie-above")
        known = upper.select("key").distinct()
        rows = upper.unionByName(above.join(known, "key", "left_semi"), allowMissingColumns=True)
        upper = stage(spark, rows.groupBy().applyInArrow(_rolled_up, _NODES), "trie-upper-nodes")
        # the upper nodes are bounded by UPPER, so that they can be broadcast
        up = F.broadcast(upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("over")))
        out = light.join(up, "parent", "left")
        if blocks:
            edge = light.where((F.col("depth") % self.levels == 0)).select(F.col("key").alias("parent"), F.col("conv_id").alias("across"))
            out = out.join(edge, "parent", "left").withColumn("over", F.coalesce("over", "across")).drop("across")
        out = out.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over")).drop("over")
        return out.unionByName(upper)

    def ends(self) -> DataFrame:
        """conv_id and the key of the node at which it ends."""
        key = F.when(F.col("n") == 0, F.lit(bytearray(ROOT))).otherwise(F.expr(f"substring(keys, {LABEL} * (n - 1) + 1, {LABEL})"))
        return self.blocks.where("last").select(key.alias("key"), "conv_id")


def build(conversations: DataFrame, limit: int = LIMIT, most: int = UPPER, levels: int = LEVELS) -> Trie:
    """Rebuild every conversation from its family's first one and make the prefix trie of all.

    Turns travel as digests.  Prefixes of more than ``limit`` conversations, which no shard should
    gather, are the upper levels; every other prefix is in the shard of the shortest such one above
    it, and shards gather about ``limit`` conversations, ``levels`` turns of each.  Shards are rolled
    up where they are, what their topmost nodes have counted is summed by parent, and the upper
    levels, bounded by ``most``, merge last.

    A null role or text is empty; turns are ordered by turn, nulls first, then by a digest of role
    and text; repeated rows are turns of their own; rows without a conv_id take no part; an empty
    table has no nodes, not even a root; other columns are ignored.
    """
    spark = conversations.sparkSession
    blocks = stage(spark, _rebuilt(conversations, levels), "trie-blocks")
    upper, limit = _upper(blocks, limit, most)
    buckets = -(-blocks.where("last").count() // limit)
    placed = stage(spark, _placed(blocks, upper, max(1, buckets), levels), "trie-placed")
    return Trie(blocks, placed, upper, levels)


def id_lists(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """key, first, ids: the conversations that end at each node, ascending, comma-joined, in pieces.

    Rows are dealt by ranges of key and id, so that a node where many end has several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, length, out = None, [], 0, []

        def close() -> None:
            if ids:
                out.append((key, ids[0], ",".join(map(str, ids)).encode()))

        def made() -> pa.RecordBatch:
            columns = zip(*out) if out else ((), (), ())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.binary()))], ["key", "first", "ids"])
            out.clear()
            return batch

        for batch in small_batches(batches, 8192):
            for of, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != key or length >= piece:
                    close()
                    key, ids, length = of, [], 0
                ids.append(conv_id)
                length += len(str(conv_id)) + 1
            yield made()
        close()
        yield made()

    ranged = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return ranged.mapInArrow(run, "key binary, first long, ids binary")


def list_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """key, ends_sha256: the digest of each node's whole list, whose pieces stream through one task in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in small_batches(batches, 1024):
            done = []
            for of, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if of != key:
                    done += [(key, digest.hexdigest())] if digest else []
                    key, digest = of, hashlib.sha256(ids)
                else:
                    digest.update(b"," + ids)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["key", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    pieces = id_lists(ends, piece).repartition("key").sortWithinPartitions("key", "first")
    return pieces.mapInArrow(run, "key binary, ends_sha256 string")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = build(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    named = trie.nodes().join(list_digests(trie.ends()), "key", "left")
    return named.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).withColumn("depth", F.col("depth").cast("long")).drop("key", "parent")


ORACLE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY i) AS seq FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, seq, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
           lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, byte)),
           4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(d.seq, [])[1:c.h], c.seq[c.h + 1:]) AS seq
  FROM heads c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, seq[1:d] AS seq, d, d = len(r.seq) AS ends FROM rebuilt r, LATERAL (SELECT unnest(generate_series(0, len(r.seq))) AS d)),
nodes AS (
  SELECT seq, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY seq, d),
parents AS (SELECT seq[1:d - 1] AS seq, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(p.n_children, 0) AS n_children FROM nodes n LEFT JOIN parents p USING (seq)),
rolled AS (
  SELECT f.seq[1:a.d] AS seq, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * CASE WHEN f.d = 0 THEN 0 ELSE strlen(f.seq[f.d].text) END)::BIGINT AS saved_tokens
  FROM full_nodes f, LATERAL (SELECT unnest(generate_series(0, f.d)) AS d) a GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, r.n_leaves, r.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN rolled r USING (seq) LEFT JOIN nodes p ON f.d > 0 AND p.d = f.d - 1 AND p.seq = f.seq[1:f.d - 1]
"""
