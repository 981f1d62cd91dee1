"""N-gram Jaccard join: a grouped prefix join over five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shuffle_width, stage
from .components import connected_components
from .inverted import answers, blocks_of, chunk_answer, long_id, null_safe, range_bits, window_hashes, word_hashes

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles of a candidate component that one task verifies at once; larger ones are verified by pairs.
BLOCK = 1_000_000
#: Rounds in which the sets of a large component are held against pivots, before pairs are listed;
#: they end when the pairs left are at most so many times the prefix entries.
ROUNDS, FEW_PAIRS = 6, 4
_U = np.uint64


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; one for a text of fewer words, none for none."""
    words, bounds = word_hashes(texts, lower=True)
    windows, cuts = window_hashes(words, SHINGLE), bounds.tolist()
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= SHINGLE:
            yield np.unique(windows[a : b - SHINGLE + 1])
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)], _U)
        else:
            yield np.zeros(0, _U)


def enough(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m with so many members in common are linked."""
    return 100 * both >= PERCENT * (n + m - both)


def _sums(mark: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many codes of each slice (none empty) are marked."""
    before = np.cumsum(sizes) - sizes
    places = np.repeat(starts - before, sizes) + np.arange(sizes.sum())
    return np.add.reduceat(mark[codes[places]], before, dtype=np.int64)


class Groups:
    """Sets of one size and prefix as groups, by ascending size, and an index of the groups' prefixes.

    A link needs so many shingles in common that its first common one, in the order all sets share,
    has at least as many left behind it in both sets.  So of the smaller set only a shorter part of
    the prefix is indexed, and a place in the larger set's prefix leaves a range of sizes.
    """

    def __init__(self, n: np.ndarray, sets: list[np.ndarray], prefix: np.ndarray):
        heads = [s[:k].tobytes() for s, k in zip(sets, prefix.tolist())]
        self.order = order = np.array(sorted(range(len(sets)), key=lambda i: (n[i], heads[i])))
        self.sizes = n[order].astype(np.int64)
        new = [k == 0 or self.sizes[k] != self.sizes[k - 1] or heads[i] != heads[order[k - 1]] for k, i in enumerate(order.tolist())]
        self.cuts = np.append(np.flatnonzero(new), len(order))
        _, self.codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        self.lengths = np.array([len(sets[i]) for i in order])
        self.starts = np.cumsum(self.lengths) - self.lengths
        at = self.cuts[:-1]
        self.n, self.short = self.sizes[at], prefix[order][at].astype(np.int64)
        longest = np.maximum.reduceat(self.lengths, at)
        before = np.cumsum(self.short) - self.short
        group = np.repeat(np.arange(len(at)), self.short)
        place = np.arange(self.short.sum()) - np.repeat(before, self.short)
        self.tokens, self.rest = self.codes[self.starts[at][group] + place], longest[group] - place
        some = np.flatnonzero((100 + PERCENT) * self.rest >= 2 * PERCENT * self.n[group])
        some = some[np.lexsort((group[some], self.tokens[some]))]
        self.keys = self.tokens[some] * len(at) + group[some]
        self.groups, self.left, self.before = group[some], self.rest[some], before
        self.firsts = np.searchsorted(self.keys, np.arange(self.codes.max(initial=0) + 1) * len(at))

    def probes(self, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of group g's prefix the shingles, and where smaller groups that have them stand in the index."""
        own = slice(self.before[g], self.before[g] + self.short[g])
        tokens, n = self.tokens[own], self.n[g]
        least = np.searchsorted(self.n, -(-PERCENT * n // 100))
        most = np.minimum(np.searchsorted(self.n, (100 + PERCENT) * self.rest[own] // PERCENT - n, side="right"), g)
        a, b = (np.searchsorted(self.keys, tokens * len(self.n) + x) for x in (least, most))
        return tokens, a, np.maximum(a, b)

    def found(self, g: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Groups at the places of the index that may have a link with group g."""
        held = b - a
        places = np.repeat(a - (np.cumsum(held) - held), held) + np.arange(held.sum())
        other = self.groups[places]
        return np.unique(other[(100 + PERCENT) * self.left[places] >= PERCENT * (self.n[g] + self.n[other])])

    def members(self, groups: np.ndarray) -> np.ndarray:
        held = self.cuts[groups + 1] - self.cuts[groups]
        return np.repeat(self.cuts[groups] - (np.cumsum(held) - held), held) + np.arange(held.sum())


def linked(n: np.ndarray, sets: list[np.ndarray], prefix: np.ndarray) -> np.ndarray:
    """Labels of the components that links form among sets; n: whole sizes, of which sets hold the
    shingles that other documents have too, in an order common to all, the first ``prefix`` of them
    as the prefix.

    Sets of one size and prefix are a group.  By ascending size, each group looks up the smaller
    groups that its prefix shares a shingle with, as far as sizes and places of the shingle allow a
    link; these expand to their members, without those that are in a set's component already, and
    are verified: a few at first and more if those show no link.  Where all groups before some place
    of a shingle's list are one component, sets of that component skip them.
    """
    own = Groups(n, sets, prefix)
    mark = np.zeros(own.codes.max(initial=0) + 1, bool)
    label, parts = np.arange(len(own.order)), {i: [i] for i in range(len(own.order))}
    alike = own.firsts.copy()

    def verify(i: int, left: np.ndarray) -> None:
        left, step = left[label[left] != label[i]], 32
        while len(left):
            some, left = left[-step:], left[:-step]
            step *= 4
            both = _sums(mark, own.codes, own.starts[some], own.lengths[some])
            for j in np.unique(label[some[enough(both, own.sizes[i], own.sizes[some])]]).tolist():
                small, large = sorted((j, int(label[i])), key=lambda x: len(parts[x]))
                label[parts[small]] = large
                parts[large] += parts.pop(small)
            left = left[label[left] != label[i]]

    for g, (start, end) in enumerate(zip(own.cuts.tolist(), own.cuts[1:].tolist())):
        tokens, a, b = own.probes(g)
        first = own.firsts[tokens]
        some = b > a
        last = own.members(np.unique(own.groups[b[some] - 1])[-32:]) if some.any() else b[:0]
        for i in range(start, end):
            codes = own.codes[own.starts[i] : own.starts[i] + own.lengths[i]]
            mark[codes] = True
            verify(i, np.arange(start, i))
            if some.any():
                verify(i, last)
                head = label[own.cuts[own.groups[np.minimum(first, len(own.groups) - 1)]]]
                skip = np.where(head == label[i], np.maximum(a, alike[tokens]), a)
                verify(i, own.members(own.found(g, skip, np.maximum(skip, b))))
            mark[codes] = False
        if (label[start:end] == label[start]).all():
            at = np.searchsorted(own.keys, tokens * len(own.n) + g)
            held = at < len(own.keys)
            held[held] = own.keys[at[held]] == (tokens * len(own.n) + g)[held]
            held &= alike[tokens] == at
            held[held] = label[own.cuts[own.groups[first[held]]]] == label[start]
            alike[tokens[held]] += 1
    out = np.empty(len(own.order), np.int64)
    out[own.order] = label
    return out


def shared_shingles(docs: DataFrame) -> DataFrame:
    """A row per document: rid (unique), doc_id, n, h (hash of the text), alike (hash of the whole
    set, if all of it is shared), tokens (the shared shingles of documents that can have a link, in
    prefix order, else null) and p (how many of them are the prefix).

    Shingles that no other document has cannot be in an intersection, and as the rarest they come
    first in prefix order (by document frequency, then hash); so the prefix that a link must share
    is what is left of the n - ceil(0.8 n) + 1 rarest shingles after them.
    """
    bits = range_bits(docs)

    def fill(batch: pa.RecordBatch, chunk) -> None:
        ids, gone = null_safe(batch.column(0))
        for doc_id, null, h, found in zip(ids.tolist(), gone.tolist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1))):
            chunk.add((doc_id, null, len(found), h), found)

    def prefixes(key: tuple, table: pa.Table) -> pa.Table:
        docs_, tokens, owners, counts = chunk_answer(table, 4, bits)
        order = np.lexsort((tokens, counts, owners))
        tokens, cuts = tokens[order], np.searchsorted(owners[order], np.arange(len(docs_) + 1)).tolist()
        rows = []
        for i, ((doc_id, null, n, h), a, b) in enumerate(zip(docs_.tolist(), cuts, cuts[1:])):
            own, alone = tokens[a:b], n - (b - a)
            p = min(b - a, max(0, n - -(-PERCENT * n // 100) + 1 - alone))
            alike = xxhash.xxh3_128_digest(np.sort(own).tobytes()) if p and not alone else None
            rows.append((key[0].as_py() << 17 | i, None if null else doc_id, n, h, alike, p, own.tobytes() if p else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        columns = list(zip(*rows)) or [()] * 7
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["rid", "doc_id", "n", "h", "alike", "p", "tokens"])

    found = answers(blocks_of(docs.select(long_id(), "text", F.xxhash64("text").alias("h")), fill, bits))
    return found.groupBy("chunk").applyInArrow(prefixes, "rid long, doc_id long, n long, h long, alike binary, p long, tokens binary")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (gid, n, size, prefix) to its entries: token, gid, n, and the shared shingles from the token on."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            tokens = [np.frombuffer(raw, "<i8") for raw in part.column(3).to_pylist()]
            sizes = np.array([len(t) for t in tokens])
            gids, n, size = (np.repeat(part.column(k).to_numpy(zero_copy_only=False), sizes) for k in range(3))
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(gids), pa.array(n), pa.array(size - place)], ["token", "gid", "n", "rest"])


ENTRY = "token long, gid long, n long, rest long"


def _verify(key: tuple, table: pa.Table) -> pa.Table:
    """The links' components within each candidate component of the table: (vid, root)."""
    comps, vids, n, p = (table[c].to_numpy() for c in ("comp", "vid", "n", "p"))
    raw = table["tokens"].to_pylist()
    order = np.argsort(comps, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], comps[order][1:] != comps[order][:-1], [True]))).tolist()
    out_v, out_r = [], []
    for a, b in zip(cuts, cuts[1:]):
        own = order[a:b]
        label = linked(n[own], [np.frombuffer(raw[i], "<u8") for i in own.tolist()], p[own])
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, label, vids[own])
        out_v.append(vids[own])
        out_r.append(least[label])
    return pa.table({"vid": np.concatenate(out_v), "root": np.concatenate(out_r)})


def _proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, sizes and sets of both) that are links."""
    for batch in batches:
        left, right = ([np.frombuffer(raw, "<u8") for raw in batch.column(k).to_pylist()] for k in (3, 5))
        both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
        n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
        yield batch.select([0, 1]).filter(pa.array(enough(both, n, m)))


def _links_by_pairs(sets: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all links between sets of large candidate components.

    sets: vid, n, p, tokens.  In each round every entry of a posting list is held against the list's
    pivot, unless the two are connected already; a cluster of near copies falls together in a round
    or two.  When few pairs of unconnected entries are left, or pivots give no more links, those
    pairs are listed, filtered by size and position and verified each.
    """
    spark = sets.sparkSession
    prefix = F.expr("substring(tokens, 1, cast(8 * p as int))")
    entries = sets.select("vid", "n", (F.octet_length("tokens") / 8).cast("long"), prefix).mapInArrow(_postings, ENTRY)
    entries = stage(spark, entries, "jaccard-entries")
    total, links, labels = entries.count(), None, None

    def verified(pairs: DataFrame) -> DataFrame:
        one = lambda side: sets.select(F.col("vid").alias(side), F.col("n").alias(f"n_{side}"), F.col("tokens").alias(f"t_{side}"))
        both = pairs.distinct().join(one("a"), "a").join(one("b"), "b").select("a", "b", "n_a", "t_a", "n_b", "t_b")
        return stage(spark, both.mapInArrow(_proven, "a long, b long"), "jaccard-links")

    def alike(x: str, y: str) -> str:
        """The filters of a pair of entries: sizes, and what both have left from the shared token on."""
        return f"100 * least({x}n, {y}n) >= {PERCENT} * greatest({x}n, {y}n) and {100 + PERCENT} * least({x}rest, {y}rest) >= {PERCENT} * ({x}n + {y}n)"

    for turn in range(ROUNDS):
        if labels is None:
            named = entries.withColumn("label", F.col("gid"))
        else:
            named = entries.join(labels, F.col("gid") == F.col("node"), "left").select(*entries.columns, F.coalesce("root", "gid").alias("label"))
        named = stage(spark, named, "jaccard-named")
        by_label = named.groupBy("token", "label").agg(F.count(F.lit(1)).cast("double").alias("m"))
        left = by_label.groupBy("token").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
        if left <= FEW_PAIRS * total:
            break
        pivots = named.groupBy("token").agg(F.min_by(F.struct("gid", "n", "rest", "label"), F.xxhash64("gid", F.lit(turn))).alias("p"))
        pivots = stage(spark, pivots.select("token", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("gid", "n", "rest", "label")]), "jaccard-pivots")
        found = verified(named.join(pivots, "token").where(f"label <> p_label and {alike('', 'p_')}").select(F.least("gid", "p_gid").alias("a"), F.greatest("gid", "p_gid").alias("b")))
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links)
    other = named.select("token", *[F.col(c).alias(f"o_{c}") for c in ("gid", "n", "rest", "label")])
    rest = named.join(other, "token").where(f"gid < o_gid and label <> o_label and {alike('', 'o_')}")
    found = verified(rest.select(F.col("gid").alias("a"), F.col("o_gid").alias("b")))
    return found if links is None else links.unionByName(found)


def _rooted(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, h, n_shingles, set_id, and root, which linked documents share."""
    spark = docs.sparkSession
    rows = stage(spark, shared_shingles(docs), "jaccard-sets")
    able = rows.where("tokens is not null")
    # Narrow tables decide what goes where; the sets themselves move once to the task that verifies
    # them.  What is aggregated by a key is written before it is joined to the rows of that key, so
    # that both sides are plain exchanges and Spark splits a hot key.
    narrow = able.select("rid", "n", "alike", F.expr("md5(substring(tokens, 1, cast(8 * p as int)))").alias("key"), (F.octet_length("tokens") / 8).alias("size"))
    same = stage(spark, narrow.where("alike is not null").groupBy("n", "alike").agg(F.min("rid").alias("vid")), "jaccard-same")
    member = narrow.where("alike is not null").select("rid", "n", "alike").join(same, ["n", "alike"]).select("rid", "vid")
    member = stage(spark, member.unionByName(narrow.where("alike is null").select("rid", F.col("rid").alias("vid"))), "jaccard-members")
    keyed = narrow.withColumnRenamed("rid", "vid").join(member.where("rid = vid").select("vid"), "vid", "left_semi").select("vid", "n", "key", "size")
    keyed = stage(spark, keyed, "jaccard-keyed")
    groups = stage(spark, keyed.groupBy("n", "key").agg(F.min("vid").alias("gid")), "jaccard-keys")
    grouped = stage(spark, keyed.join(groups, ["n", "key"]).select("vid", "gid", "size"), "jaccard-groups")
    firsts = able.select(F.col("rid").alias("vid"), "n", F.lit(0).cast("long").alias("size"), F.expr("substring(tokens, 1, cast(8 * p as int))").alias("prefix"))
    firsts = firsts.join(grouped.where("vid = gid").select("vid"), "vid", "left_semi")
    postings = firsts.mapInArrow(_postings, ENTRY).select("token", "gid")
    roots = stage(spark, postings.groupBy("token").agg(F.min("gid").alias("root"), F.max("gid").alias("last")).where("root < last").select("token", "root"), "jaccard-tokens")
    stars = postings.join(roots, "token").where("gid <> root").select(F.col("gid").alias("a"), F.col("root").alias("b")).distinct()
    comps = connected_components(stars)
    placed = grouped.join(comps.withColumnRenamed("node", "gid"), "gid", "left").select("vid", F.coalesce("root", "gid").alias("comp"), "size")
    placed = stage(spark, placed, "jaccard-candidates")
    of = stage(spark, placed.groupBy("comp").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("comp", "held"), "jaccard-held")
    wanted = stage(spark, placed.join(of, "comp").select("vid", "comp", (F.col("held") > BLOCK).alias("large")), "jaccard-wanted")
    sized = able.select(F.col("rid").alias("vid"), "n", "p", "tokens").join(wanted, "vid")
    bins = max(shuffle_width(spark) * 2, -(-int(of.where(F.col("held") <= BLOCK).agg(F.sum("held")).first()[0] or 0) // BLOCK))
    small = sized.where("not large").select(F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("bin"), "comp", "vid", "n", "p", "tokens")
    found = small.groupBy("bin").applyInArrow(_verify, "vid long, root long")
    if not wanted.where("large").isEmpty():
        large = stage(spark, sized.where("large").select("vid", "n", "p", "tokens"), "jaccard-large")
        found = found.unionByName(connected_components(_links_by_pairs(large)).select(F.col("node").alias("vid"), "root"))
    found = stage(spark, found, "jaccard-found")
    member = member.join(found, "vid", "left").select("rid", "vid", F.coalesce("root", "vid").alias("root"))
    named = rows.select("rid", "doc_id", "h", F.col("n").alias("n_shingles")).join(member, "rid", "left")
    return stage(spark, named.select("doc_id", "h", "n_shingles", F.coalesce("vid", "rid").alias("set_id"), F.coalesce("root", "rid").alias("root")), "jaccard-roots")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Components of documents linked by a shingle Jaccard similarity of 0.8 or more.

    Gives doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and set_id (rows
    with equal sets share it).  For all documents:

    1. an inverted index over all shingles leaves each document its shared shingles and prefix;
    2. documents with equal sets become one, and those with equal prefixes and size one group;
    3. groups that share a prefix shingle are candidates: each posting list gives a star of edges to
       its smallest group (as many as it has groups), whose components hold every possible link;
    4. in each candidate component pairs of groups are filtered by size and shared prefix, expanded
       to their members and verified on their sets, without pairs that are connected already;
       components above ``BLOCK`` shingles are verified by distributed pairs instead.

    Shingles are compared by 64 bits of their hash (by 56 and those of the range below 256 ranges).

    Texts and nulls: no text or no words gives an empty set linked with nothing, its component_id is
    its own doc_id.  A repeated row counts as a document of its own with the same doc_id.  A null
    doc_id stays null and takes no part in the choice of component_id.  An empty table gives an
    empty result; other columns are ignored.
    """
    named = _rooted(docs)
    least = stage(docs.sparkSession, named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    return named.join(least, "root").select("doc_id", "n_shingles", "component_id", "set_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of documents linked by whatever path, the row with the smallest doc_id; all columns stay.

    It goes by rows: of several rows with that doc_id one stays (of different texts the one of the
    smaller hash, of equal texts any), a doc_id that also has a text outside the group keeps that,
    and a null doc_id counts as larger than all.  Documents without words are in no group and stay.
    Columns may have any names.
    """
    spark = docs.sparkSession
    named = _rooted(docs).where("n_shingles > 0")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    first = stage(spark, first.select("root", F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h")), "jaccard-firsts")
    joined = named.join(first, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    gone = stage(spark, joined.where(~stays).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct(), "jaccard-gone")
    repeated = joined.where(stays).groupBy(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    repeated = stage(spark, repeated, "jaccard-repeated")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    is_one = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h"))
    kept = rows.join(gone, is_one, "left_anti")
    if not repeated.isEmpty():
        kept = kept.join(repeated, is_one, "left_anti").unionByName(kept.join(repeated, is_one, "left_semi").dropDuplicates(["id", "h"]))
    return kept.select("row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
