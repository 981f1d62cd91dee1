"""Prefix trie, infilling and quality against brute force, exact round trips and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import infill, louds, prefix_trie, quality

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, key string"


def talks(n=60, seed=5):
    """Conversations with shared beginnings, copies, one that many have, gaps, nulls, repeated and tied turns."""
    r = random.Random(seed)
    rows = []
    said = [("user", f"hello {k}") for k in range(3)] + [("assistant", "ä"), (None, "x"), ("user", None), ("", "")]
    for c in range(n):
        if c % 7 == 3:
            continue  # no such conversation
        if c % 3 == 0:
            turns = [("user", "hot"), ("assistant", "turn"), ("user", "again")]
        else:
            turns = [r.choice(said) for _ in range(r.choice([1, 2, 3, 6, 11, 20]))]
        rows += [(c, t if t or c % 2 else None, role, text) for t, (role, text) in enumerate(turns)]
    rows += [(2, 1, "user", "hello 0"), (2, 1, "user", "hello 0"), (2, 1, "assistant", "tie"), (None, 0, "user", "no conversation"), (-3, 0, "user", "minus"), (-7, 5, "user", "minus"), (1 << 62, 0, "user", "far")]
    r.shuffle(rows)
    return rows


def plain_trie(rows):
    """The contract in plain Python; ties of turn by the digest of role and text."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h, head = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        built[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[x] for x in children.get(seq, [])) or 1
        saved[seq] = sum(saved[x] for x in children.get(seq, [])) + ((len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0)
    ends = {}
    for c, seq in built.items():
        ends.setdefault(seq, []).append(c)
    digest = lambda seq: hashlib.sha256(",".join(map(str, sorted(ends.get(seq, [])))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children.get(s, [])), leaves[s], saved[s], digest(s)) for s, m in members.items())


def found_trie(trie, piece=prefix_trie.PIECE):
    named = trie.nodes().join(prefix_trie.list_digests(trie.ends(), piece), "key", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or empty) for r in named.collect())


@pytest.mark.parametrize(("limit", "most", "levels", "piece"), [(1024, 1 << 18, 32, 1 << 20), (3, 1 << 18, 32, 4), (2, 2, 4, 7), (1, 1 << 18, 3, 1)])
def test_trie_equals_brute_force(spark, limit, most, levels, piece):
    rows = talks()
    table = spark.createDataFrame([(*x, 0, "k") for x in rows], CONVERSATIONS).repartition(5)
    assert found_trie(prefix_trie.build(table, limit, most, levels), piece) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    table = spark.createDataFrame([], CONVERSATIONS)
    assert found_trie(prefix_trie.build(table)) == []
    none = [(c, 0, "user", "x") for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    table = spark.createDataFrame([(*x, 0, "k") for x in none], CONVERSATIONS)
    assert found_trie(prefix_trie.build(table)) == plain_trie(none)
    assert plain_trie(none)[0][1] == 0 and len(plain_trie(none)) == 1


def test_shards_find_their_paths(spark):
    rows = talks()
    trie = prefix_trie.build(spark.createDataFrame([(*x, 0, "k") for x in rows], CONVERSATIONS), limit=4)
    light = trie.placed.where("bucket >= 0").select("bucket", "key", "parent", "label").distinct().collect()
    shards = {r.bucket: louds.Louds.unpack(r.louds, r.labels) for r in trie.shards().collect()}
    above = {r.key: (r.parent, r.label) for r in light}
    reached = set()
    for r in light:
        path, at = [], r.key
        while at in above:
            parent, label = above[at]
            path.append(bytes(label if parent in above else at))
            at = parent
        reached.add((r.bucket, shards[r.bucket].find(path[::-1])))
        assert shards[r.bucket].find([b"?" * 16, *path]) is None
    assert reached == {(b, k) for b, t in shards.items() for k in range(1, len(t))}


def test_louds_knows_parents_and_levels():
    r = random.Random(1)
    parents = np.array([-1] + [r.randrange(-1, k) for k in range(1, 300)])
    depths = np.zeros(300, np.int64)
    for k, p in enumerate(parents):
        depths[k] = 1 + (depths[p] if p >= 0 else 0)
    labels = bytes(r.randrange(256) for _ in range(300 * louds.LABEL))
    trie, placed = louds.Louds.build(parents, depths, labels)
    number = {int(p): k + 1 for k, p in enumerate(placed)} | {-1: 0}
    assert trie.parents().tolist() == [number[int(parents[p])] for p in placed]
    assert [depths[placed[a - 1 : b - 1]].tolist() for a, b in trie.levels()] == [[d] * int((depths == d).sum()) for d in range(1, depths.max() + 1)]
    assert louds.Louds.unpack(trie.pack(), trie.labels).bits.tolist() == trie.bits.tolist()


UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "\n\t ", "a", " a", "a ", "one two  three\n", "é\x0bü\x0c𝄞 \x85x y\x1cz", "<P", "P>", "a <S> b", "<<M>>", "<P<S", "x" * 300_000, "w\n" * 50_000, "   " * 1000 + "end"]


def plain_infill(doc_id, text):
    text, shown = text or "", "" if doc_id is None else doc_id
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{shown}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill_equals_brute_force_and_restores(frame, docs_rows):
    rows = [(i, t) for i in (None, -4, 0, 7, 2**63 - 1, *range(100, 140)) for t in TEXTS] + docs_rows + docs_rows[:3]
    found = infill.fill_in_middle(frame(rows)).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found.collect())
    key = lambda x: (x[0], x[1], x[2], x[5])
    expected = [(str(i), *plain_infill(i, t), t or "") for i, t in rows]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(frame([(1, "x")]).where("false")).count() == 0


@pytest.fixture(scope="module")
def graded():
    """Prose, shouted prose and repeated words, with their labels; every seventh label is missing."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randint(5, 300))]
        good = i % 5 != 0
        if not good and i % 2:
            w = [f"{x.upper()}!!" for x in w]
        elif not good:
            w = [x for x in w[: max(1, len(w) // 9)] for _ in range(9)]
        rows.append((i, " ".join(w)))
        if i % 7:
            labels.append((i, int(good), 0))
    return rows, labels, {i: int(i % 5 != 0) for i, _ in rows}


def test_quality_on_held_out_rows(spark, frame, graded):
    rows, labels, truth = graded
    model = quality.fit(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in quality.score(frame(rows), model).collect()}
    held = [r for r in got.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_is_a_sum_of_tables(frame, graded):
    rows, _, truth = graded
    table = np.stack([quality.features(t) for _, t in rows])
    model = quality.learn(table, np.array([truth[i] for i, _ in rows], float), np.ones(len(rows)))
    assert len(model.pairs) == quality.PAIRS and len(model.tables) == len(quality.FEATURES)
    for row, score in zip(table[:50], model.scores(table[:50])):
        total = model.bias + sum(float(t[int((e <= x).sum())]) for e, t, x in zip(model.edges, model.tables, row))
        total += sum(float(t[int((model.coarse[i] <= row[i]).sum()), int((model.coarse[j] <= row[j]).sum())]) for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(2)
    table = r.random((3000, len(quality.FEATURES))).astype(np.float32)
    labels = ((table[:, 0] > 0.5) != (table[:, 1] > 0.5)).astype(float)
    model = quality.learn(table, labels, np.ones(len(table)))
    assert (0, 1) in model.pairs
    fresh = r.random((1000, len(quality.FEATURES))).astype(np.float32)
    right = (model.scores(fresh) > 0.5) == ((fresh[:, 0] > 0.5) != (fresh[:, 1] > 0.5))
    assert right.mean() > 0.9


def test_quality_edges(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(None, "a b"), (1, None), (1, ""), (1, "a b"), (2, "a b"), (3, "word " * 100_000), (4, "\n \t")]
    got = quality.score(frame(rows), quality.fit(frame(rows), none)).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    one = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 2, 3, 4, None)] + [(4, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame(rows), one)
    assert all(r.score > 0.9 for r in quality.score(frame(rows), model).collect())
    assert quality.score(frame(rows).where("false"), model).count() == 0
    assert sum(r.held_out for r in got) == 1 + sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows if i is not None)
    assert quality.features("a b").shape == (len(quality.FEATURES),) and not quality.features(" \n").any()
