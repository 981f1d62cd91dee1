"""Fingerprints, neighbours, classifiers and the pipeline: accuracy against brute force or held-out rows."""

import hashlib
import random

import numpy as np
from brute import components, kept_words, shingles

from larder.llm import fingerprints, language, neighbours, toxicity


def jaccard_of(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(frame, docs_rows):
    rows = sorted(docs_rows)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(frame(rows)).collect()}
    assert len(got) == len(rows)
    errors, by_text = [], {}
    for at, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[at - 1][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard_of(shingles(text, lower=False), shingles(edited, lower=False)), r.near_next - jaccard_of(shingles(text, lower=False), shingles(after, lower=False))]
        by_text.setdefault(text, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.abs(errors)) < 0.06


def test_fingerprint_edges(frame):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (None, "q r s t u v"), (3, "emoji 😀 " * 10)]
    got = fingerprints.fingerprint_edits(frame(rows)).collect()
    assert len(got) == len(rows)
    assert [r.near_next for r in got if r.doc_id is None] == [None]
    assert fingerprints.fingerprint_edits(frame(rows).where("false")).count() == 0


def brute_nearest(vectors, k=5):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[np.searchsorted(ids, q)]
        keep = ids != q
        order = np.lexsort((ids[keep], -np.round(s[keep], 12)))[:k]
        out[q] = [(int(ids[keep][o]), s[keep][o]) for o in order]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r.standard_normal(16)]) for i in range(1200)]
    rows += [(2000 + i, rows[50][1]) for i in range(60)]  # one vector many times
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "'x' as string")
    bad = spark.createDataFrame([(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [1.0])], "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "'x' as string")
    got = {}
    for row in neighbours.nearest(df.unionByName(bad)).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    expected = brute_nearest({i: np.float32(v).astype(float) for i, v in rows})
    assert set(got) == set(expected)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits / sum(map(len, expected.values())) >= 0.9
    assert [v for _, v, _ in sorted(got[50])] == [2000, 2001, 2002, 2003, 2004]
    for q, found in got.items():
        assert [k for k, _, _ in sorted(found)] == [1, 2, 3, 4, 5]


def test_neighbours_edges(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(few).collect()] == [(0, 1, 1, 0.0)]
    assert neighbours.nearest(few.where("false")).count() == 0


def test_neighbours_in_dense_clusters(spark):
    """Close but not equal vectors: a cluster larger than the forest's budget, and a small tight one."""
    r = np.random.default_rng(6)
    groups = [(0, r.standard_normal((1000, 16))), (10_000, r.standard_normal(16) + 0.02 * r.standard_normal((3000, 16))), (20_000, r.standard_normal(16) + 0.001 * r.standard_normal((200, 16)))]
    rows = [(first + i, [float(x) for x in v]) for first, group in groups for i, v in enumerate(group)]
    got = {}
    for row in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    expected = brute_nearest(dict(rows))
    assert set(got) == set(expected)
    for first, share in ((0, 0.9), (10_000, 1), (20_000, 1)):
        hits = [len({v for _, v in got[q]} & {v for v, _ in expected[q]}) / 5 for q in expected if first <= q < first + 10_000]
        assert np.mean(hits) >= share


def labelled(n=1500):
    r, rows = random.Random(2), []
    plain = ["".join(r.choices("abcdefgh", k=5)) for _ in range(300)]
    for i in range(n):
        w = r.choices(plain, k=r.randint(20, 120))
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["rotten!", "Vile", "nasty"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity(spark, frame):
    rows = labelled()
    docs = frame([(i, t) for i, t, _ in rows] + [(9000, None), (None, "vile")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200
    assert sum(y == p for y, p in held) / len(held) > 0.97


def test_toxicity_without_labels(spark, frame):
    docs = frame([(1, "x"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert toxicity.reject(docs, toxicity.fit(docs, none)).count() == 2


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_language_edges(frame, docs_rows):
    docs = frame(docs_rows + [(7000, "123 !!"), (None, "wort")])
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[7000].lang_pred == "und"
    assert got[10 + 6 * 7].lang_pred == "de" and 0 <= got[10 + 6 * 7].score <= 1
    nothing = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = str(tmp_path / name.replace(" ", "-"))
        apply(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {i for i, _ in before}
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "n-gram Jaccard join":
            assert set(after) == {i for i, (_, root) in components(before).items() if i == root}
        elif name == "substring dedup":
            assert {i: (t or "").split() for i, t in after.items()} == {i: kept for i, (_, kept) in kept_words(before).items()}
        else:
            assert set(after) <= {i for i, _ in before} and len(after) > 0.8 * len(before)
