"""Hot groups, clashing names, extreme ids and the queries themselves, against brute force."""

import hashlib
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import components, kept_words, shingles, words
from tokenizers import Tokenizer

from larder.llm import automaton, common, inverted, jaccard, language, queries, sharding, substring_dedup, tokens, toxicity
from larder.llm.fm_index import FmIndex

SF = "/root/testdata/sf0.001"
WORDS = tokens.vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def tiny(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_matching_statistics_of_streams():
    r = np.random.default_rng(2)
    texts = [r.integers(1, 5, r.integers(1, 40)) for _ in range(60)]
    text = np.concatenate([np.append(t, 0) for t in texts]).astype(np.int64)
    index = FmIndex(text, 6, np.arange(len(text)))
    raw = ["".join(map(str, t)) for t in texts]
    asked = [r.integers(1, 5, 30) for _ in range(20)]
    stream = np.concatenate(asked).astype(np.int64)
    ends = np.cumsum([len(a) for a in asked])
    got = {}
    for which, at, matched, lo in index.stream(stream, ends, np.array([len(a) for a in asked])):
        for w, p, m, i in zip(which.tolist(), at.tolist(), matched.tolist(), lo.tolist()):
            got[w, p] = m, i
    joined = "0".join(raw) + "0"
    for w, a in enumerate(asked):
        s = "".join(map(str, a))
        for k in range(len(a)):
            longest = max(m for m in range(7) if s[k : k + m] in joined and k + m <= len(s))
            m, i = got[w, ends[w] - len(a) + k]
            assert m == longest
            if m == 6:
                assert index.least_of(np.array([i]))[0] == joined.index(s[k : k + 6])


def test_chunks_have_groups_of_their_own(spark, frame, docs_rows):
    docs = frame(docs_rows, 60).select("doc_id", "text")

    def fill(batch, chunk):
        for i, found in enumerate(jaccard.shingle_sets(batch.column(1))):
            chunk.add((i, 0, len(found), 0), found)

    blocks = inverted.blocks_of(docs, fill, 3).collect()
    own = [r.range for r in blocks if r.range < 0]
    assert len(own) == len(set(own)) > 20
    assert {r.range for r in blocks if r.range >= 0} <= set(range(8))


def test_a_window_of_all_documents_is_one_entry_a_chunk():
    chunk = inverted._Chunk(5)
    for i in range(1000):
        chunk.add((i, 0), np.array([1 << 59, 1 << 60, (i + 1) << 30], np.uint64))
    rows = chunk.blocks(0, 7).to_pylist()
    block = next(r for r in rows if r["range"] == 0)
    assert block["n"] == 1002 and np.frombuffer(block["counts"], "<u2").max() == 1000


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2000])
def test_jaccard_chain_of_boilerplate(spark, block, monkeypatch):
    """Texts that slide along one word list share much with all their neighbours, and link in one chain."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    vocabulary = [f"v{k}" for k in range(1200)]
    rows = [(i, " ".join(vocabulary[i * 3 : i * 3 + 60])) for i in range(380)]
    rows += [(1000 + i, " ".join(vocabulary[i * 40 : i * 40 + 60])) for i in range(28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == components(rows)


def test_jaccard_near_copies_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3000)
    r = np.random.default_rng(3)
    base = [[f"b{g}x{k}" for k in range(60)] for g in range(3)]
    rows = []
    for i in range(600):
        w = list(base[i % 3])
        for k in r.integers(0, 60, r.integers(0, 4)):
            w[k] = f"e{r.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == components(rows)


def test_one_of_each_goes_by_rows(spark):
    a, b, other = "a b c d e f g", "A b c d e f g", "p q r s t u v w"
    rows = [(5, a, 1), (5, a, 2), (5, other, 3), (7, b, 4), (None, a, 5), (9, other, 6), (None, None, 7), (8, "", 8), (8, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int").selectExpr("*", "'x' as root", "1 as h", "2 as row", "3 as id")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r._gone for r in got if r._gone > 2) == [3, 7, 8, 9]
    assert len([r for r in got if r._gone <= 2]) == 1
    assert jaccard.one_of_each(docs.where("false")).count() == 0


def test_cleaned_with_clashing_names_and_extreme_ids(spark):
    copy, top = " ".join(f"v{k}" for k in range(30)), 2**63 - 1
    rows = [(-(2**63), copy), (top, copy), (None, copy), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _key", "2 as _h", "3 as _found", "4 as found", "5 as h", "6 as row", "7 as n_chars")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in substring_dedup.cleaned(docs).where("text is not null").collect())
    assert got == [(False, -(2**63), copy), (False, top, ""), (True, 0, "")]
    assert substring_dedup.cleaned(docs).columns == docs.columns
    assert sorted(r.doc_id or 0 for r in substring_dedup.dedup(docs).collect()) == [-(2**63), 0, 0, top]


def test_sharding_writer_keeps_the_limit(frame, tmp_path):
    rows = [(1, "x" * 100)] * 30 + [(2, "y" * 400), (3, "z" * 5000), (None, "n" * 300), (None, "n" * 300), (4, None)]
    docs = frame(rows, 1)
    back = sharding.write(docs, str(tmp_path / "shards"), 1000)
    held = {}
    for r in back.collect():
        held.setdefault(r.shard, []).append(len(r.text or ""))
    assert sum(map(len, held.values())) == len(rows)
    assert all(sum(v) <= 1000 or len(v) == 1 for v in held.values())
    assert len([f for f in os.listdir(tmp_path / "shards") if f.startswith("shard=b")]) == len(held)
    assert sharding.write(docs.where("false"), str(tmp_path / "none"), 1000).count() == 0


def test_automaton_table_starts_anew():
    tool, table = Tokenizer.from_file(WORDS), automaton.Automaton(WORDS, rows_kept=50)
    for word in ("mississippi", "aaaaaaab", "straße", "日本", "internationalisation", "x"):
        assert table.encode(word) == tool.encode(word, add_special_tokens=False).ids
        assert len(table.ended) <= 50 + 2 * len(word.encode())


def dense_ftrl(rows, epochs=toxicity.EPOCHS):
    """FTRL-proximal spelled out coordinate by coordinate; rows: (label, set of features)."""
    z, n, order = {}, {}, np.random.default_rng(7)

    def weight(f):
        l1 = 0.0 if f == "bias" else toxicity.L1
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return -(z[f] - np.sign(z[f]) * l1) / ((toxicity.BETA + np.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            label, features = rows[i]
            w = {f: weight(f) for f in [*features, "bias"]}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()), -35, 35))) - label
            for f in w:
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (np.sqrt(before + g * g) - np.sqrt(before)) / toxicity.ALPHA * w[f]
                n[f] = before + g * g
    return {f: weight(f) for f in z}


def test_toxicity_against_a_dense_learner():
    r = np.random.default_rng(1)
    plain = [f"w{k}" for k in range(40)]
    texts = []
    for i in range(300):
        w = [plain[k] for k in r.integers(0, 40, 12)]
        if i % 4 == 0:
            w += ["vile", "nasty"]
        texts.append((" ".join(w), int(i % 4 == 0)))
    sets = [np.unique(toxicity.features(t)).astype(np.uint32) for t, _ in texts]
    model = toxicity.learn([y for _, y in texts], np.concatenate(sets), [len(s) for s in sets])
    counts = {}
    for s in sets:
        for f in s.tolist():
            counts[f] = counts.get(f, 0) + 1
    expected = dense_ftrl([(y, [f for f in s.tolist() if counts[f] > 1]) for (_, y), s in zip(texts, sets)])
    bias = expected.pop("bias")
    got = dict(zip(model.at.tolist(), model.values.tolist()))
    assert set(got) == {f for f, w in expected.items() if w}
    assert np.allclose([got[f] for f in got], [expected[f] for f in got], atol=1e-5) and abs(model.bias - bias) < 1e-9
    for t, s in zip(texts, sets):
        score = 1 / (1 + np.exp(-(bias + sum(expected.get(f, 0.0) for f in s.tolist()))))
        assert abs(model.score(t[0]) - score) < 1e-5


def test_language_against_a_dense_kernel():
    """With every text a landmark, Nyström's space is the kernel's own: plain kernel ridge gives the same scores."""
    kinds = {"aa": "abc abd acb bad cab dab", "bb": "xyz xzy yxz zyx yzx zxy", "cc": "lmn mno nol oln mln nlo"}
    r = np.random.default_rng(5)
    data = [(lang, " ".join(r.choice(w.split(" "), 8))) for lang, w in kinds.items() for _ in range(8)]
    model = language.learn([(lang, language.present(t).tobytes()) for lang, t in data], landmarks=len(data))
    sets = [set(language.present(t).tolist()) for _, t in data]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    signs = np.array([[1.0 if lang == one else -1.0 for one in sorted(kinds)] for lang, _ in data])
    alpha = np.linalg.solve(k + language.RIDGE * len(data) * np.eye(len(data)), signs)
    new = [t for _, t in data[::3]] + ["abc xyz lmn", "dab dab"]
    expected = np.array([[kernel(set(language.present(t).tolist()), s) for s in sets] for t in new]) @ alpha
    assert np.allclose(model.scores(new), expected, atol=1e-3)


def test_every_language_is_in_the_sample(spark):
    rows = [(i, f"wort nummer {i}", "de") for i in range(3000)] + [(9001, "llawer o eiriau", "cy"), (9002, "mwy o eiriau", "cy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.fit(docs, rows=100).languages == ["cy", "de"]


def test_training_features_are_bounded(spark, frame):
    rows = [(i, " ".join(f"w{(i * k) % 997}" for k in range(200))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    assert toxicity.fit(frame(rows), labels, most=10_000).bias != 0


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Cluster:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://there", "getConf": staticmethod(lambda: Conf)})

    with pytest.raises(ValueError):
        common.shared_dir(Cluster)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_and_op3_queries(spark, tiny):
    rows = sorted(tiny.items())
    kept = kept_words(rows)
    for r in queries.QUERIES["op1_substring_dedup"](spark, SF).collect():
        n, own = kept[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, n - len(own)) and r.kept_sha256 == hashlib.sha256(" ".join(own).encode()).hexdigest()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op3_jaccard_join"](spark, SF).collect()} == components(rows)


def test_op2_op4_and_op8_queries(spark, tiny):
    by, wo = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json")), Tokenizer.from_file(WORDS)
    pieces, start = {}, 0
    for r in queries.QUERIES["op2_packing"](spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    four = {r.doc_id: r for r in queries.QUERIES["op4_token_files"](spark, SF).collect()}
    eight = {r.doc_id: r for r in queries.QUERIES["op8_bpe_automaton"](spark, SF).collect()}
    for doc_id, text in sorted(tiny.items()):
        ids = by.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids) == r.doc_tokens
        ids = wo.encode(text or "", add_special_tokens=False).ids
        r = four[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, crc([*ids, 2]))
        start += len(ids) + 1
        r = eight[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(wo.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5_query(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in queries.QUERIES["op5_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        scores = unit @ unit[np.searchsorted(ids, q)]
        others = ids != q
        best = set(ids[others][np.argsort(-scores[others], kind="stable")[:5]].tolist())
        hits += len(best & {v for _, v, _ in found})
        assert all(abs(s - scores[np.searchsorted(ids, v)]) < 1e-12 for _, v, s in found)
    assert hits >= 0.9 * 5 * len(got)


def test_op6_query(spark, tiny):
    errors, order = [], sorted(tiny)
    for r in queries.QUERIES["op6_fingerprints"](spark, SF).collect():
        text, after = tiny[r.doc_id] or "", tiny[order[order.index(r.doc_id) - 1]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text, lower=False), shingles(other, lower=False)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.abs(errors)) < 0.06


def test_op7_op9_and_op10_queries(spark, tiny):
    for name, column in (("op7_toxicity", "score"), ("op9_language_id", "score")):
        got = queries.QUERIES[name](spark, SF).collect()
        assert {r.doc_id for r in got} == set(tiny) and all(0 <= r[column] <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    sizes = {r.doc_id: r.n_bytes for r in queries.QUERIES["op10_sharding"](spark, SF).collect()}
    assert sizes == {i: len((t or "").encode()) for i, t in tiny.items()}


def test_long_texts(spark):
    """One very long text, its near copy and ties all over beside short ones."""
    long = " ".join(f"w{k % 5003}" for k in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "short text"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs, with_text=False).collect()}
    assert got == {1: 0, 2: 300_000, 3: 0, 4: 0, 5: 0}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    model = toxicity.learn([0, 1], np.zeros(0, np.uint32), [0, 0])
    assert toxicity.score(docs, model).count() == len(rows)
    assert automaton.encode_decode(docs.where("doc_id > 1"), WORDS, with_texts=False).where("n_tokens > 300000").count() == 1
    assert automaton.encode_decode(docs.where("false"), WORDS).count() == 0
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_words_are_those_of_the_contract():
    texts = ["a\x0bb c\x1cd\x85e", None, " ", "\tx\r\ny "]
    codes, bounds, found = tokens.words_of(pa.array(texts))
    for k, t in enumerate(texts):
        assert [found[c] for c in codes[bounds[k] : bounds[k + 1]]] == words(t)
    assert json.dumps(found)
