"""Dedup, join, packing, token files, codec and sharding against plain formulations."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from brute import components, kept_words
from tokenizers import Tokenizer

from larder.llm import automaton, jaccard, packing, sharding, substring_dedup, token_files, tokens
from larder.llm.common import shared_path

WORDS, BYTES = tokens.vocabulary_path("word_bpe_49k.json"), tokens.vocabulary_path("byte_bpe_50k.json")
ODD = ["", None, " lead", "trail\n", "a\n\nb", "a  b\t c", "don't we'll", "İstanbul ΣΑΣ", "<|endoftext|> x<|startoftext|>", "é É", "日本語 123 ²", "x\x1cy\x85z\xa0", "“quoted” – €5"]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("hot", [substring_dedup.HOT_KEY, 1])
def test_substring_dedup(frame, docs_rows, hot):
    expected = kept_words(docs_rows)
    got = substring_dedup.dedup(frame(docs_rows), hot_key=hot).collect()
    assert len(got) == len(docs_rows)
    for r in got:
        n, kept = expected[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, n - len(kept), " ".join(kept))
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_substring_dedup_edges(frame, spark):
    copy = " ".join(f"v{k}" for k in range(30))
    rows = [(1, copy), (1, copy), (2, copy), (None, copy), (None, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup(frame(rows)).collect())
    assert got == [(False, 1, 30, 0), (False, 1, 30, 0), (False, 2, 30, 30), (True, 0, 0, 0), (True, 0, 30, 30)]
    assert substring_dedup.dedup(frame([(1, "x")]).where("false")).count() == 0
    long = " ".join(["tick"] * 40_000)
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(frame([(1, long), (2, long)])).collect()} == {1: 0, 2: 40_000}


def test_cleaned_keeps_columns(frame, docs_rows):
    docs = frame(docs_rows)
    got = substring_dedup.cleaned(docs)
    assert got.columns == docs.columns
    expected = kept_words(docs_rows)
    before = dict(docs_rows)
    for r in got.collect():
        n, kept = expected[r.doc_id]
        assert r.text == (before[r.doc_id] if len(kept) == n else " ".join(kept))
        assert r.n_chars == len(r.text or "")


@pytest.mark.parametrize("block", [jaccard.BLOCK, 500])
def test_jaccard_components(frame, docs_rows, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    expected = components(docs_rows)
    got = jaccard.jaccard_components(frame(docs_rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert len({v[1] for v in expected.values()}) < len(expected) - 10


def test_jaccard_edges(frame):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f"), (9, None), (8, "")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_components(frame(rows)).collect())
    assert got == [(0, 2, 3), (3, 2, 3), (5, 2, 3), (5, 2, 3), (8, 0, 8), (9, 0, 9)]
    assert jaccard.jaccard_components(frame(rows).where("false")).count() == 0
    kept = jaccard.one_of_each(frame(rows))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [3, 8, 9]


def test_packing(frame, docs_rows):
    rows = docs_rows + [(5000 + k, t) for k, t in enumerate(ODD)] + [(6000, "long word " * 9000)]
    got = packing.pack(frame(rows), BYTES).collect()
    tool, by_doc = Tokenizer.from_file(BYTES), {}
    assert len({r.sequence_id for r in got}) == len(got)
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        ids, at = tool.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length]) and r.doc_tokens == len(ids)
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    assert packing.pack(frame([(1, "x")]).where("false"), BYTES).count() == 0


def test_token_files(frame, docs_rows, spark):
    rows = sorted(docs_rows + [(5000 + k, t) for k, t in enumerate(ODD)])
    docs, root = frame(rows), shared_path(spark, "test-shards")
    manifest = token_files.write_shards(docs, root, WORDS, shards=3)
    keys = docs.groupBy("doc_id").count().withColumnRenamed("count", "how_many")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(keys, manifest, root).collect()}
    tool, start, expected = Tokenizer.from_file(WORDS), 0, {}
    for doc_id, text in rows:
        ids = tool.encode(text or "", add_special_tokens=False).ids + [2]
        expected[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    assert got == expected
    absent = spark.createDataFrame([(99_999, 1), (-5, 1)], "doc_id long, how_many long")
    assert token_files.read_documents(absent, manifest, root).count() == 0


def test_token_files_edges(frame, spark):
    rows, root = [(7, "b"), (7, "a"), (None, "c"), (7, "a")], shared_path(spark, "test-shards")
    docs = frame(rows)
    manifest = token_files.write_shards(docs, root, WORDS, shards=2)
    keys = docs.groupBy("doc_id").count().withColumnRenamed("count", "how_many")
    got = token_files.read_documents(keys, manifest, root).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (7, 2, 2), (7, 4, 2), (7, 6, 2)]
    empty = token_files.write_shards(docs.where("false"), root, WORDS, shards=2)
    assert token_files.read_documents(keys.where("false"), empty, root).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    found = token_files.PerfectHash.build(keys)(keys)
    assert sorted(found.tolist()) == list(range(len(keys)))


def test_automaton(frame, docs_rows):
    rows = docs_rows + [(5000 + k, t) for k, t in enumerate(ODD)] + [(6000, "aaaaaaaaab mississippi " * 500)]
    tool = Tokenizer.from_file(WORDS)
    got = automaton.encode_decode(frame(rows), WORDS).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        ids = tool.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = tool.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), decoded)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("limit", [500, 5000, 10**9])
def test_sharding(frame, docs_rows, limit):
    got = sharding.assign(frame(docs_rows), limit).collect()
    held, bits = {}, {}
    for r in got:
        held.setdefault(r.shard, []).append(r.n_bytes)
    assert len(got) == len(docs_rows)
    assert all(sum(v) <= limit or len(v) == 1 for v in held.values())
    for r in got:
        digest = format(int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16), "060b")
        assert digest.startswith(r.shard.split("+")[0]) and len(r.shard.split("+")[0]) == r.local_depth
        bits.setdefault(r.shard.split("+")[0], 0)
    for bucket in bits:  # each bucket had to split off: its parent was too large
        if bucket:
            parent = sum(r.n_bytes for r in got if r.shard.split("+")[0].startswith(bucket[:-1]))
            assert parent > limit


def test_sharding_edges(frame):
    rows = [(1, "x" * 100)] * 30 + [(None, "y" * 10), (2, None), (3, "z" * 5000)]
    got = sharding.assign(frame(rows), 1000).collect()
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r.n_bytes)
    assert len(got) == len(rows)
    assert all(sum(v) <= 1000 or len(v) == 1 for v in held.values())
    assert sharding.assign(frame(rows).where("false"), 1000).count() == 0
