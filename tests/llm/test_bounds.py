"""Bounds of samples and models, and what the shard writer refuses."""

import pytest

from larder.llm import language, sharding


def talk(spark, n=240):
    """Documents of six languages, the first of which has the most."""
    rows = [(i, " ".join(chr(97 + (i % 6) * 4 + k % 4) * 3 for k in range(20 + i % 7)), f"l{i % 6}", 0) for i in range(n)]
    return spark.createDataFrame(rows + [(1000 + i, "aaa bbb ccc ddd", "l0", 0) for i in range(30)], "doc_id long, text string, lang string, raw int")


def test_the_most_frequent_languages_are_learnt(spark):
    docs = talk(spark)
    assert language.fit(docs).languages == [f"l{k}" for k in range(6)]
    few = language.fit(docs, languages=2)
    assert "l0" in few.languages and len(few.languages) == 2
    assert {r.lang_pred for r in language.predict(docs, few).collect()} <= set(few.languages)


def test_a_thinned_sample_still_learns(spark):
    docs = talk(spark)
    whole = language.fit(docs)
    total = sum(len(language.present(r.text)) for r in docs.collect())
    thin = language.fit(docs, most=total // 2)
    assert thin.table.shape[0] == whole.table.shape[0] and 1 <= len(thin.languages) <= 6
    right = [r.lang_pred == f"l{r.doc_id % 6}" for r in language.predict(docs.where("doc_id < 1000"), thin).collect()]
    assert sum(right) >= 0.9 * len(right)


def test_a_column_named_shard_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, Shard string")
    with pytest.raises(ValueError, match="shard"):
        sharding.write(docs, str(tmp_path / "s"))


def test_copies_of_an_id_are_dealt_alike_in_every_run(spark, tmp_path):
    docs = spark.createDataFrame([(7, "x" * (50 + k)) for k in range(60)] + [(k, "y" * 30) for k in range(20, 40)], "doc_id long, text string").coalesce(3)
    runs = [sharding.write(docs, str(tmp_path / f"s{k}"), 500) for k in range(2)]
    got = [sorted((r.doc_id, r.text, r.shard) for r in run.collect()) for run in runs]
    assert got[0] == got[1] and len(got[0]) == 80
    held = {}
    for _, text, shard in got[0]:
        held.setdefault(shard, []).append(len(text))
    assert all(sum(v) <= 500 or len(v) == 1 for v in held.values()) and len(held) > 5
