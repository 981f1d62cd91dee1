"""Runs of the forest's arrays: that go on in another range, and of near copies."""

from collections import Counter

import numpy as np
import pytest

from larder.llm import neighbours


@pytest.mark.parametrize("every, most", [(300, 1.05), (3, 1.5)])
def test_queries_cross_the_edges_of_ranges_and_entries_do_not(spark, monkeypatch, every, most):
    """op5: every range handed its neighbours up to a budget of entries, whatever was asked across the edge."""
    x = np.random.default_rng(4).standard_normal((1500, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    staged, stage = {}, neighbours.stage

    def kept(session, df, name):
        staged[name] = stage(session, df, name)
        return staged[name]

    monkeypatch.setattr(neighbours, "stage", kept)
    found = []
    for part_rows in (1 << 40, 1):
        monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
        forest, _ = neighbours.forest_of(neighbours.usable(vectors), 8, 5, f"vec_id % {every} = 0", 200)
        forest.found()
        found.append(Counter((r.asker, r.rep) for r in staged["forest-found"].collect()))
    whole, cut = found
    print("rows", whole.total(), cut.total())
    assert {q for q, _ in whole} == set(range(0, 1500, every)) and whole <= cut
    assert cut.total() <= most * whole.total()


@pytest.mark.parametrize("size, noise", [(20, 1e-4), (75, 1e-4), (150, 1e-4), (300, 0.03)])
def test_near_copies_are_not_handed_on_by_every_tree(spark, monkeypatch, size, noise):
    """op5: each tree gave each query of a group all its near copies, as 8 bits do not tell them apart."""
    r = np.random.default_rng(7)
    x = np.concatenate((r.standard_normal(8) + noise * r.standard_normal((size, 8)), r.standard_normal((700 - size, 8))))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    staged, stage = {}, neighbours.stage

    def kept(session, df, name):
        staged[name] = stage(session, df, name)
        return staged[name]

    monkeypatch.setattr(neighbours, "stage", kept)
    got = {}
    for row in neighbours.nearest(vectors, query="vec_id % 5 = 0", budget=200).collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    found = Counter(row.asker for row in staged["forest-found"].collect())
    print("rows of a query at most", max(found.values()), "in the group", max(found[q] for q in range(0, size, 5)))
    assert max(found.values()) <= 2 * 200
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, size, 5):
        scores = unit @ unit[q]
        scores[q] = -2
        assert got[q] == np.argsort(-scores)[:5].tolist()
