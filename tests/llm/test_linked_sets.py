"""The verification of a candidate component of the similarity join, against all pairs and at length."""

import numpy as np
import pytest

from larder.llm.jaccard import PERCENT, linked


def prefixes(n, sets):
    """How many of each set's shared shingles are its prefix."""
    return np.array([len(s) - -(-PERCENT * m // 100) + 1 for m, s in zip(n, sets)])


def named(labels):
    first = {}
    return [first.setdefault(x, i) for i, x in enumerate(labels)]


def all_pairs(n, sets):
    label, own = list(range(len(sets))), [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and 100 * both >= PERCENT * (n[i] + n[j] - both):
                label = [label[i] if x == label[j] else x for x in label]
    return label


@pytest.mark.parametrize("seed", range(60))
def test_equal_to_all_pairs(seed):
    r = np.random.default_rng(seed)
    base = [r.choice(300, r.integers(1, 40), replace=False) for _ in range(5)]
    sets, n = [], []
    for _ in range(r.integers(2, 90)):
        own = base[r.integers(5)]
        own = np.unique(np.concatenate((own[r.random(len(own)) > r.choice([0, 0.05, 0.1, 0.2])], r.choice(300, r.integers(0, 4))))).astype(np.uint64)
        alone = int(r.integers(0, 3))
        if len(own) and prefixes([len(own) + alone], [own])[0] > 0:
            sets.append(own)
            n.append(len(own) + alone)
    if sets:
        assert named(linked(np.array(n), sets, prefixes(n, sets)).tolist()) == named(all_pairs(n, sets))


def test_a_single_set():
    assert linked(np.array([3]), [np.array([1, 2, 3], np.uint64)], np.array([1])).tolist() == [0]


def test_near_copies_and_boilerplate_at_length():
    k = 40_000
    copies = [np.array([100 + i // 2, *range(9)], np.uint64) for i in range(k)]
    assert len(set(linked(np.full(k, 10), copies, np.full(k, 3)).tolist())) == 1
    # a chain: each shares a rare shingle with the next and five frequent ones with all, and none links
    # but the pairs that have nine of ten
    chain = [np.array([10**6 + i, 10**6 + i + 1, 2 * 10**6 + i // 2, 3 * 10**6 + i // 2, 4 * 10**6 + i // 2, 1, 2, 3, 4, 5], np.uint64) for i in range(k)]
    assert named(linked(np.full(k, 10), chain, np.full(k, 3)).tolist()) == [i - i % 2 for i in range(k)]
