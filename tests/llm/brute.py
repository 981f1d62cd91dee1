"""Plain formulations that the operators are held against, on driver-sized data."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, n: int = 5, lower: bool = True) -> frozenset:
    w = words((text or "").translate(LOWER) if lower else text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


def kept_words(docs: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple[int, list[str]]]:
    seen: set = set()
    out = {}
    for i, t in sorted(docs):
        w = words(t)
        gone, own = [False] * len(w), []
        for k in range(len(w) - window + 1):
            own.append(tuple(w[k : k + window]))
            if own[-1] in seen:
                gone[k : k + window] = [True] * window
        seen.update(own)
        out[i] = (len(w), [x for x, g in zip(w, gone) if not g])
    return out
