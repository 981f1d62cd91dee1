"""A compressed FM-index over word codes: wavelet tree, backward search, matching statistics of streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64


class WaveletTree:
    """Rank queries on a sequence of codes, a packed bit vector a level with counts by 64 bits."""

    def __init__(self, codes: np.ndarray, levels: int):
        self.levels = levels
        self.words, self.before, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (codes >> level) & 1 == 1
            padded = np.zeros(len(bit) // 64 * 64 + 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(_U)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(len(bit) - int(ones.sum()))
            codes = np.concatenate((codes[~bit], codes[bit]))  # stable: zeros first

    def rank(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each pair, how often the code stands before the place, plus where its run begins."""
        for level in range(self.levels):
            bit = (codes >> (self.levels - 1 - level)) & 1 == 1
            word = at >> 6
            low = self.words[level][word] & ((_U(1) << (at & 63).astype(_U)) - _U(1))
            ones = self.before[level][word] + np.bitwise_count(low)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at


class FmIndex:
    """Index of texts (arrays of word codes from 1 on, each ended by a 0) for matches of up to ``context`` words.

    What stays is the wavelet tree of the words before each suffix, how many words (``context`` at
    most) neighbouring suffixes share, and for each run of suffixes that share ``context`` words the
    least of their ``values``; the suffix order itself is needed only while this is built.
    """

    def __init__(self, text: np.ndarray, context: int, values: np.ndarray):
        self.n, self.context = len(text), context
        order, span = text.astype(np.int64), 1
        ranks = [(span, order)]
        while span < context:
            far = np.zeros(self.n, np.int64)
            far[: self.n - span] = order[span:] + 1
            _, order = np.unique(order * (self.n + 2) + far, return_inverse=True)
            span *= 2
            ranks.append((span, order))
        suffixes = np.argsort(order, kind="stable")
        shared = np.zeros(self.n - 1, np.int64)
        for span, rank in reversed(ranks):
            a, b = suffixes[:-1] + shared, suffixes[1:] + shared
            inside = np.maximum(a, b) < self.n
            a[~inside], b[~inside] = 0, 0
            shared += span * (inside & (rank[a] == rank[b]))
        self.shared = np.minimum(shared, context).astype(np.uint8)
        self._starts: dict[int, np.ndarray] = {}
        self.least = np.minimum.reduceat(values[suffixes], self.starts(context))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))))
        bwt = text[suffixes - 1]  # the text before the first one is the last, whose end is 0
        self.tree = WaveletTree(bwt, max(1, int(text.max(initial=0)).bit_length()))
        codes = np.arange(len(self.first) - 1)
        self.run = self.tree.rank(codes, np.zeros(len(codes), np.int64))

    def starts(self, words: int) -> np.ndarray:
        """Where runs of suffixes that share their first ``words`` words begin."""
        if words not in self._starts:
            self._starts[words] = np.concatenate(([0], np.flatnonzero(self.shared < words) + 1))
        return self._starts[words]

    def widened(self, lo: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval around each place of suffixes that share their first ``words`` words."""
        starts = self.starts(words)
        at = np.searchsorted(starts, lo, side="right")
        return starts[at - 1], np.append(starts, self.n)[at]

    def extended(self, lo: np.ndarray, hi: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals after a word is put before each match."""
        found = self.tree.rank(np.concatenate((code, code)), np.concatenate((lo, hi)))
        base = self.first[code] - self.run[code]
        return base + found[: len(code)], base + found[len(code) :]

    def stream(self, text: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of stretches of ``text``, all read from their last word backwards.

        At each step a match drops its last words while the word before cannot be put in front, and
        then takes it.  Gives for each step the stretches that have one: their numbers, places, how
        many words from there on occur in the index (``context`` at most), and where their interval
        begins.  The words' codes are those of the index.
        """
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = ends[order], sizes[order]
        lo, hi, matched = np.zeros(len(order), np.int64), np.full(len(order), self.n), np.zeros(len(order), np.int64)
        for step in range(int(sizes.max(initial=0))):
            m = int(np.searchsorted(-sizes, -step, side="left"))  # the stretches of more than ``step`` words
            at = ends[:m] - 1 - step
            code = text[at]
            full = np.flatnonzero(matched[:m] == self.context)
            lo[full], hi[full] = self.widened(lo[full], self.context - 1)
            matched[full] -= 1
            todo = np.arange(m)
            while len(todo):
                a, b = self.extended(lo[todo], hi[todo], code[todo])
                good = b > a
                done = todo[good]
                lo[done], hi[done] = a[good], b[good]
                matched[done] += 1
                todo = todo[~good]
                todo = todo[matched[todo] > 0]
                for words in np.unique(matched[todo]).tolist():
                    some = todo[matched[todo] == words]
                    lo[some], hi[some] = self.widened(lo[some], words - 1)
                matched[todo] -= 1
            yield order[:m], at, matched[:m].copy(), lo[:m].copy()

    def least_of(self, lo: np.ndarray) -> np.ndarray:
        """The least value of each whole match, by where its interval begins."""
        return self.least[np.searchsorted(self.starts(self.context), lo, side="right") - 1]
