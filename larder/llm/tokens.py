"""Exact, cached tokenization with the ``tokenizers`` library.

Both encoders give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.  A batch of
texts is cut by Arrow where the tokenizer's own pre-tokenizer cuts, each distinct piece of the batch
is looked up once and goes through the library if it is new to the worker, and the ids of the batch
are gathered by array operations.  Texts outside the alphabet of those cuts go through the library
whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Pieces that a worker's cache holds, about.
CACHED = 600_000
#: Pieces of one call of the library, whose results take some hundred bytes a token.
AT_ONCE = 2000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of lists of strings: a code for each string, the lists' bounds, and the strings by code."""
    coded = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.indices.to_numpy(zero_copy_only=False), bounds - bounds[0], coded.dictionary.to_pylist()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space: codes, bounds by text, words by code; no words in blank texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    codes, bounds, words = pieces_of(lists)
    if "" in words:  # what a blank text is split into
        keep = codes != words.index("")
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        codes = codes[keep]
    return codes, bounds, words


def gathered(codes: np.ndarray, ids_by_code: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a sequence of codes, and the place before each code's ids (and after the last)."""
    flat = np.frombuffer(b"".join(ids_by_code), "<u4")
    sizes = np.fromiter(map(len, ids_by_code), np.int64, len(ids_by_code)) // 4
    starts = np.cumsum(sizes) - sizes
    places = np.concatenate(([0], np.cumsum(sizes[codes])))
    shift = starts[codes] - places[:-1]
    return flat[np.arange(places[-1]) + np.repeat(shift, sizes[codes])], places


class _Cached:
    """A bounded cache from pre-split pieces to their ids as little-endian unsigned 32-bit integers.

    It has two generations: when the young one is full it becomes the old one, and what is found in
    the old one joins the young one again, so that frequent pieces stay.
    """

    #: Texts that are cut by Arrow hold only these characters: Latin letters, digits and marks,
    #: general punctuation, currency signs.  They are their own normal forms, apart from case.
    OTHER = r"[^\n\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20b5}]|<\|"
    #: Pieces whose ids are given from the start.
    GIVEN: dict[str, bytes] = {"": b""}

    def __init__(self, path: str, limit: int):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.limit = limit
        self.given = dict(self.GIVEN)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, from the cache or learnt now."""
        found = list(map(self.young.get, pieces))
        if None in found:
            if len(self.young) > self.limit // 2:
                self.old, self.young = self.young, {}
            missing = [p for p, ids in zip(pieces, found) if ids is None]
            got = [self.given.get(p) if ids is None else ids for p, ids in zip(missing, map(self.old.get, missing))]
            learnt = iter(self.learnt([p for p, ids in zip(missing, got) if ids is None]))
            got = [next(learnt) if ids is None else ids for ids in got]
            self.young.update(zip(missing, got))
            rest = iter(got)
            found = [next(rest) if ids is None else ids for ids in found]
        return found

    def learnt(self, pieces: list[str]) -> list[bytes]:
        """The ids of new pieces: a call of the library for many at once, cut where each piece ends."""
        out: list[bytes] = []
        for at in range(0, len(pieces), AT_ONCE):
            some = pieces[at : at + AT_ONCE]
            ids, starts, ends = self.at_once(some)
            if len(starts) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]
            else:
                out += [np.array(self.bare.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes() for p in some]
        return out

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        other = pc.match_substring_regex(texts, self.OTHER).to_numpy(zero_copy_only=False)
        codes, bounds, pieces = pieces_of(self.cut(texts.filter(pa.array(~other))))
        ids, places = gathered(codes, self.known(pieces))
        cuts = places[bounds].tolist()
        by_pieces = iter([ids[a:b] for a, b in zip(cuts, cuts[1:])])
        alone = iter([self.by_library(t) for t in texts.filter(pa.array(other)).to_pylist()])
        return [next(alone if w else by_pieces) for w in other.tolist()]


class WordEncoder(_Cached):
    """BPE with word ends: lower case, white space separates words and is dropped."""

    #: Fixed value: what the split pattern of the public tokenizer file sets apart inside words.
    APART = r"('(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+|\p{N})"

    def __init__(self, path: str, limit: int = CACHED):
        super().__init__(path, limit)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.bare.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")

    @classmethod
    def cut(cls, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), cls.APART, r" \1 "))

    def at_once(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(self.bare.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        return ids, np.concatenate(([0], ends[:-1])), ends


class ByteEncoder(_Cached):
    """Byte-level BPE: a word keeps the blank before it."""

    #: Fixed value: what the split pattern of byte-level BPE sets apart from letters.
    APART = r"('(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}\x01]+| ?\p{N}+)"
    #: White space in runs or at a text's ends needs the whole text.
    OTHER = _Cached.OTHER + r"|[ \n][ \n]|\A[ \n]|[ \n]\z"

    def __init__(self, path: str, limit: int = CACHED):
        super().__init__(path, limit)
        self.bare = Tokenizer.from_file(path)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        newline = self.by_library("\n")
        self.newline, self.given["\n"] = newline[0], newline.tobytes()

    @classmethod
    def cut(cls, texts: pa.Array) -> pa.ListArray:
        spaced = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01")
        apart = pc.replace_substring_regex(spaced, cls.APART, "\x01\\1\x01")
        return pc.split_pattern(pc.replace_substring(apart, "\x01\x01", "\x01"), "\x01")

    def at_once(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(self.bare.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.newline)
        return ids, np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(ids)]))


_encoders: dict[tuple[str, str], _Cached] = {}


def encoder(kind: str, path: str, cached: int = CACHED) -> WordEncoder | ByteEncoder:
    """One encoder per Python worker, kept between tasks."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = {"word": WordEncoder, "byte": ByteEncoder}[kind](path, cached)
    found = _encoders[kind, path]
    found.limit = cached
    return found


def merges_of(path: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """The merge rules, in order, and the vocabulary of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return pairs, model["vocab"]
