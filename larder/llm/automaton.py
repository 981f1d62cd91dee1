"""BPE encoding and decoding with a tokenization automaton."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches
from .tokens import WordEncoder, merges_of, pieces_of, vocabulary_path

#: How the public tokenizer file splits words, marks their ends and names its special tokens.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Automaton:
    """A deterministic automaton over tokens whose paths are exactly the BPE results, and its byte table.

    It starts as one state with a loop for every base symbol.  Each merge (u, v), in order, applies
    one gadget: the state t that all u-arcs enter is copied to a new state without the v-arc, the
    u-arcs are led to the copy, and every state with a u-arc gets an arc ``uv`` to where v leads.
    All arcs with one label enter one state, so ``target`` is a table by label.  The arc sets are
    kept as differences: the copies made for one label u are a chain on the state that u entered at
    first, and each knows the arc it lost and when it was made; a label knows its left part and when
    it was made.  ``allows`` resolves an arc by undoing the later of the two, a chain at a time.

    Every string has exactly one path, so every prefix of a word ends in exactly one token.  The
    byte table is the automaton read byte by byte: a row stands for the arcs that have been begun
    (a state and a place in the labels' trie) and names the token that ends there.  ``encode``
    follows the table over a word and reads the tokens' names back from its end; nothing is tried.
    Rows are filled when first met; beyond ``rows_kept`` the table starts anew.
    """

    def __init__(self, path: str, rows_kept: int = 400_000):
        merges, vocab = merges_of(path)
        letters = byte_letters()
        symbols = {c: b for b, c in enumerate(letters)}
        base = list(letters) + [c + WORD_END for c in letters]
        self.ids = [vocab[t] for t in base]
        number = {t: i for i, t in enumerate(base)}
        self.born, self.chain, self.place = [-1], [-1], [-1]
        self.target, self.first = [0] * len(base), [0] * len(base)
        # Of each label's chain: its states, their times, and the place where it lost an arc.
        self.copies: list[list[int]] = [[] for _ in base]
        self.times: list[list[int]] = [[] for _ in base]
        self.lost: list[dict[int, int]] = [{} for _ in base]
        self.left, self.made = [-1] * len(base), [-1] * len(base)
        for time, (a, b) in enumerate(merges):
            if a + b in number:
                raise ValueError(f"two merges make {a + b!r}")
            u, v = number[a], number[b]
            old = self.target[u]
            if not self.allows(old, v):
                continue  # no text ever has v after u at this point
            after = self.target[v]  # for u = v this is still the state before the split
            self.target[u] = len(self.born)
            self.born.append(2 * time)
            self.chain.append(u)
            self.place.append(len(self.copies[u]))
            self.lost[u][v] = len(self.copies[u])
            self.copies[u].append(self.target[u])
            self.times[u].append(2 * time)
            number[a + b] = len(self.target)
            self.target.append(after)
            self.first.append(after)
            self.copies.append([])
            self.times.append([])
            self.lost.append({})
            self.left.append(u)
            self.made.append(2 * time + 1)
            self.ids.append(vocab[a + b])
        # The labels' trie over bytes; a word's last byte b is the symbol 256 + b.
        self.next: list[dict[int, int]] = [{}]
        self.label, self.sizes = [-1], [0] * len(self.target)
        for token, label in number.items():
            node, ends = 0, token.endswith(WORD_END)
            raw = [symbols[c] for c in (token.removesuffix(WORD_END) if ends else token)]
            if ends:
                raw[-1] += 256
            for c in raw:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.label.append(-1)
                node = self.next[node][c]
            self.label[node], self.sizes[label] = label, len(raw)
        self.tokens = {i: t for t, i in vocab.items()}
        self.rows_kept = rows_kept
        self._clear()

    def allows(self, state: int, label: int) -> bool:
        """Whether ``state`` has an arc ``label``."""
        while state:
            made = self.made[label]
            if made > self.born[state]:
                label = self.left[label]
                continue
            u, place = self.chain[state], self.place[state]
            if self.lost[u].get(label, place + 1) <= place:
                return False
            older = bisect_left(self.times[u], made, 0, place + 1)
            state = self.copies[u][older - 1] if older else self.first[u]
        return True

    def _clear(self) -> None:
        self.row_of: dict[tuple, int] = {(-1, (0, 0)): 0}
        self.begun: list[tuple] = [(0, 0)]  # of each row: state, trie node, state, trie node, ...
        self.ended: list[int] = [-1]  # of each row: the token that ends there
        self.table: dict[int, int] = {}  # 512 * row + symbol to the next row

    def _fill(self, row: int, symbol: int) -> int:
        """The row after ``row`` and a symbol."""
        begun, ended, arcs = [], -1, self.begun[row]
        for state, node in zip(arcs[::2], arcs[1::2]):
            node = self.next[node].get(symbol)
            if node is not None:
                label = self.label[node]
                if ended < 0 <= label and self.allows(state, label):
                    ended = label
                if self.next[node]:
                    begun += (state, node)
        begun += (self.target[ended], 0)
        key = (ended, tuple(begun))
        to = self.row_of.get(key)
        if to is None:
            to = self.row_of[key] = len(self.ended)
            self.begun.append(key[1])
            self.ended.append(ended)
        self.table[row << 9 | symbol] = to
        return to

    def encode(self, piece: str) -> list[int]:
        """The token ids of one pre-split word, already in its normal form."""
        if len(self.ended) > self.rows_kept:
            self._clear()
        symbols = bytearray(piece.encode())
        table, ended, row, names = self.table, self.ended, 0, []
        for symbol in symbols[:-1]:
            to = table.get(row << 9 | symbol)
            row = self._fill(row, symbol) if to is None else to
            names.append(ended[row])
        symbol = 256 + symbols[-1]
        to = table.get(row << 9 | symbol)
        names.append(ended[self._fill(row, symbol) if to is None else to])
        out, at = [], len(names)
        while at:
            label = names[at - 1]
            out.append(self.ids[label])
            at -= self.sizes[label]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels, as the tokenizer file has no decoder: joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Codec:
    """Whole texts: special tokens, normal form, pre-splitting, and a cache of words' results."""

    def __init__(self, path: str, limit: int = 500_000):
        self.automaton = Automaton(path)
        self.limit = limit
        self.special = _special_ids(path)
        self.automaton.tokens.update((i, t) for t, i in self.special.items())
        self.pieces: dict[str, tuple[str, str]] = {}

    def _piece(self, piece: str) -> tuple[str, str]:
        if (found := self.pieces.get(piece)) is None:
            if not piece:
                return "", ""
            ids = self.automaton.encode(piece)
            found = self.pieces[piece] = " ".join(map(str, ids)), self.automaton.decode(ids)
        return found

    def _split(self, text: str) -> Iterator[tuple[str, str]]:
        """The steps of the tokenizer file for any text: special tokens, NFC and lower case, pattern."""
        for part in SPECIAL.split(text):
            if part in self.special:
                yield str(self.special[part]), part
            else:
                low = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                yield from map(self._piece, PATTERN.findall(low))

    def run(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """For each text: count of ids, the ids in decimal joined by a space, and the decoded text."""
        texts = pc.fill_null(texts, "")
        other = pc.match_substring_regex(texts, WordEncoder.OTHER).to_numpy(zero_copy_only=False)
        codes, bounds, pieces = pieces_of(WordEncoder.cut(texts.filter(pa.array(~other))))
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        ids, labels = zip(*[self._piece(p) for p in pieces]) if pieces else ((), ())
        if "" in pieces:  # at the ends of texts and in blank ones
            keep = codes != pieces.index("")
            bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
            codes = codes[keep]
        all_codes, cuts = codes.tolist(), iter(bounds.tolist())
        at = next(cuts)
        others = iter(texts.filter(pa.array(other)).to_pylist())
        for o in other.tolist():
            if o:
                parts = list(self._split(next(others)))
                joined, decoded = " ".join(p[0] for p in parts), " ".join(p[1] for p in parts)
            else:
                own, at = all_codes[at : (to := next(cuts))], to
                joined, decoded = " ".join(map(ids.__getitem__, own)), " ".join(map(labels.__getitem__, own))
            yield (joined.count(" ") + 1 if joined else 0), joined, decoded


def _special_ids(path: str) -> dict[str, int]:
    import json

    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One automaton per Python worker, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, with_texts: bool = True) -> DataFrame:
    """Encode whole texts by the automaton of the tokenizer file at ``path`` and decode them again.

    Gives doc_id, n_tokens, the digests of ids and decoded text and, if asked for, both themselves.
    One pass, no shuffle; each worker builds the automaton once from the file.  A null text is
    empty and has no tokens; null and repeated doc_ids pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in small_batches(batches, 2048):
            counts, shas, decoded_shas, ids_out, texts = [], [], [], [], []
            for n, ids, decoded in tool.run(batch.column(1)):
                counts.append(n)
                shas.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_shas.append(hashlib.sha256(decoded.encode()).hexdigest())
                ids_out.append([int(i) for i in ids.split()] if with_texts else None)
                texts.append(decoded if with_texts else None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded_shas), pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), with_texts=False).drop("ids", "decoded")
