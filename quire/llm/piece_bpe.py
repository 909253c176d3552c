"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

All symbols of many words stand in one flat numpy array. In a round every word
finds its lowest pair rank (a segmented minimum) and merges the leftmost pair of
that rank; all its pairs of that rank, from the left and not overlapping, where
the vocabulary proves that no better pair can arise from such a merge. The array
is compacted and finished words leave it, until no pair remains. This is the order
in which the library merges, so ids are equal.

Words are cut where the vocabulary has no piece that crosses: before a run of
spaces, around line ends, and in long space runs (``Vocabulary`` checks this and
otherwise keeps texts whole). Each distinct word is merged once and kept in a
cache of bounded size; a full cache is emptied, which costs time only.

Decoding joins the pieces' bytes. Bytes that are no UTF-8 (not from ``encode``) go
to the library.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows encode alike; an empty table gives no rows. Other columns are kept; an
input column named like an output column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.arrow_ops import add_columns, col, texts

SPACE = "▁"
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Pieces, pair ranks and the places where words can be cut."""

    def __init__(self, model: str):
        import sentencepiece  # noqa: PLC0415

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        byte = {i for i in range(size) if sp.is_byte(i)}
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i)}
        plain = {self.piece[i]: i for i in range(size) if i not in byte and i not in special}
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in byte}
        self.bytes = [
            bytes([int(p[3:5], 16)]) if i in byte else b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)
        ]
        self.symbol = dict(plain)  # text of a symbol -> its number; pieces keep their ids
        for p in plain:
            for c in p:
                self.symbol.setdefault(c, size + len(self.symbol))
        scores = sorted({sp.get_score(i) for i in plain.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        self.width = max(self.symbol.values()) + 2
        pairs = sorted(
            (self.symbol[p[:k]] * self.width + self.symbol[p[k:]], rank_of[sp.get_score(i)], i)
            for p, i in plain.items() for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol
        )
        self.pair, self.rank, self.made = (np.array([x[j] for x in pairs], np.int64) for j in range(3))
        self._prove(plain)
        lengths = [len(b) for b in self.bytes]
        self.byte_len = np.array(lengths, np.int64)
        self.byte_start = np.concatenate([[0], np.cumsum(self.byte_len)[:-1]])
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.is_byte = np.array([i in byte for i in range(size)])

    def _prove(self, plain: dict[str, int]) -> None:
        """Ranks whose merges cannot lead to a pair of the same or a better rank, and
        the cuts that no piece crosses."""
        left, right = self.pair // self.width, self.pair % self.width
        best = np.full(self.width + 1, _NONE)  # the best rank of a pair with this symbol in it
        np.minimum.at(best, left, self.rank)
        np.minimum.at(best, right, self.rank)
        risky = best[self.made] <= self.rank
        self.safe = np.ones(int(self.rank.max()) + 1 if len(self.rank) else 1, bool)
        self.safe[self.rank[risky]] = False
        runs = sorted(len(p) for p in plain if set(p) == {SPACE})
        inner = any(re.search(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}[^{SPACE}]", p) for p in plain)
        lines = any("\n" in p and len(p) > 1 for p in plain)
        worst = [self.rank[i] for i in range(len(self.pair)) if set(self.piece[self.made[i]]) == {SPACE}]
        longest = runs[-1] if runs else 1
        regular = runs == list(range(1, longest + 1)) and all(r == self.safe.size - 1 for r in worst)
        if inner or lines:
            self.word = re.compile(".+", re.S)
        else:
            split = f"{SPACE}{{{longest}}}(?={SPACE})|" if regular and longest > 1 else ""
            self.word = re.compile(f"{split}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (a, b): rank, or a huge number, and the merged piece."""
        if not len(self.pair):
            return np.full(len(a), _NONE), np.zeros(len(a), np.int64)
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], _NONE), self.made[at]


def merge_rounds(vocab: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges within words until no pair remains. ``word`` numbers the word of each
    symbol, in order. Returns symbols and their words, in order."""
    place = np.arange(len(symbols))
    finished: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)

    def look(at: np.ndarray) -> None:
        """Ranks of the pairs that start at these places; a word's last symbol starts none."""
        if len(at) and at[-1] == len(symbols) - 1:
            rank[at[-1]], at = _NONE, at[:-1]
        found, made[at] = vocab.ranks(symbols[at], symbols[at + 1])
        rank[at] = np.where(word[at] == word[at + 1], found, _NONE)

    look(place)
    while len(symbols):
        opens = np.concatenate([[True], word[1:] != word[:-1]])
        of = np.cumsum(opens) - 1
        least = np.minimum.reduceat(rank, np.flatnonzero(opens))
        live = least < _NONE
        if not live.all():  # finished words leave
            stay = live[of]
            finished.append((place[~stay], symbols[~stay], word[~stay]))
            symbols, word, place, rank, made, of = (x[stay] for x in (symbols, word, place, rank, made, of))
            if not len(symbols):
                break
        at = np.flatnonzero(rank == least[of])
        one = np.concatenate([[True], of[at][1:] != of[at][:-1]])  # leftmost of its word
        run = np.concatenate([[True], at[1:] != at[:-1] + 1]) | one
        odd = (np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 1
        at = at[np.where(vocab.safe[rank[at]], ~odd, one)]
        symbols[at] = made[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, word, place, rank, made = (x[stay] for x in (symbols, word, place, rank, made))
        at = at - np.arange(len(at))  # where the merged symbols stand now
        look(np.unique(np.concatenate([at[at > 0] - 1, at])))  # only pairs with a merged symbol are new
    if not finished:
        return symbols, word
    order = np.argsort(np.concatenate([f[0] for f in finished]), kind="stable")
    return np.concatenate([f[1] for f in finished])[order], np.concatenate([f[2] for f in finished])[order]


class Encoder:
    """Encodes batches of texts; keeps the ids of up to ``cache_words`` words."""

    def __init__(self, model: str, cache_words: int = 300_000):
        self.vocab, self.cache_words = Vocabulary(model), cache_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        symbol, rare = self.vocab.symbol, {}
        flat, lengths = [], []
        for w in words:
            flat.extend(symbol.get(c) if c in symbol else -1 - rare.setdefault(c, len(rare)) for c in w)
            lengths.append(len(w))
        symbols, word = merge_rounds(self.vocab, np.array(flat, np.int64), np.repeat(np.arange(len(words)), lengths))
        bad = np.flatnonzero((symbols < 0) | (symbols >= len(self.vocab.piece)))
        if len(bad):  # characters without a piece become their bytes
            name = {-1 - n: c for c, n in rare.items()} | {n: c for c, n in symbol.items() if n >= len(self.vocab.piece)}
            spelled = [[self.vocab.byte_id[b] for b in name[int(symbols[i])].encode()] for i in bad]
            times = np.ones(len(symbols), np.int64)
            times[bad] = [len(s) for s in spelled]
            where = np.concatenate([[0], np.cumsum(times)[:-1]])
            symbols, word = np.repeat(symbols, times), np.repeat(word, times)
            for i, s in zip(bad, spelled, strict=True):
                symbols[where[i] : where[i] + len(s)] = s
        counts = np.bincount(word, minlength=len(words))
        self.ids = np.concatenate([self.ids, symbols.astype(np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def encode(self, values: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offset of each text."""
        if len(self.index) > self.cache_words:
            self._clear()
        cut = self.vocab.word.findall
        split = [cut(SPACE + v.replace(" ", SPACE)) if v else [] for v in values]
        base, index = len(self.index), self.index
        at = np.array([index.setdefault(w, len(index)) for words in split for w in words], np.int64)
        if len(index) > base:
            fresh = list(index)[base:] if base else list(index)
            self._learn(fresh)
        lengths = self.start[at + 1] - self.start[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.start[at] - (ends - lengths), lengths)]
        per_text = np.concatenate([[0], np.cumsum([len(words) for words in split])]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[per_text]


def decode_flat(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of flat ids, as the library decodes them."""
    lengths = vocab.byte_len[ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    flat = vocab.byte_flat[np.arange(total) + np.repeat(vocab.byte_start[ids] - (ends - lengths), lengths)].tobytes()
    cuts = np.concatenate([[0], ends])[offsets]
    out = []
    for i in range(len(offsets) - 1):
        own = flat[cuts[i] : cuts[i + 1]]
        a = int(offsets[i])
        if a < offsets[i + 1] and own[:1] == b" " and not vocab.is_byte[ids[a]]:
            own = own[1:]
        try:
            out.append(own.decode())
        except UnicodeDecodeError:
            out.append(vocab.library.decode(ids[a : int(offsets[i + 1])].tolist()))
    return out


@lru_cache(maxsize=2)
def _encoder(model: str) -> Encoder:
    """One in each Python worker, which several tasks use one after the other."""
    return Encoder(model)


def encode(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` with ids (array of int), n_tokens and decoded, the text made from the ids.
    ``model`` is the path of a SentencePiece BPE model on every machine."""

    def make():
        def compute(array):
            encoder = _encoder(model)
            ids, offsets = encoder.encode(texts(array))
            decoded = decode_flat(encoder.vocab, ids, offsets)
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), np.diff(offsets).tolist(), decoded]

        return compute

    return add_columns(df, [col(text).cast("string")], "ids array<int>, n_tokens long, decoded string", make, most=2_000_000)


def decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``df`` with decoded, the text of an array of ids (null: empty)."""

    def make():
        def compute(_, array):
            lists = [x or [] for x in array.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            return [decode_flat(_encoder(model).vocab, np.array([i for x in lists for i in x], np.int64), offsets)]

        return compute

    from pyspark.sql import functions as F  # noqa: PLC0415

    return add_columns(df, [F.lit("").cast("string"), col(ids)], "decoded string", make)
