"""Word BPE encoding and decoding with segment trees over adjacent pair ranks.

Each word has a segment tree whose leaves are the ranks of its adjacent pairs, each
with its place. The root is the leftmost pair of the lowest rank; merging it changes
three leaves (the pair before, the merged one, the one that is gone), and each change
goes up one path. Short words stand together as a forest in numpy arrays, one row a
word, and all take their next merge at once; a long word has a tree of its own, so a
word of n symbols takes n log n steps. This is the order in which the library merges, so
ids are equal.

A text is cut at the strings of special tokens, then at white space; what stands between
(a chunk) is normalised (NFC, lower case character by character), cut into words by the
tokenizer's pattern, and its UTF-8 bytes are the first symbols, the last with the mark of
a word's end. White space composes with nothing and belongs to no word, so chunks encode
alone. Chunks with characters that Python's Unicode tables do not know yet are cut by the
library's own tables. Distinct chunks are encoded once and kept in a cache of bounded size;
a full cache is emptied, which costs time only.

Decoding joins the tokens' strings with spaces, as the library does for a tokenizer without
a decoder.

Defined cases: a null or empty text has no ids and decodes to the empty text; so does one of
white space; special tokens inside a text become their ids; repeated rows encode alike; an
empty table gives no rows. Other columns are kept; an input column named like an output
column is replaced.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.arrow_ops import add_columns, col, texts

#: Unicode white space, which parts chunks
SPACES = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{SPACES}]+")
#: words of up to so many symbols stand in forests, longer ones have a tree of their own
FOREST = 64
_PLACES = 32  # bits for the place below a rank
_NONE = np.iinfo(np.int64).max


def ranges(kinds: str) -> str:
    """The inside of a character class: all code points whose category starts with one of ``kinds``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)).startswith(tuple(kinds.split()))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others by the code points from 256 up, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Pair ranks and the symbols that merges make."""

    def __init__(self, pairs: Sequence[tuple[int, int]], made: Sequence[int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order
        self.made = np.array(made, np.int64)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}

    def leaf(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The leaves of pairs (a, b) at these places; a symbol below 0 is none."""
        if not len(self.keys):
            return np.full(len(a), _NONE)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at] << _PLACES | place, _NONE)

    def grove(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merges all words of a forest: ``symbols`` has a row a word, filled up with -1, of
        2^k + 1 columns. Merged rows, in which -1 stands where a symbol is gone."""
        n, leaves = len(symbols), symbols.shape[1] - 1
        rows, places = np.arange(n), np.arange(leaves + 2)
        following = np.where(places[:-1] + 1 < lengths[:, None], places[1:], leaves + 1)
        before = np.tile(places - 1, (n, 1))
        symbols = np.concatenate([symbols, np.full((n, 1), -1)], 1)  # the place after the last one holds none
        tree = np.full((n, 2 * leaves), _NONE)
        tree[:, leaves:] = self.leaf(symbols[:, :leaves].ravel(), symbols[:, 1 : leaves + 1].ravel(), np.tile(places[:leaves], n)).reshape(n, leaves)
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        while True:
            rows = rows[tree[rows, 1] < _NONE]
            if not len(rows):
                return symbols[:, : leaves + 1]
            best = tree[rows, 1]
            at = best & ((1 << _PLACES) - 1)
            gone = following[rows, at]
            after = following[rows, gone]
            symbols[rows, at], symbols[rows, gone] = self.made[best >> _PLACES], -1
            following[rows, at], before[rows, after] = after, at
            tree[rows, leaves + np.minimum(gone, leaves - 1)] = _NONE  # a last symbol has no leaf: the one changed instead is written next
            changed = [np.minimum(gone, leaves - 1)]
            tree[rows, leaves + at] = self.leaf(symbols[rows, at], symbols[rows, after], at)
            changed.append(at)
            first = before[rows, at]
            some = first >= 0
            tree[rows[some], leaves + first[some]] = self.leaf(symbols[rows[some], first[some]], symbols[rows[some], at[some]], first[some])
            changed.append(np.where(some, first, at))
            nodes = [leaves + c for c in changed]
            for _ in range(leaves.bit_length() - 1):
                nodes = [node >> 1 for node in nodes]
                for node in nodes:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def tall(self, symbols: list[int]) -> list[int]:
        """Merges one long word with a tree of its own."""
        n, rank_of, made = len(symbols), self.rank_of, self.made.tolist()
        leaves = 1 << (n - 1).bit_length()
        none, mask = int(_NONE), (1 << _PLACES) - 1
        symbols = [*symbols, -1]
        following, before = list(range(1, n + 2)), list(range(-1, n))
        tree = [none] * (2 * leaves)

        def leaf(at: int, then: int) -> int:
            rank = rank_of.get(symbols[at] << 32 | symbols[then]) if then < n else None
            return none if rank is None else rank << _PLACES | at

        for i in range(n - 1):
            tree[leaves + i] = leaf(i, i + 1)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = leaves + at
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            at = tree[1] & mask
            symbols[at] = made[tree[1] >> _PLACES]
            gone = following[at]
            after = following[gone]
            symbols[gone] = -1
            following[at] = after
            if after < n:
                before[after] = at
            put(gone, none)
            put(at, leaf(at, after))
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return [s for s in symbols[:n] if s >= 0]

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words whose symbols stand in ``flat`` one after the other: the merged
        symbols, and how many each word has."""
        starts = np.cumsum(lengths) - lengths
        symbols, counts = flat.copy(), lengths.copy()
        size = np.where(lengths > FOREST, 0, np.where(lengths > 1, 1 << np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64), 0))
        kept = np.ones(len(flat), bool)
        for leaves in np.unique(size[size > 0]).tolist():
            of = np.flatnonzero(size == leaves)
            at = starts[of][:, None] + np.arange(leaves + 1)
            inside = np.arange(leaves + 1) < lengths[of][:, None]
            rows = np.where(inside, flat[np.minimum(at, len(flat) - 1)], -1)
            rows = self.grove(rows, lengths[of])
            symbols[at[inside]] = rows[inside]
            kept[at[inside]] = rows[inside] >= 0
            counts[of] = (rows >= 0).sum(1)
        for i in np.flatnonzero(lengths > FOREST).tolist():
            a, b = int(starts[i]), int(starts[i] + lengths[i])
            own = self.tall(flat[a:b].tolist())
            symbols[a : a + len(own)], kept[a + len(own) : b], counts[i] = own, False, len(own)
        return symbols[kept], counts


class Vocabulary:
    """A tokenizer file: byte-level BPE over words with an end mark, no decoder."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer  # noqa: PLC0415

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, mark = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.first = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + mark] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges([(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.mark = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        strings = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in {**ids, **self.special}.items():
            strings[i] = s
        spelled = [s.encode() + b" " for s in strings]
        self.byte_len = np.array([len(s) for s in spelled], np.int64)
        self.byte_start = np.cumsum(self.byte_len) - self.byte_len
        self.byte_flat = np.frombuffer(b"".join(spelled), np.uint8)
        letter, digit = ranges("L"), ranges("N")
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{SPACES}{letter}{digit}]+")
        self.unknown = re.compile(f"[{ranges('Cn')}]")
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(letters)}

    def words(self, chunk: str) -> list[bytes]:
        """The words of a chunk."""
        if chunk.isascii():
            return [w.encode() for w in self.word.findall(chunk.lower())]
        if self.unknown.search(chunk):
            return [bytes(self.byte_of[c] for c in w) for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
        chunk = unicodedata.normalize("NFC", chunk)
        # Python lowers a sigma by what stands around it
        chunk = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        return [w.encode() for w in self.word.findall(chunk)]


class Encoder:
    """Encodes batches of texts; keeps the ids of up to ``cache_chunks`` chunks."""

    def __init__(self, path: str, cache_chunks: int = 300_000):
        self.vocab, self.cache_chunks = Vocabulary(path), cache_chunks
        self._clear()

    def _clear(self) -> None:
        # special tokens are chunks that are known from the start; no other chunk is a tuple
        special = list(self.vocab.special.values())
        self.index: dict[str | tuple[int], int] = {(i,): n for n, i in enumerate(special)}
        self.ids, self.start = np.array(special, np.int32), np.arange(len(special) + 1)

    def _learn(self, chunks: list[str]) -> None:
        known: dict[bytes, int] = {}
        split = [self.vocab.words(c) for c in chunks]
        of = np.array([known.setdefault(w, len(known)) for words in split for w in words], np.int64)
        lengths = np.array([len(w) for w in known], np.int64)
        flat = np.frombuffer(b"".join(known), np.uint8)
        symbols = self.vocab.first[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.vocab.last[flat[ends]]
        symbols, counts = self.vocab.merges.merge(symbols, lengths)
        at, per_word = spread(np.cumsum(counts) - counts, counts, of)
        words = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(per_word)])[words[1:]]
        self.ids = np.concatenate([self.ids, symbols[at].astype(np.int32)])
        self.start = np.concatenate([self.start, self.start[-1] + ends])

    def _chunks(self, text: str) -> list:
        mark = self.vocab.mark
        if mark is None or not mark.search(text):
            return _CHUNK.findall(text)
        out, a = [], 0
        for m in mark.finditer(text):
            out += [*_CHUNK.findall(text, a, m.start()), (self.vocab.special[m[0]],)]
            a = m.end()
        return out + _CHUNK.findall(text, a)

    def encode(self, values: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offset of each text."""
        if len(self.index) > self.cache_chunks:
            self._clear()
        index, base = self.index, len(self.index)
        split = [self._chunks(v) for v in values]
        of = np.array([index.setdefault(c, len(index)) for chunks in split for c in chunks], np.int64)
        if len(index) > base:
            self._learn(list(index)[base:])
        at, counts = spread(self.start[:-1], np.diff(self.start), of)
        per_text = np.concatenate([[0], np.cumsum([len(c) for c in split])]).astype(np.int64)
        return self.ids[at], np.concatenate([[0], np.cumsum(counts)])[per_text]


def spread(starts: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the stretches ``of``, one after the other, and how long each is."""
    own = lengths[of]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts[of] - (ends - own), own), own


def decode_flat(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of flat ids, as the library decodes them."""
    at, lengths = spread(vocab.byte_start, vocab.byte_len, ids)
    flat = vocab.byte_flat[at].tobytes()
    cuts = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
    return [flat[a : max(a, b - 1)].decode() for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One in each Python worker, which several tasks use one after the other."""
    return Encoder(path)


def encode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``df`` with ids (array of int), n_tokens and decoded, the text made from the ids.
    ``tokenizer`` is the path of a tokenizer file on every machine."""

    def make():
        def compute(array):
            encoder = _encoder(tokenizer)
            ids, offsets = encoder.encode(texts(array))
            decoded = decode_flat(encoder.vocab, ids, offsets)
            return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), np.diff(offsets).tolist(), decoded]

        return compute

    return add_columns(df, [col(text).cast("string")], "ids array<int>, n_tokens long, decoded string", make, most=2_000_000)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``df`` with decoded, the text of an array of ids (null: empty)."""

    def make():
        def compute(array):
            lists = [x or [] for x in array.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            return [decode_flat(_encoder(tokenizer).vocab, np.array([i for x in lists for i in x], np.int64), offsets)]

        return compute

    return add_columns(df, [col(ids).cast("array<long>")], "decoded string", make)
