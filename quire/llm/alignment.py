"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, and
in how many documents.

A text is encoded by a byte-level BPE (A, with a space put before the text) and by a piece BPE
(B, which puts it there itself). Places where tokens of both end cut them into groups; a
token of A and one of B in a group are linked. The count of an id pair is the number of
documents that hold it linked.

1. Every task aligns its documents and writes how many of them hold each pair. The distinct
   pairs of all tasks are cut by a hash into buckets of about 32,768. Each bucket gets a minimal
   perfect hash: cascaded bit arrays in which a key that is alone in its place sets a bit and all others go on to
   the next array; a key's number is the rank of its bit. The keys stand beside it in that order, so a look-up is verified.
2. The tasks' counts become dense vectors indexed by the hash, bucket by bucket, which are
   summed in a tree of sixteen at a time.
3. A second pass aligns the documents again and looks the counts up.

What is sent to tasks is a slice of 128 buckets (4.2 million pairs, about 70 MB with counts), and the best
count of each A id (as many as the vocabulary has); more pairs make more slices, taken one after
the other, each in a pass of its own. All pairs of all documents are counted.

A text is cut at single spaces between other characters: both tokenizers start a token there
whatever stands around (the pattern of A takes at most one space, at a token's front; that no piece of B
holds a space behind another character is checked). Distinct stretches are aligned once and kept in a
cache of bounded size; when it is full, those that came up in one batch only leave. Links of a group come
from its distinct ids, so a long run of one character adds few.

Defined cases: a null or empty text, or one whose joined token bytes of A or B are not the
space and the text (a text with U+2581), has no tokens: zeros, and the empty groups; strings of
special tokens are plain text; repeated rows are documents of their own; an empty table gives no rows.
Other columns are kept; an input column named like an output column is replaced.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow_ops import add_columns, col, slices, texts
from quire.llm.tree_bpe import byte_letters, spread
from quire.session import written

SPACE = "▁"
#: the usual pattern that splits text before byte-level merges: a fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" \s|\s ")
#: ids of B per id of A in a pair's key
PIECES = 1 << 15
#: pairs of a bucket, about; buckets of a slice; vectors summed at a time
BUCKET, SLICE, FAN = 1 << 15, 128, 16
#: pairs that a task counts before it tells them
HELD = 2_000_000
OUT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


# Aligning ------------------------------------------------------------------


class Aligner:
    """Aligns texts, stretch by stretch. Of each stretch it knows, by number: its tokens, its
    groups, its distinct pairs, and how many links each pair has."""

    def __init__(self, byte_file: str, piece_file: str, cache: int = 300_000):
        import sentencepiece  # noqa: PLC0415
        import tiktoken  # noqa: PLC0415

        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        with open(byte_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if made != sorted(made):
            raise ValueError("the ids are not in the order of the merges")
        ranks = {bytes(byte_of[c] for c in s): i for s, i in model["vocab"].items()}
        # the same vocabulary and pattern; strings of special tokens are plain text
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        of_a = [b""] * (max(ranks.values()) + 1)
        for s, i in ranks.items():
            of_a[i] = s
        of_b = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            plain = not (self.b.is_control(i) or self.b.is_unknown(i))
            of_b.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() if plain else b"")
            if plain and re.search(f"[^{SPACE}]{SPACE}", p):
                raise ValueError("a piece holds a space behind another character: texts cannot be cut there")
        if len(of_b) > PIECES:
            raise ValueError(f"more than {PIECES} pieces")
        self.bytes = [_Strings(of_a), _Strings(of_b)]
        self.cache, self.clears = cache, 0
        self._clear()

    def _clear(self) -> None:
        self.clears += 1
        self.index: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        self.bad = np.zeros(0, bool)
        # by stretch: where its tokens, groups and pairs start
        self.at = {k: np.zeros(1, np.int64) for k in ("a", "b", "group", "pair")}
        self.ids_a, self.ids_b, self.group_a, self.group_b, self.pairs, self.links = (none,) * 6
        self.n_links = none
        self.batches = none  # in how many batches each stretch came up

    def _trim(self) -> None:
        """Keeps the stretches that came up in several batches, if they are half of all at most."""
        keep = np.flatnonzero(self.batches > 1)
        if 2 * len(keep) > self.cache:
            return self._clear()
        self.clears += 1
        names = list(self.index)
        self.index = {names[i]: n for n, i in enumerate(keep.tolist())}
        for kind, columns in (("a", ["ids_a"]), ("b", ["ids_b"]), ("group", ["group_a", "group_b"]), ("pair", ["pairs", "links"])):
            at, lengths = spread(self.at[kind][:-1], np.diff(self.at[kind]), keep)
            self.at[kind] = np.concatenate([[0], np.cumsum(lengths)])
            for c in columns:
                setattr(self, c, getattr(self, c)[at])
        self.bad, self.n_links, self.batches = self.bad[keep], self.n_links[keep], np.ones(len(keep), np.int64)

    def stretches(self, text: str) -> list[str]:
        """The text cut at single spaces; each stands for a space and itself."""
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or _ODD.search(text):
            return _CUT.split(text)
        return text.split(" ")

    def _encode(self, blocks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each block."""
        a = [np.array(self.a.encode_ordinary(" " + b), np.int64) for b in blocks]
        b = [np.array(ids, np.int64) for ids in self.b.encode(blocks, num_threads=1)]
        return list(zip(a, b, strict=True))

    def _exact(self, block: str, a: np.ndarray, b: np.ndarray) -> bool:
        want = (" " + block).encode()
        return self.bytes[0].join(a) == want and self.bytes[1].join(b) == want

    def _learn(self, fresh: list[str]) -> None:
        """Many stretches are encoded in one call, joined by the spaces they were cut at."""
        blocks, size = [[]], 0
        for i, s in enumerate(fresh):
            alone = not s or s[-1].isspace()  # the end of a text, which nothing can follow
            if blocks[-1] and (alone or size > 8000):
                blocks.append([])
                size = 0
            blocks[-1].append(i)
            size = 10_000 if alone else size + len(s) + 1
        joined = [" ".join(fresh[i] for i in block) for block in blocks]
        bad = np.zeros(len(fresh), bool)
        parts_a, parts_b = [], []
        for block, text, (a, b) in zip(blocks, joined, self._encode(joined), strict=True):
            if self._exact(text, a, b):
                parts_a.append(a)
                parts_b.append(b)
                continue
            for i, (x, y) in zip(block, self._encode([fresh[i] for i in block]), strict=True):
                if self._exact(fresh[i], x, y):
                    parts_a.append(x)
                    parts_b.append(y)
                else:
                    bad[i] = True
        a, b = np.concatenate([*parts_a, np.zeros(0, np.int64)]), np.concatenate([*parts_b, np.zeros(0, np.int64)])
        ends_a, ends_b = np.cumsum(self.bytes[0].len[a]), np.cumsum(self.bytes[1].len[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        lengths = np.array([0 if is_bad else len(s.encode()) + 1 for s, is_bad in zip(fresh, bad, strict=True)], np.int64)
        ends = np.cumsum(lengths)
        upto = np.searchsorted(common, ends, "right")
        last = common[upto[~bad] - 1] if len(common) else np.zeros(0, np.int64)
        if not np.array_equal(last, ends[~bad]):
            raise ValueError("a token crosses a single space")
        in_a, in_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        group_a, group_b = np.bincount(in_a, minlength=len(common)), np.bincount(in_b, minlength=len(common))
        stretch = np.searchsorted(upto, np.arange(len(common)), "right")
        pairs, links, of = _linked(in_a, a, in_b, b, stretch)
        self.bad = np.concatenate([self.bad, bad])
        counts = {"a": np.searchsorted(ends_a, ends, "right"), "b": np.searchsorted(ends_b, ends, "right"), "group": upto,
                  "pair": np.searchsorted(of, np.arange(len(fresh)), "right")}
        for k, more in counts.items():
            self.at[k] = np.concatenate([self.at[k], self.at[k][-1] + more])
        n_links = np.bincount(stretch, weights=group_a * group_b, minlength=len(fresh)).astype(np.int64)
        for name, more in (("ids_a", a), ("ids_b", b), ("group_a", group_a), ("group_b", group_b), ("pairs", pairs), ("links", links), ("n_links", n_links)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def align(self, values: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the stretches of all texts, and the offset of each text; a text
        without tokens has none."""
        if len(self.index) > self.cache:
            self._trim()
        index, base = self.index, len(self.index)
        split = [self.stretches(v) for v in values]
        of = np.array([index.setdefault(s, len(index)) for stretches in split for s in stretches], np.int64)
        if len(index) > base:
            self._learn(list(index)[base:])
            self.batches = np.concatenate([self.batches, np.zeros(len(index) - base, np.int64)])
        self.batches[np.unique(of)] += 1
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        wrong = np.concatenate([[0], np.cumsum(self.bad[of])])
        keep = wrong[offsets[1:]] == wrong[offsets[:-1]]
        lengths = np.diff(offsets)
        return of[np.repeat(keep, lengths)], np.concatenate([[0], np.cumsum(np.where(keep, lengths, 0))])

    def document_pairs(self, of: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The distinct pairs of each text, of all texts one after the other."""
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        both = np.unique(text << 32 | of)
        at, counts = spread(self.at["pair"][:-1], np.diff(self.at["pair"]), both & 0xFFFFFFFF)
        return np.unique(np.repeat(both >> 32, counts) << 32 | self.pairs[at]) & 0xFFFFFFFF

    def groups(self, first: int) -> list[str]:
        """The groups of the stretches from number ``first`` on, as text."""
        out = []
        g, a, b = (int(self.at[k][first]) for k in ("group", "a", "b"))
        ids_a, ids_b = list(map(str, self.ids_a[a:].tolist())), list(map(str, self.ids_b[b:].tolist()))
        sizes = zip(self.group_a[g:].tolist(), self.group_b[g:].tolist(), strict=True)
        x = y = 0
        for n in np.diff(self.at["group"][first:]).tolist():
            made = []
            for na, nb in islice(sizes, n):
                made.append(f"{','.join(ids_a[x : x + na])}|{','.join(ids_b[y : y + nb])}")
                x, y = x + na, y + nb
            out.append(";".join(made))
        return out


class _Strings:
    """Byte strings by number."""

    def __init__(self, strings: Sequence[bytes]):
        self.len = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.len) - self.len
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        return self.flat[spread(self.start, self.len, ids)[0]].tobytes()


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) with how often each occurs, by group."""
    both, counts = np.unique(group << 32 | ids, return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, counts


def _linked(in_a: np.ndarray, a: np.ndarray, in_b: np.ndarray, b: np.ndarray, stretch: np.ndarray, most: int = 2_000_000):
    """Distinct pairs of each stretch with their links, and the stretch of each, in order.
    ``most`` products of ids are held at a time, or those of one group."""
    ga, a, ca = _distinct(in_a, a)
    gb, b, cb = _distinct(in_b, b)
    groups = len(stretch)
    first_b = np.searchsorted(gb, np.arange(groups + 1))
    width = np.diff(first_b)[ga] if groups else np.zeros(0, np.int64)
    ends = np.cumsum(width)
    out = []
    start = 0
    while start < len(ga):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        of = np.arange(start, stop)
        at, own = spread(first_b[:-1][ga], width, of)
        key = np.repeat(a[of], own) * PIECES + b[at]
        both, where = np.unique(stretch[np.repeat(ga[of], own)] << 32 | key, return_inverse=True)
        links = np.zeros(len(both), np.int64)
        np.add.at(links, where, np.repeat(ca[of], own) * cb[at])
        out.append((both, links))
        start = stop
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    both, where = np.unique(np.concatenate([o[0] for o in out]), return_inverse=True)
    links = np.zeros(len(both), np.int64)
    np.add.at(links, where, np.concatenate([o[1] for o in out]))
    return both & 0xFFFFFFFF, links, both >> 32


@lru_cache(maxsize=1)
def _aligner(byte_file: str, piece_file: str) -> Aligner:
    """One in each Python worker, which several tasks and passes use one after the other."""
    return Aligner(byte_file, piece_file)


# Minimal perfect hashing -----------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """32 well-mixed bits of each key (the finaliser of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(32)).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return mixed(keys, -1) * buckets >> 32


def cascade(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """The minimal perfect hash of distinct keys: sizes of the bit arrays, their bits one
    after the other, and the keys in the order of their numbers."""
    sizes, arrays, order = [], [], []
    while len(keys):
        size = -(-len(keys) * 3 // 2 // 64) * 64 or 64
        place = mixed(keys, len(sizes)) * size >> 32
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, np.uint8)
        bits[place[alone]] = 1
        sizes.append(size)
        arrays.append(np.packbits(bits, bitorder="little"))
        order.append(keys[alone][np.argsort(place[alone])])
        keys = keys[~alone]
    return sizes, np.concatenate([*arrays, np.zeros(0, np.uint8)]).tobytes(), np.concatenate([*order, np.zeros(0, np.int64)])


class PairHash:
    """The minimal perfect hash of a slice: buckets ``first`` and following of ``buckets``."""

    def __init__(self, first: int, buckets: int, rows: Sequence[tuple[int, Sequence[int], bytes, bytes]]):
        """``rows``: bucket, sizes, bits, keys."""
        rows = sorted(rows, key=lambda r: r[0])
        self.first, self.buckets = first, buckets
        width = rows[-1][0] - first + 1 if rows else 0
        levels = max((len(r[1]) for r in rows), default=0)
        self.size, self.start = np.zeros((width, levels), np.int64), np.zeros((width, levels), np.int64)
        self.offset = np.zeros(width + 1, np.int64)
        base = 0
        for bucket, sizes, _, keys in rows:
            at = bucket - first
            self.size[at, : len(sizes)] = sizes
            self.start[at, : len(sizes)] = base + np.cumsum(sizes) - sizes
            base += sum(sizes)
            self.offset[at + 1] = len(keys) // 8
        self.offset = np.cumsum(self.offset)
        self.bits = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.uint64)
        self.rank = np.cumsum(np.bitwise_count(self.bits).astype(np.int64)) - np.bitwise_count(self.bits)
        self.keys = np.frombuffer(b"".join(bytes(r[3]) for r in rows), np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key in this slice, -1 of one that is not in it."""
        out = np.full(len(keys), -1, np.int64)
        bucket = bucket_of(keys, self.buckets) - self.first
        live = np.flatnonzero((bucket >= 0) & (bucket < len(self.size)))
        for level in range(self.size.shape[1]):
            size = self.size[bucket[live], level]
            live, size = live[size > 0], size[size > 0]
            if not len(live):
                break
            place = self.start[bucket[live], level] + (mixed(keys[live], level) * size >> 32)
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[live[here]] = (self.rank[place >> 6] + below)[here]
            live = live[~here]
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != keys[found]]] = -1
        return out


# Passes ----------------------------------------------------------------------


def _batches(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in stretches of about ``most`` bytes."""
    for whole in batches:
        lengths = pc.fill_null(pc.binary_length(whole.column(0)), 0).to_pylist()
        for batch in slices(whole, lengths, most):
            yield texts(batch.column(0))


def counted_pairs(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """How many documents of each task hold each pair (``docs``: one column of texts). A
    task with very many pairs tells them in several stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_file, piece_file)
        none = np.zeros(0, np.int64)
        keys, counts = none, none

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

        for values in _batches(batches):
            more, own = np.unique(aligner.document_pairs(*aligner.align(values)), return_counts=True)
            both, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([counts, own]))
            keys, counts = both, total
            if len(keys) > HELD:
                yield rows()
                keys, counts = none, none
        yield rows()

    return docs.mapInArrow(run, "pair long, n long")


def hashed(pairs: DataFrame, buckets: int) -> DataFrame:
    """The minimal perfect hash of each bucket of distinct pairs."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(keys, buckets).astype(np.int32)), batch.column(0)], names=["bucket", "pair"])

    def build(bucket: pa.Table) -> pa.Table:
        sizes, bits, keys = cascade(np.sort(bucket["pair"].to_numpy()))
        return pa.table({
            "bucket": pa.array([bucket["bucket"][0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": pa.array([bits], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary()),
        })

    dealt = pairs.mapInArrow(deal, "bucket int, pair long")
    return dealt.groupBy("bucket").applyInArrow(build, "bucket int, sizes array<long>, bits binary, keys binary")


def count_vectors(counted: DataFrame, pair_hash) -> DataFrame:
    """Tasks' vectors of counts, bucket by bucket, from rows of pair and n. ``pair_hash`` is
    a broadcast PairHash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext  # noqa: PLC0415

        known = pair_hash.value
        vector = np.zeros(len(known.keys), np.int64)
        for batch in batches:
            keys, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            at = known.find(keys)
            np.add.at(vector, at[at >= 0], counts[at >= 0])
        part = TaskContext.get().partitionId()
        for i, (a, b) in enumerate(zip(known.offset, known.offset[1:])):
            if vector[a:b].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([known.first + i], pa.int32()), pa.array([part], pa.int32()), pa.array([vector[a:b].tobytes()], pa.binary())],
                    names=["bucket", "part", "vector"])

    return counted.select("pair", "n").mapInArrow(run, "bucket int, part int, vector binary")


def tree_sum(vectors: DataFrame) -> DataFrame:
    """The sum of the vectors of each bucket, FAN at a time. ``vectors`` is a written table."""
    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, np.int64) for v in group["vector"].to_pylist()], 0)
        first = [pa.array([group[c][0].as_py()], pa.int32()) for c in ("bucket", "part")]
        return pa.table([*first, pa.array([total.tobytes()], pa.binary())], names=["bucket", "part", "vector"])

    parts = (vectors.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN)
        vectors = vectors.withColumn("part", F.expr(f"part div {FAN}").cast("int"))
        vectors = vectors.groupBy("bucket", "part").applyInArrow(add, "bucket int, part int, vector binary")
        if parts == 1:
            return vectors.drop("part")


def best_counts(counted: DataFrame) -> dict[int, int]:
    """The highest count of each id of A (as many rows as the vocabulary has at most)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, counts = np.frombuffer(keys, np.int64) // PIECES, np.frombuffer(vector, np.int64)
                order = np.lexsort([counts, a])
                last = np.append(np.flatnonzero(np.diff(a[order])), len(a) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(a[order][last]), pa.array(counts[order][last])], names=["a", "n"])

    made = counted.select("keys", "vector").mapInArrow(run, "a long, n long")
    return {r.a: r.n for r in made.groupBy("a").agg(F.max("n").alias("n")).collect()}


class Counts:
    """What tasks of the second pass know of a slice: hash, counts, and the best count by id of A."""

    def __init__(self, pair_hash: PairHash, counts: np.ndarray, best: np.ndarray, token: str):
        self.hash, self.counts, self.best, self.token = pair_hash, counts, best, token

    def of(self, aligner: Aligner, first: int) -> tuple[np.ndarray, np.ndarray]:
        """n_best and count_sum of the stretches from number ``first`` on."""
        base = aligner.at["pair"][first]
        pairs, links = aligner.pairs[base:], aligner.links[base:]
        at = self.hash.find(pairs)
        count = np.where(at >= 0, self.counts[at] if len(self.counts) else 0, 0)
        # an id that only texts without tokens hold has no best count
        is_best = (at >= 0) & (count == self.best[np.minimum(pairs // PIECES, len(self.best) - 1)])
        cuts = aligner.at["pair"][first:] - base
        sums = [np.concatenate([[0], np.cumsum(v)])[cuts] for v in (links * is_best, links * count)]
        return np.diff(sums[0]), np.diff(sums[1])


class _Looked:
    """Texts, n_best and count_sum of the stretches that an aligner knows, for one slice."""

    def __init__(self, aligner: Aligner, counts: Counts):
        self.aligner, self.counts, self.clears = aligner, counts, -1

    def update(self) -> None:
        if self.clears != self.aligner.clears:
            self.clears, self.groups = self.aligner.clears, []
            self.n_best = self.count_sum = np.zeros(0, np.int64)
        first = len(self.groups)
        if first < len(self.aligner.bad):
            n_best, count_sum = self.counts.of(self.aligner, first)
            self.n_best, self.count_sum = np.concatenate([self.n_best, n_best]), np.concatenate([self.count_sum, count_sum])
            self.groups += self.aligner.groups(first)


_looked: list[_Looked] = []


def _lookup(aligner: Aligner, counts: Counts) -> _Looked:
    """The look-ups of this worker; those of an earlier slice are given up."""
    if not _looked or _looked[0].counts.token != counts.token or _looked[0].aligner is not aligner:
        _looked[:] = [_Looked(aligner, counts)]
    return _looked[0]


def look_up(df: DataFrame, text: str, byte_file: str, piece_file: str, counts, further: bool) -> DataFrame:
    """The second pass for one slice (a broadcast Counts); ``further`` slices add to what
    ``df`` has from those before."""
    def make():
        def compute(array, best_before, sum_before):
            aligner = _aligner(byte_file, piece_file)
            of, offsets = aligner.align(texts(array))
            known = _lookup(aligner, counts.value)
            known.update()

            def total(by_stretch: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(by_stretch[of])])[offsets])

            numbers = of.tolist()
            groups = [";".join([known.groups[i] for i in numbers[a:b]]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            made = [total(np.diff(aligner.at[k])) for k in ("a", "b", "group")] + [total(aligner.n_links)]
            made += [total(known.n_best) + best_before.to_numpy(), total(known.count_sum) + sum_before.to_numpy()]
            return [*(pa.array(m) for m in made), groups]

        return compute

    before = [col("n_best"), col("count_sum")] if further else [F.lit(0).cast("long")] * 2
    return add_columns(df, [col(text).cast("string"), *before], OUT, make, most=2_000_000)


def align(df: DataFrame, byte_file: str, piece_file: str, text: str = "text") -> DataFrame:
    """``df`` with n_a and n_b (tokens), n_groups, n_links, n_best (links whose count is the
    highest of their A id), count_sum (over links) and groups (``a1,a2|b1;a3|b2,b3``). The
    files are paths on every machine."""
    spark = df.sparkSession
    docs = df.select(col(text).cast("string").alias("text"))
    told = written(counted_pairs(docs, byte_file, piece_file), "align-told")
    pairs = written(told.select("pair").distinct(), "align-pairs")
    buckets = max(1, -(-pairs.count() // BUCKET))
    tables = written(hashed(pairs, buckets), "align-hash")
    sent, counted = [], []
    for first in range(0, buckets, SLICE):
        part = tables.filter(F.col("bucket").between(first, first + SLICE - 1))
        pair_hash = spark.sparkContext.broadcast(PairHash(first, buckets, part.collect()))
        vectors = written(count_vectors(told, pair_hash), "align-vectors")
        counted.append(written(part.join(tree_sum(vectors), "bucket").select("bucket", "keys", "vector"), "align-counts"))
        sent.append(first)
    best: dict[int, int] = {}
    for c in counted:
        for a, n in best_counts(c).items():
            best[a] = max(n, best.get(a, 0))
    best_of = np.zeros(max(best, default=0) + 1, np.int64)
    best_of[list(best)] = list(best.values())
    for i, first in enumerate(sent):
        pair_hash = PairHash(first, buckets, tables.filter(F.col("bucket").between(first, first + SLICE - 1)).collect())
        vectors = {r.bucket: r.vector for r in counted[i].select("bucket", "vector").collect()}
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(vectors[b], np.int64) for b in sorted(vectors))])
        model = spark.sparkContext.broadcast(Counts(pair_hash, counts, best_of, uuid.uuid4().hex))
        df = look_up(written(df, "align-slice") if i else df, text, byte_file, piece_file, model, i > 0)
    return df
