"""Language model scores by a weighted backoff automaton.

Counts of all training tokens make a smoothed backoff model: words, then n-grams up to
``order``. Every n-gram of the training texts is kept with its count, at any count and
input size, in a table in the shared folder that grows with the corpus. An n-gram lies in
the bucket of its last but one word, and so does a place of a text that asks for it: the
n-grams of all lengths that end at a place, their contexts, and the weights of the failure
arcs between them are then together, and are made there from the counts. A word with more
than ``BUCKET`` tokens has many buckets, by the word before it: contexts of two words
stay whole, and the list of its followers is summed over the buckets and sent to each.
What a bucket needs of other words (counts of followers) is known for the frequent
words, and added up for the others by the bucket in which they are the last but one.

The frequent n-grams (``HOT`` of all training tokens, so at most 1 / ``HOT`` of each order)
are also sent to the executors: a place whose longest n-gram is among them takes its value
there. Which n-grams and words are sent changes where a value is looked up, never the value.

Rows that go to buckets are columns of word numbers of many n-grams, compressed. A frequent
word (at most ``WORDS``) is a number by its rank, any other 63 bits of a hash, salted until
no two words of the training texts share one. An unseen word has the number of a seen
one with a chance of (seen words) / 2^63.

A caller that wants a model of bounded size gives ``share``: n-grams are then kept only
where their words, their shorter n-grams and their own count reach that share of all
training tokens, and are the states of an automaton with failure arcs that is read
once, left to right; rare words are joined from the table of words and added.

Smoothing is absolute discounting: n1 / (n1 + 2 n2) for words, 0.75 for longer
n-grams. Unknown words share what the discount of the words leaves over; what the
discount leaves over in a context goes, by its backoff weight, to the words that have
no arc there.

Defined cases: a null or empty text has one token, the end; repeated rows count as
often as they stand there and score alike; with no training rows every word is
unknown, with probability 1; an empty table gives no rows. ``keep`` names the columns
that go with the scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.arrow_ops import add_columns, col, fields, slices, texts
from quire.session import written

#: the end of a text; no word has a space
END = b" "
#: words longer than this are looked up in the table, never in the automaton
LONG = 256
#: share of the training tokens that a word needs to be sent to the executors, and the most words that are
FAST, WORDS = 1e-8, 200_000
#: share of the training tokens from which n-grams are sent to the executors too, if not under ``FAST``
HOT = 1e-6
#: training tokens of a bucket, about
BUCKET = 1 << 19
#: characters of text that a task turns into rows at once
CHUNK = 4_000_000
#: what is taken off the count of an n-gram longer than a word
DISCOUNT = 0.75
#: the number of the places before a text; words have others
BEGIN = -1


def tokens(text: str) -> list[bytes]:
    """Words in UTF-8, A-Z in lower case, and the end. Bytes are split and lowered by
    ASCII alone: at 0x20 and 0x09 to 0x0D."""
    found = text.encode().lower().split()
    found.append(END)
    return found


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` characters of the first column, one row at least."""
    held: list[pa.RecordBatch] = []
    waiting = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0)
        for part in slices(batch, sizes.to_pylist(), most):
            held.append(part)
            waiting += pc.sum(pc.fill_null(pc.binary_length(part.column(0)), 0)).as_py() or 0
            if waiting > most // 2:
                whole, held, waiting = pa.concat_batches(held), [], 0
                yield whole
                del whole
                pa.default_memory_pool().release_unused()  # workers serve many tasks
    if held:
        yield pa.concat_batches(held)


def _split(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as ``tokens`` has them, without the ends, and their number in each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(array, "")))
    words, offsets = parts.flatten(), parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    at = before[offsets - offsets[0]]
    return words.filter(full), np.diff(at)


def count_words(train: DataFrame, text: str) -> DataFrame:
    """(word, n) of all training tokens, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in _chunks(batches, 4 * CHUNK):
            ends += batch.num_rows
            found = _split(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END.decode()]), pa.array([ends], pa.int64())], names=["word", "n"])

    found = train.select(col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def positions(ids: np.ndarray, levels: Sequence[np.ndarray], size: int) -> np.ndarray:
    """For each token the number of the kept n-gram, one word longer than there are
    ``levels``, that ends there, or -1. Level k has the sorted codes of kept n-grams:
    number of the first words' n-gram times ``size`` plus the last word's number."""
    at = ids
    for codes in levels:
        code = np.full(len(ids), -1, np.int64)
        code[1:] = np.where((at[:-1] >= 0) & (ids[1:] >= 0), at[:-1] * size + ids[1:], -1)
        where = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
        at = np.where((codes[where] == code) & (code >= 0), where, -1) if len(codes) else np.full(len(ids), -1)
    return at


def count_grams(train: DataFrame, text: str, words: list[bytes], levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and counts of the n-grams two words longer than ``levels`` is, that
    occur ``least`` times or more and whose parts are kept."""
    size = len(words)
    sent = train.sparkSession.sparkContext.broadcast((words, levels))  # at most 1 / share entries each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, shorter = sent.value
        number = _Numbers((w, i) for i, w in enumerate(listed)).__getitem__
        held: list[np.ndarray] = []
        waiting = 0

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            for value in texts(batch.column(0)):
                found = tokens(value)
                ids = np.fromiter(map(number, found), np.int64, len(found))
                part = positions(ids, shorter, size)
                ok = (part[:-1] >= 0) & (part[1:] >= 0)
                code = (part[:-1] * size + ids[1:])[ok]
                held.append(code)
                waiting += len(code)
                if waiting > 4_000_000:
                    yield out()
                    held.clear()
                    waiting = 0
        yield out()

    found = train.select(col(text).cast("string").alias("text")).mapInArrow(run, "code long, n long")
    rows = found.groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()  # tokens / least rows at most
    rows = rows.sort_values("code")
    return rows["code"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


@dataclass
class Automaton:
    """State 0 is the root; others are kept n-grams that have arcs. ``arcs`` has, at
    state * size + word, the log10 probability and the next state; ``weight`` and ``fail``
    are a state's failure arc, ``to_root`` the weights of all failure arcs to the root."""

    number: dict[bytes, int]
    root: list[float]
    after: list[int]
    size: int
    arcs: dict[int, tuple[float, int]] = field(default_factory=dict)
    weight: list[float] = field(default_factory=lambda: [0.0])
    fail: list[int] = field(default_factory=lambda: [0])
    to_root: list[float] = field(default_factory=lambda: [0.0])

    def read(self, words: Sequence, base: Sequence[float] | None = None) -> tuple[float, float, list]:
        """One traversal: the log10 probability but for the rare words' own, the sum of
        ``base`` over the words known here, and the rare words."""
        base = base if base is not None else self.root
        number, arcs, root, after, weight, fail, size = self.number.get, self.arcs.get, self.root, self.after, self.weight, self.fail, self.size
        total, state = 0.0, 0
        plain = 0.0
        rare: list = []
        for w in words:
            i = number(w)
            if i is None:
                total += self.to_root[state]
                state = 0
                rare.append(w)
                continue
            plain += base[i]
            while state:
                arc = arcs(state * size + i)
                if arc is not None:
                    total += arc[0]
                    state = arc[1]
                    break
                total += weight[state]
                state = fail[state]
            else:
                total += root[i]
                state = after[i]
        return total, plain, rare


def build(words: list, counts: np.ndarray, total: int, grams: list[tuple[np.ndarray, np.ndarray]], word_discount: float, gram_discount: float = 0.75) -> Automaton:
    size = max(1, len(words))
    prob = [(counts - word_discount) / max(1, total)]
    count, suffix = [counts], [np.full(len(counts), -1)]  # of an n-gram: the n-gram without its first word
    for k, (codes, n) in enumerate(grams, 1):
        head, last = codes // size, codes % size
        prob.append((n - gram_discount) / count[k - 1][head])
        tail = last if k == 1 else np.searchsorted(grams[k - 2][0], suffix[k - 1][head] * size + last)
        suffix.append(tail)
        count.append(n)
    state: list[np.ndarray] = []  # state number of each n-gram, 0 if it has no arcs
    made = 1
    for k in range(len(count)):
        own = np.zeros(len(count[k]), np.int64)
        if k < len(grams):
            heads = np.unique(grams[k][0] // size)
            own[heads] = np.arange(made, made + len(heads))
            made += len(heads)
        state.append(own)

    def longest(k: int, at: np.ndarray) -> np.ndarray:
        """The state of the longest suffix that is a state."""
        out = state[k][at].copy()
        while k and (out == 0).any():
            at, k = suffix[k][at], k - 1
            out = np.where(out == 0, state[k][at], out)
        return out

    a = Automaton({w: i for i, w in enumerate(words)}, np.log10(np.maximum(prob[0], 1e-300)).tolist(), longest(0, np.arange(len(words))).tolist(), size)
    for k, (codes, _) in enumerate(grams):
        heads, where = np.unique(codes // size, return_inverse=True)
        top = 1 - np.bincount(where, prob[k + 1], len(heads))
        low = 1 - np.bincount(where, prob[k][suffix[k + 1]], len(heads))
        weight = np.log10(np.maximum(top, 1e-12) / np.maximum(low, 1e-12))
        fail = np.zeros(len(heads), np.int64) if k == 0 else longest(k - 1, suffix[k][heads])
        # a shorter context that is no state has nothing to add: its weight would be 1
        a.weight.extend(weight.tolist())
        a.fail.extend(fail.tolist())
        a.to_root.extend((weight + np.array(a.to_root)[fail]).tolist())
        to = longest(k + 1, np.arange(len(codes)))
        keys = state[k][codes // size] * size + codes % size
        a.arcs.update(zip(keys.tolist(), zip(np.log10(prob[k + 1]).tolist(), to.tolist(), strict=True), strict=True))
    return a


class _Codes(dict):
    """Numbers of words: the frequent ones' places, of all others a hash below ``BEGIN``."""

    def __init__(self, words: Sequence[bytes], salt: int, most: int = 100_000):
        super().__init__((w, i) for i, w in enumerate(words))
        self.salt, self.most = salt.to_bytes(8, "little"), len(words) + most

    def __missing__(self, word: bytes) -> int:
        code = -2 - (int.from_bytes(blake2b(word, digest_size=8, salt=self.salt).digest(), "little") >> 1)
        if len(self) < self.most and len(word) <= LONG:  # memory of a worker; others are hashed again
            self[word] = code
        return code


def _names(order: int, length: int) -> list[str]:
    """Columns of the last ``length`` words of an n-gram of ``order`` words."""
    return [f"g{i}" for i in range(order - length, order)]


def _least(table: DataFrame, least: int) -> int:
    """The least count, ``least`` or more, that no more than ``WORDS`` words reach."""
    steps = table.filter(F.col("n") >= least).groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect()  # 65,536 rows at most
    held = 0
    for n, words in sorted(steps, reverse=True):
        held += words
        if held > WORDS:
            return n + 1 if n < 1 << 16 else max(least, table.agg(F.sum("n")).first()[0] // WORDS)
    return least


def word_codes(table: DataFrame, words: list[bytes]) -> tuple[int, DataFrame]:
    """A salt by which no two words of the table share a number, and (code, n)."""
    for salt in range(100):
        sent = table.sparkSession.sparkContext.broadcast((words, salt))  # at most WORDS words

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            number = _Codes(*sent.value, most=0).__getitem__
            for batch in batches:
                codes = [number(w.encode()) for w in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), batch.column(1)], names=["code", "n"])

        coded = _stored(table.select("word", "n").mapInArrow(run, "code long, n long"), "lm-codes")
        if coded.groupBy("code").count().filter("count > 1").isEmpty():
            return salt, coded
    raise RuntimeError("no salt tells all words apart")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``written``, after which Spark drops the shuffle files that only this needed."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df.select("*"), name)
    finally:
        conf.set(key, before)


# Rows of word numbers, many n-grams in each. In a row a number below ``first`` is that of a
# frequent word; the others count on through the row's own list of codes.

ROWS = "bucket int, kind int, chunk long, n int, rare int, blob binary"
GRAMS, LOWER, LOWS, PAIRS, SENT, ASKED, OWN, FOUND, WANTED = range(9)


def _blob(first: int, ids: np.ndarray, rare: np.ndarray, *more: np.ndarray) -> tuple[int, int, bytes]:
    """n, rare and blob of a row: columns of numbers, and more columns of 8 bytes."""
    ids = np.array(ids, np.uint32, order="C")
    far = ids >= first
    used = np.unique(ids[far])
    ids[far] = first + np.searchsorted(used, ids[far])
    planes = _planes(ids, 4)
    for m in more:  # counts are small, sums are not
        planes += _planes(m, 5) if m.dtype == np.int64 else [np.ascontiguousarray(m).tobytes()]
    return ids.shape[1], len(used), pa.compress(b"".join([*planes, rare[used.astype(np.int64) - first].tobytes()]), codec="zstd", asbytes=True)


def _planes(ids: np.ndarray, width: int) -> list[bytes]:
    """The lowest bytes of all numbers, then the next."""
    return [(ids >> (8 * k)).astype(np.uint8).tobytes() for k in range(width)]


def _joint(planes: np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k in range(width):
        if (plane := planes[k * n : (k + 1) * n]).any():
            out |= plane.astype(np.int64) << (8 * k)
    return out


def _unblob(row: dict, width: int, *kinds: type) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    n, rare = row["n"], row["rare"]
    sizes = [5 if kind is np.int64 else 8 for kind in kinds]
    whole = np.frombuffer(pa.decompress(row["blob"], decompressed_size=4 * width * n + n * sum(sizes) + 8 * rare, codec="zstd", asbytes=True), np.uint8)
    at = 4 * width * n
    ids, more = _joint(whole[:at], 4, width * n).reshape(width, n), []
    for kind, size in zip(kinds, sizes, strict=True):
        part = whole[at : at + size * n]
        more.append(_joint(part, 5, n) if kind is np.int64 else np.frombuffer(part.tobytes(), kind))
        at += size * n
    return ids, np.frombuffer(whole[at:].tobytes(), np.int64), more


def _one_list(first: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sorted list of all rare codes; the numbers in ``parts`` are changed to count through it."""
    rare = np.unique(np.concatenate([np.zeros(0, np.int64), *(r for _, r in parts)]))
    for ids, own in parts:
        far = np.nonzero(ids >= first)
        ids[far] = first + np.searchsorted(rare, own)[ids[far] - first]
    return rare


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in ROWS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that follow each other with the same value."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][column] != row[column]:
                yield held[0][column], held
                held = []
            held.append(row)
    if held:
        yield held[0][column], held


def _together(rows: DataFrame, column: str) -> DataFrame:
    return rows.repartition(column).sortWithinPartitions(column, "kind", "chunk")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Deal:
    """Which bucket an n-gram goes to; ``parts`` of each frequent word: its buckets."""

    buckets: int
    parts: np.ndarray

    def bucket(self, codes: np.ndarray, key: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        """``codes`` of all numbers; the numbers of the last but one words, and of those before."""
        mixed = _mixed(codes)
        found = (mixed % np.uint64(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int64)[key]
        if before is not None and (self.parts > 1).any():
            many = np.flatnonzero(self.of(key) > 1)
            part = self.part(mixed[key[many]], mixed[before[many]] % self.parts[key[many]].astype(np.uint64))
            found[many] = part % np.uint64(self.buckets)
        return found

    def of(self, key: np.ndarray) -> np.ndarray:
        return np.where(key < len(self.parts), np.append(self.parts, 1)[np.minimum(key, len(self.parts))], 1)

    @staticmethod
    def part(mixed: np.ndarray, part: np.ndarray) -> np.ndarray:
        return _mixed((mixed + part.astype(np.uint64)).view(np.int64))


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket, in their order."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by].astype(np.int64), prepend=-1))
    for start, end in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
        yield int(bucket[by[start]]), by[start:end]


def _numbered(codes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codes, and the list of the rare codes, of which ``BEGIN`` is the last."""
    rare = np.unique(np.append(codes[codes < 0], BEGIN))
    return np.where(codes < 0, first + np.searchsorted(rare, codes), codes), rare


def _read(array: pa.Array, number, first: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the tokens of all texts, ``before`` places before each, the rare codes, and how many tokens a text has."""
    words, lengths = _split(array)
    words = words.dictionary_encode()
    listed = [END, *words.dictionary.cast(pa.binary()).to_pylist()]
    own, rare = _numbered(np.fromiter(map(number, listed), np.int64, len(listed)), first)
    wide = lengths + before + 1
    start = np.cumsum(wide) - wide
    ids = np.full(int(wide.sum()), first + len(rare) - 1)
    at = np.repeat(start + before - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(words))
    ids[at] = own[1:][words.indices.to_numpy()]
    ids[start + wide - 1] = own[0]
    return ids, rare, lengths + 1


def _same(columns: Sequence[np.ndarray], size: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of different rows, sorted by the columns, and how often they are there (or sums of ``n``)."""
    at = columns[0]
    for i, column in enumerate(columns[1:], 1):
        at = at * size + column
        if i + 1 < len(columns) and len(at) and int(at.max()) >= (1 << 62) // size:
            at = np.unique(at, return_inverse=True)[1]
    if (np.diff(at) > 0).all():
        return np.arange(len(at)), np.ones(len(at), np.int64) if n is None else n
    by = np.argsort(at)
    cuts = np.flatnonzero(np.diff(at[by], prepend=-1))
    if n is None:
        return by[cuts], np.diff(cuts, append=len(by))
    return by[cuts], np.add.reduceat(n[by], cuts) if len(cuts) else n[:0]


def count_all(train: DataFrame, text: str, words: list[bytes], salt: int, order: int, deal: Deal) -> DataFrame:
    """Rows of n-grams of ``order`` words (three at least) with their counts in a part of the texts,
    one ending at each token but the first; ``BEGIN`` stands for the places before a text."""
    sent = train.sparkSession.sparkContext.broadcast((words, salt, deal))
    first = len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, salted, dealt = sent.value
        number = _Codes(listed, salted).__getitem__
        for batch in _chunks(batches, CHUNK):
            yield from out(*_read(batch.column(0), number, first, order - 1)[:2], dealt)

    def out(ids: np.ndarray, rare: np.ndarray, dealt: Deal) -> Iterator[pa.RecordBatch]:
        size = first + len(rare)
        begin = size - 1
        ends = np.flatnonzero(ids[1:] != begin) + 1
        ends = ends[ids[ends - 1] != begin]
        if not len(ends):
            return
        places = [ends - 1, *(ends - k for k in range(2, order)), ends]
        if size**order < 1 << 62:
            code = ids[places[0]]
            for place in places[1:]:
                code = code * size + ids[place]
            code, n = np.unique(code, return_counts=True)
            columns = []
            for _ in range(order):
                code, column = np.divmod(code, size)
                columns.append(column)
            last, *before, key = columns
            grams = np.stack([*before, key, last])
        else:
            grams = np.stack([ids[ends - order + 1 + k] for k in range(order)])
            at, n = _same([grams[-2], *grams[:-2][::-1], grams[-1]], size)
            grams = grams[:, at]
        bucket = dealt.bucket(np.concatenate([np.arange(first), rare]), grams[-2], grams[-3])
        yield _batch([(b, GRAMS, 0, *_blob(first, grams[:, rows], rare, n[rows].astype(np.int64))) for b, rows in _dealt(bucket)])

    return train.select(col(text).cast("string").alias("text")).mapInArrow(run, ROWS)


def gathered(counted: DataFrame, counts: np.ndarray, order: int, deal: Deal, least: int, d: float) -> DataFrame:
    """The rows of each bucket in one, and what other buckets and the driver are to know of it:
    LOWER and LOWS, words (rare, frequent) with the sums of the counts of their rare followers;
    PAIRS, pairs of a word with many buckets; SENT, the frequent n-grams (0 before short ones)."""
    sent = counted.sparkSession.sparkContext.broadcast((counts, deal))
    first = len(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dealt = sent.value
        for bucket, rows in _runs(batches, "bucket"):
            parts = [_unblob(r, order, np.int64) for r in rows]
            rare = _one_list(first, [p[:2] for p in parts])
            grams, n = np.concatenate([p[0] for p in parts], 1), np.concatenate([p[2][0] for p in parts])
            size = first + len(rare)
            at, n = _same([grams[-2], *grams[:-2][::-1], grams[-1]], size, n)
            grams = grams[:, at]
            out = [(bucket, GRAMS, 0, *_blob(first, grams, rare, n))]
            key, last = grams[-2], grams[-1]
            codes = np.concatenate([np.arange(first), rare])
            own = np.flatnonzero((key >= first) & (codes[grams[-3]] != BEGIN))  # a word before a rare word
            pairs, _ = _same([key[own], grams[-3][own]], size)
            out += lower(bucket, grams[-3][own][pairs], np.bincount(key, n, size)[key[own][pairs]], rare, size, dealt)
            many = dealt.of(key) > 1
            at, pair_n = _same([key, last], size, n)
            if many.any():
                some = many[at]
                out.append((bucket, PAIRS, 0, *_blob(first, grams[-2:, at[some]], rare, pair_n[some])))
            out += frequent(bucket, grams, n, at, pair_n, many, rare, size, codes)
            del rows, parts, grams, n, key, last, own, pairs, at, pair_n, many
            for row in out:
                yield _batch([row])
            del out
            pa.default_memory_pool().release_unused()

    def lower(bucket: int, word: np.ndarray, followed: np.ndarray, rare: np.ndarray, size: int, dealt: Deal) -> list[tuple]:
        sums = np.bincount(word, followed, size)
        words = np.unique(word)
        near, far = words[words < first], words[words >= first]
        out = [(bucket, LOWS, 0, *_blob(first, near[None], rare, sums[near]))] if len(near) else []
        if len(far):
            of = dealt.bucket(np.concatenate([np.arange(first), rare]), far, None)
            out += [(b, LOWER, 0, *_blob(first, far[None, rows], rare, sums[far[rows]])) for b, rows in _dealt(of)]
        return out

    def frequent(bucket: int, grams: np.ndarray, n: np.ndarray, at: np.ndarray, pair_n: np.ndarray, many: np.ndarray, rare: np.ndarray, size: int, codes: np.ndarray) -> list[tuple]:
        counts, _ = sent.value
        ok = (pair_n >= least) & ~many[at] & (grams[-2, at] < first) & (grams[-1, at] < first)
        found = grams[-2:, at[ok]]
        out = [(bucket, SENT, 2, *_blob(first, found, rare, np.log10((pair_n[ok] - DISCOUNT) / counts[found[0]])))]
        for j in range(3, order + 1):
            whole = np.flatnonzero(codes[grams[-j]] != BEGIN)
            own = grams[-j:, whole]
            place, count = _same([own[-2], *own[:-2][::-1], own[-1]], size, n[whole])
            own = own[:, place]
            start = np.any(np.diff(own[:-1], axis=1, prepend=-1) != 0, 0)
            context = np.cumsum(start) - 1
            ok = (count >= least) & (own < first).all(0)
            lp = np.log10((count[ok] - DISCOUNT) / np.bincount(context, count)[context[ok]])
            out.append((bucket, SENT, j, *_blob(first, own[:, ok], rare, lp)))
        return [r for r in out if r[3]]

    return _together(counted, "bucket").mapInArrow(run, ROWS)


def _flat(rows: DataFrame, first: int, width: int, extra: str) -> DataFrame:
    """(g0, ..., n) of rows, a row for each n-gram."""
    names = [f"g{i}" for i in range(width)]
    kind = np.float64 if extra == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, rare, (n,) = _unblob(row, width, kind)
                far = ids >= first
                ids[far] = rare[ids[far] - first]
                yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(n)], names=[*names, "n"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + f", n {extra}")


@dataclass
class Tables:
    """The whole model. ``rows`` has all n-grams by buckets, ``grams[j]`` (last j words, n) every n-gram
    of j words, ``codes`` (code, n) every word. ``words`` are the frequent words, ``lows`` the sums of
    the counts of their rare followers, ``levels`` the frequent n-grams as ``positions`` takes them,
    ``values`` the log-probabilities of both (bounded)."""

    order: int
    salt: int
    deal: Deal
    words: list[bytes]
    codes: DataFrame
    rows: DataFrame
    grams: dict[int, DataFrame]
    lows: np.ndarray
    levels: list[np.ndarray]
    values: list[np.ndarray]


def tabled(train: DataFrame, text: str, order: int, table: DataFrame, words: list[bytes], counts: np.ndarray, total: int, word_discount: float) -> Tables:
    salt, codes = word_codes(table, words)
    first, size = len(words), max(1, len(words))
    deal = Deal(total // BUCKET + 1, np.maximum(1, -(-counts // BUCKET)))
    least = max(2, math.ceil(max(FAST, HOT) * total))
    # what follows a word is known through the word before it: places of three words at least
    wide = max(3, order)
    rows = _stored(gathered(count_all(train, text, words, salt, wide, deal), counts, wide, deal, least, word_discount), "lm-grams")
    kind = {k: rows.filter(F.col("kind") == k) for k in (GRAMS, LOWER, LOWS, PAIRS, SENT)}
    flat = _flat(kind[GRAMS], first, wide, "long")
    grams = {}
    for j in range(2, order + 1):
        own = [f"g{i}" for i in range(wide - j, wide)]
        grams[j] = flat.filter(F.col(own[0]) != BEGIN).groupBy(*own).agg(F.sum("n").alias("n"))
    lows = np.zeros(first)
    sums = _flat(kind[LOWS], first, 1, "double").groupBy("g0").agg(F.sum("n").alias("n")).toPandas()  # frequent words: WORDS rows at most
    lows[sums["g0"].to_numpy(np.int64)] = sums["n"].to_numpy()
    pairs = kind[PAIRS].limit(0)
    hot = None
    if (deal.parts > 1).any():
        hot = _stored(_flat(kind[PAIRS], first, 2, "long").groupBy("g0", "g1").agg(F.sum("n").alias("n")), "lm-pairs")
        pairs = _to_parts(hot, counts, deal)
    made = Tables(order, salt, deal, words, codes, kind[GRAMS].unionByName(kind[LOWER]).unionByName(pairs), grams, lows, [], [])
    made.values.append(np.log10((counts - word_discount) / max(1, total)))
    for j in range(2, order + 1):
        sent = _flat(kind[SENT].filter(F.col("chunk") == j), first, j, "double").toPandas()  # total / least rows at most
        keys, lp = [sent[f"g{i}"].to_numpy(np.int64) for i in range(j)], sent["n"].to_numpy(np.float64)
        if hot is not None and j == 2:
            more = hot.filter((F.col("n") >= least) & (F.col("g0") >= 0) & (F.col("g1") >= 0)).toPandas()  # total / least rows at most
            own = [more[f"g{i}"].to_numpy(np.int64) for i in range(2)]
            keys = [np.concatenate(k) for k in zip(keys, own, strict=True)]
            lp = np.concatenate([lp, np.log10((more["n"].to_numpy(np.int64) - DISCOUNT) / counts[own[0]])])
        at = keys[0]
        for codes_, key in zip([*made.levels, None], keys[1:], strict=True):  # a frequent n-gram begins with a frequent one
            at = at * size + key
            at = at if codes_ is None else np.searchsorted(codes_, at)
        by = np.argsort(at)
        made.levels.append(at[by])
        made.values.append(lp[by])
    return made


def _to_parts(pairs: DataFrame, counts: np.ndarray, deal: Deal, most: int = 500_000) -> DataFrame:
    """PAIRS rows: each bucket of a word gets all its followers."""
    sent = pairs.sparkSession.sparkContext.broadcast(deal)
    first = len(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = sent.value
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > most:
                yield from out(held, dealt)
                held = []
        yield from out(held, dealt)

    def out(held: list[pa.RecordBatch], dealt: Deal) -> Iterator[pa.RecordBatch]:
        if not sum(map(len, held)):
            return
        key, last, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        last, rare = _numbered(last, first)
        for word in np.unique(key).tolist():
            own = np.flatnonzero(key == word)
            own = own[np.argsort(last[own])]
            row = _blob(first, np.stack([key[own], last[own]]), rare, n[own])
            parts = dealt.part(np.repeat(_mixed(np.array([word])), dealt.parts[word]), np.arange(dealt.parts[word]))
            for bucket in np.unique(parts % np.uint64(dealt.buckets)).tolist():
                yield _batch([(bucket, PAIRS, 0, *row)])

    return pairs.mapInArrow(run, ROWS)


@dataclass
class Model:
    """What is learnt: the tables of all n-grams, or the automaton of those that reach a
    share that the caller gave; counts of frequent words (bounded), and the table of all words."""

    automaton: Automaton | None
    counts: list[int]
    words: DataFrame
    total: int
    distinct: int
    word_discount: float
    tables: Tables | None = None

    @property
    def unknown(self) -> float:
        return math.log10(self.word_discount * self.distinct / self.total) if self.total else 0.0


def fit(train: DataFrame, text: str = "text", order: int = 3, share: float | None = None) -> Model:
    """The whole model, or with ``share`` one of bounded size."""
    table = written(count_words(train, text), "lm-words")
    one = table.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct"),
        F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"),
    ).first()
    total = int(one["total"])
    least = max(2, math.ceil((FAST if share is None else share) * total))
    d = min(max(one["n1"] / (one["n1"] + 2 * one["n2"]), 0.1), 0.9) if one["n1"] else 0.5
    if share is None:
        least = _least(table, least)
    frequent = table.filter(((F.col("n") >= least) & (F.length("word") <= LONG)) | ((F.col("word") == END.decode()) & F.lit(share is None))).toPandas()
    frequent = frequent.sort_values(["n", "word"], ascending=[False, True])  # WORDS, or total / least rows at most
    words, counts = [w.encode() for w in frequent["word"]], frequent["n"].to_numpy(np.int64)
    if share is None:
        return Model(None, counts.tolist(), table, total, int(one["distinct"]), d, tabled(train, text, order, table, words, counts, total, d))
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(2, order + 1):
        grams.append(count_grams(train, text, words, [g[0] for g in grams], least))
        if not len(grams[-1][0]):
            break
    return Model(build(words, counts, total, grams, d), counts.tolist(), table, total, int(one["distinct"]), d)


def _pruned(m: Model, docs: DataFrame):
    """``make`` for the automaton of bounded size."""
    sent = docs.sparkSession.sparkContext.broadcast((m.automaton, m.counts))  # at most 1 / share words and n-grams of each order
    below = math.log10(m.total + 0.5 * (m.distinct + 1))

    def make():
        automaton, counts = sent.value
        base = [math.log10(c + 0.5) - below for c in counts]

        def compute(array):
            rows = []
            for value in texts(array):
                words = tokens(value)
                total, plain, rare = automaton.read(words, base)
                rows.append((len(words), len(words) - len(rare), plain, total, rare))
            return list(zip(*rows, strict=True))

        return compute

    return make


def _places(m: Model, docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Rows of the places that are to be looked up, and for each part of the texts one row
    with the kept columns and what the executors have."""
    t = m.tables
    sent = docs.sparkSession.sparkContext.broadcast((t.words, t.salt, t.deal, m.counts, t.levels, t.values))  # at most WORDS words, 1 / HOT n-grams of each order
    below = math.log10(m.total + 0.5 * (m.distinct + 1))
    order, wide, first = t.order, max(3, t.order), len(t.words)
    names = [f"_keep_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext  # noqa: PLC0415

        words, salt, dealt, counts, levels, values = sent.value
        number = _Codes(words, salt).__getitem__
        base = np.log10(np.array(counts, np.float64) + 0.5) - below
        chunk = (TaskContext.get().partitionId() << 32) - 1

        def out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, rare, lengths = _read(batch.column(0), number, first, wide - 1)
            size = first + len(rare)
            begin = size - 1
            doc = np.repeat(np.arange(len(lengths)), lengths + wide - 1)
            ends = np.flatnonzero(ids != begin)
            best = np.full(len(ids), -np.inf)
            start = np.cumsum(lengths + wide - 1) - lengths
            known = ids < first
            near = np.where(known, ids, -1)
            # near the start of a text the longest n-gram is shorter
            at = near
            for k in range(order):
                if k:
                    shorter = at
                    at = np.full(len(ids), -1)
                    if len(levels[k - 1]):
                        rows = np.flatnonzero((shorter[:-1] >= 0) & (near[1:] >= 0)) + 1
                        at[rows] = _find(levels[k - 1], shorter[rows - 1] * first + ids[rows])
                here = start + k if k < order - 1 else ends
                if k < order - 1:
                    here = here[here < len(ids)]
                    here = here[doc[here] == doc[start[: len(here)]]]
                ok = here[at[here] >= 0]
                best[ok] = values[k][at[ok]]
            count = len(lengths)
            seen = np.isfinite(best)
            own = [np.bincount(doc[known], minlength=count), np.bincount(doc[known], base[ids[known]], count), np.bincount(doc[seen], best[seen], count)]
            batch = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lengths, pa.int64()), *map(pa.array, own)], names=[*names, "n", "known", "base", "score"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield _batch([(chunk % dealt.buckets, OWN, chunk, count, 0, sink.getvalue().to_pybytes())])
            # a rare word is looked up as the last but one, a frequent first word is known
            left = ends[~known[ends - 1] if order == 1 else ~seen[ends]]
            left = left[ids[left - 1] != begin]
            if not len(left):
                return
            grams = np.stack([ids[left - wide + 1 + k] for k in range(wide)])
            bucket = dealt.bucket(np.concatenate([np.arange(first), rare]), grams[-2], grams[-3])
            yield _batch([(b, ASKED, chunk, *_blob(first, grams[:, rows], rare, doc[left[rows]])) for b, rows in _dealt(bucket)])

        for batch in _chunks(batches, CHUNK):
            chunk += 1
            yield from out(batch)

    return docs.select(col(text).cast("string").alias("_text"), *(col(c).alias(n) for c, n in zip(keep, names, strict=True))).mapInArrow(run, ROWS)


class _Bucket:
    """All that the places of a bucket can ask for, made from its counts."""

    def __init__(self, order: int, size: int, begin: int, counts: np.ndarray, total: int, d: float, grams: np.ndarray, n: np.ndarray, many: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray, lows: np.ndarray):
        self.order, self.size = order, size
        first, key, last = len(counts), grams[-2], grams[-1]
        self.count = np.bincount(key, n, size)
        if order == 1:
            return
        own = np.flatnonzero(~many)
        at, m = _same([key[own], last[own]], size, n[own])
        codes, m = np.concatenate([key[own][at] * size + last[own][at], pairs[0] * size + pairs[1]]), np.concatenate([m, pair_n])
        by = np.argsort(codes, kind="stable")
        codes, m = codes[by], m[by]
        tail = codes % size
        followers = np.append(counts, 0)[np.minimum(tail, first)] - d  # of a rare follower the count is in ``lows``
        self.levels = [(None, *self.made(codes, m, np.bincount(codes // size, followers / max(1, total), size) + lows / max(1, total), size))]
        context = key
        for j in range(3, order + 1):
            whole = np.flatnonzero((grams[-j] != begin) & (context >= 0))
            code = context[whole] * size + grams[-j][whole]
            contexts = np.unique(code)
            here = np.searchsorted(contexts, code)
            context = np.full(len(n), -1)
            context[whole] = here
            at, m = _same([here, last[whole]], size, n[whole])
            codes = here[at] * size + last[whole][at]
            shorter, lp = self.levels[-1][1:3]
            low = 10 ** lp[np.searchsorted(shorter, contexts[codes // size] // size * size + codes % size)]
            self.levels.append((contexts, *self.made(codes, m, np.bincount(codes // size, low, len(contexts)), len(contexts))))

    def made(self, codes: np.ndarray, m: np.ndarray, low: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted codes of n-grams, their log-probabilities, and the weights of their contexts' failure arcs."""
        head = codes // self.size
        # every token but the end has a follower, so a context occurs as often as its n-grams
        c, kinds = np.bincount(head, m, contexts), np.bincount(head, minlength=contexts)
        weight = np.log10(np.maximum(DISCOUNT * kinds / np.maximum(c, 1), 1e-12) / np.maximum(1 - low, 1e-12))
        return codes, np.log10((m - DISCOUNT) / c[head]), np.where(c > 0, weight, 0)

    def read(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the log-probability, and whether that of the last word alone is to be added."""
        value, open_ = np.zeros(asked.shape[1]), np.ones(asked.shape[1], bool)
        if self.order == 1:
            return value, ~open_
        last, states = asked[-1], [asked[-2]]  # a word without followers has the weight 1
        for j, (contexts, *_) in enumerate(self.levels[1:], 3):
            code = np.where(states[-1] >= 0, states[-1] * self.size + asked[-j], -1)
            states.append(_find(contexts, code))
        for state, (_, codes, lp, weight) in zip(states[::-1], self.levels[::-1], strict=True):
            rows = np.flatnonzero(open_ & (state >= 0))
            at = _find(codes, state[rows] * self.size + last[rows])
            hit = at >= 0
            value[rows[hit]] += lp[at[hit]]
            open_[rows[hit]] = False
            value[rows[~hit]] += weight[state[rows[~hit]]]  # the failure arc
        return value, open_


def _find(codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(codes):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    return np.where(codes[at] == asked, at, -1)


#: no number is rare
PLAIN = (1 << 32) - 1


def _looked_up(m: Model, rows: DataFrame) -> DataFrame:
    """FOUND rows, sums for the texts of a part, WANTED rows, rare last words whose own
    probability is to be added, and the OWN rows as they are."""
    t = m.tables
    sent = rows.sparkSession.sparkContext.broadcast((np.array(m.counts, np.int64), t.deal, t.lows))
    order, wide, first, total, d, unknown = t.order, max(3, t.order), len(t.words), m.total, m.word_discount, m.unknown
    below = math.log10(total + 0.5 * (m.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, dealt, lows = sent.value
        words = np.log10((counts - d) / max(1, total))
        held: dict[int, list[np.ndarray]] = {}
        waiting = 0
        for _, rows in _runs(batches, "bucket"):
            for r in rows:
                if r["kind"] == OWN:
                    yield _batch([tuple(r.values())])
            asked = [(r["chunk"], *_unblob(r, wide, np.int64)) for r in rows if r["kind"] == ASKED]
            if not asked:
                continue
            grams = [_unblob(r, wide, np.int64) for r in rows if r["kind"] == GRAMS]
            lower = [_unblob(r, 1, np.float64) for r in rows if r["kind"] == LOWER]
            pairs = [_unblob(r, 2, np.int64) for r in rows if r["kind"] == PAIRS]
            rare = _one_list(first, [(a[-3], a[-2]) for a in asked] + [p[:2] for p in [*grams, *lower, *pairs]] + [(np.zeros((1, 0), np.int64), np.array([BEGIN]))])
            size, begin = first + len(rare), first + len(rare) - 1
            whole, n = _joined(grams, wide)
            known = np.concatenate([lows, np.zeros(len(rare))])
            for ids, _, (sums,) in lower:
                known[ids[0]] += sums
            made = _Bucket(order, size, begin, counts, total, d, whole, n, dealt.of(whole[-2]) > 1, *_joined(pairs, 2), known)
            for chunk, ids, _, (doc,) in asked:
                value, open_ = made.read(ids)
                near = open_ & (ids[-1] < first)
                value[near] += words[ids[-1][near]]
                far = np.flatnonzero(open_ & ~near)
                if len(far):
                    yield _batch([(0, WANTED, chunk, *_blob(PLAIN, doc[far][None], rare, rare[ids[-1][far] - first].view(np.uint64)))])
                own = np.flatnonzero(ids[-2] >= first)
                count = made.count[ids[-2][own]]
                alone = count if order == 1 else count[ids[-3][own] == begin]
                value[own if order == 1 else own[ids[-3][own] == begin]] += np.where(alone > 0, np.log10((np.maximum(alone, 1) - d) / max(1, total)), unknown)
                texts_ = int(doc.max()) + 1
                sums = np.stack([
                    np.bincount(doc), np.bincount(doc, value), np.bincount(doc[own], count > 0, texts_), np.bincount(doc[own], np.log10(count + 0.5) - below, texts_),
                ])
                if chunk in held:
                    short, long = sorted((held[chunk], sums), key=lambda s: s.shape[1])
                    long[:, : short.shape[1]] += short
                    waiting += long.shape[1] - held[chunk].shape[1]
                    held[chunk] = long
                else:
                    held[chunk] = sums
                    waiting += texts_
            del rows, asked, grams, lower, pairs, whole, n, known, made
            pa.default_memory_pool().release_unused()
            if waiting > 2_000_000:
                yield from out(held)
                held, waiting = {}, 0
        yield from out(held)

    def out(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for chunk, sums in held.items():
            doc = np.flatnonzero(sums[0])
            yield _batch([(0, FOUND, chunk, *_blob(PLAIN, doc[None], doc, *sums[1:, doc]))])

    return _together(rows, "bucket").mapInArrow(run, ROWS)


def _joined(parts: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros((width, 0), np.int64), *(p[0] for p in parts)], 1), np.concatenate([np.zeros(0, np.int64), *(p[2][0] for p in parts)])


def _alone(m: Model, wanted: DataFrame) -> DataFrame:
    """FOUND rows with the probabilities of rare words alone, joined from the table of words."""
    total, d, unknown = max(1, m.total), m.word_discount, m.unknown

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, (code,) = _unblob(row, 1, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(np.full(len(code), row["chunk"])), pa.array(ids[0])], names=["code", "chunk", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, doc, lp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for c in np.unique(chunk).tolist():
                own = doc[chunk == c]
                at = np.unique(own)
                sums = np.bincount(np.searchsorted(at, own), lp[chunk == c])
                yield _batch([(0, FOUND, c, *_blob(PLAIN, at[None], at, sums, np.zeros(len(at)), np.zeros(len(at))))])

    log = F.log10((F.col("n") - F.lit(d)) / F.lit(float(total)))
    found = wanted.mapInArrow(flat, "code long, chunk long, doc long").join(m.tables.codes, "code", "left")
    return found.select("chunk", "doc", F.coalesce(log, F.lit(unknown)).alias("lp")).mapInArrow(run, ROWS)


def _whole(m: Model, docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``score`` by the whole model."""
    found = _stored(_looked_up(m, m.tables.rows.unionByName(_places(m, docs, text, keep))), "lm-found")
    parts = found.filter(F.col("kind") != WANTED).unionByName(_alone(m, found.filter(F.col("kind") == WANTED)))
    schema = T.StructType([*(T.StructField(c, docs.select(col(c)).schema[0].dataType) for c in keep), *fields("n_tokens long, n_known long, base_score double, score double")])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "chunk"):
            own = next(r for r in rows if r["kind"] == OWN)
            batch = pa.ipc.open_stream(own["blob"]).read_next_batch()
            known, base, score = (batch.column(c).to_numpy().astype(np.float64) for c in ("known", "base", "score"))
            for row in rows:
                if row["kind"] == FOUND:
                    doc, _, more = _unblob(row, 1, np.float64, np.float64, np.float64)
                    for sums, part in zip((score, known, base), more, strict=True):
                        sums[doc[0]] += part
            arrays = [*batch.columns[: len(keep)], batch.column("n"), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, target, strict=True)], schema=target)

    return _together(parts, "chunk").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of ``docs`` with n_tokens, n_known (tokens seen in training),
    base_score (the add-a-half word model) and score, both log10 probabilities."""
    m = model
    if m.tables:
        return _whole(m, docs, text, keep)
    make = _pruned(m, docs)
    below = math.log10(m.total + 0.5 * (m.distinct + 1))
    numbered = docs.select(*(col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)), F.monotonically_increasing_id().alias("_row"), col(text).cast("string").alias("_text"))
    names = [f"_keep_{i}" for i in range(len(keep))]
    read = add_columns(numbered, [F.col("_text")], "_n long, _known long, _base double, _score double, _rare array<string>", make).drop("_text")
    # one row with the text's own sums, under a key of its own, and one for each rare word
    own = ["_n", "_known", "_base", "_score", *names]
    apart = read.select("_row", *own, F.posexplode(F.concat(F.array(F.concat(F.lit(" "), "_row")), "_rare")).alias("_at", "word"))
    apart = apart.select("_row", "word", *(F.when(F.col("_at") == 0, col(c)).alias(c) for c in own))
    first = F.col("_n").isNotNull()
    looked = apart.join(m.words, "word", "left")
    count = F.coalesce("n", F.lit(0))
    log_word = F.when(F.col("n").isNull(), F.lit(m.unknown)).otherwise(F.log10((F.col("n") - m.word_discount) / F.lit(float(max(1, m.total)))))
    parts = looked.select(
        "_row", *names, "_n", F.when(first, F.col("_known")).otherwise((count > 0).cast("long")).alias("_known"),
        F.when(first, F.col("_base")).otherwise(F.log10(count + 0.5) - below).alias("_base"),
        F.when(first, F.col("_score")).otherwise(log_word).alias("_score"),
    )
    summed = parts.groupBy("_row").agg(
        *(F.first(n, ignorenulls=True).alias(n) for n in names), F.sum("_n").alias("n_tokens"), F.sum("_known").alias("n_known"),
        F.sum("_base").alias("base_score"), F.sum("_score").alias("score"),
    )
    return summed.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "n_tokens", "n_known", "base_score", "score")
