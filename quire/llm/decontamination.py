"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all test items, over words, reads a document word by word and
carries the longest suffix of what it has read that occurs in some item. Where
that length reaches the window (13 words, or a whole shorter item) the matched
words are hit. Documents over the coverage limit are contaminated; the spans can
be cut from the text.

Items are normalised like documents: A-Z in lower case, words of letters, digits
and non-ASCII characters. An automaton is built from at most ``block_words`` item
words: a larger benchmark is split by a hash of item_id into blocks, the documents
run through one automaton after another, and the spans are united, so what is
sent to the executors has a fixed bound.

Defined cases: a null text has no words and no hits; items without words match
nothing; repeated items and rows count as themselves (item ids once); an empty
benchmark leaves all documents clean. Other columns are kept; an input column
named like an output column is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow_ops import add_columns, col, lower_ascii, lowered

#: words of normalised text: runs of digits, letters and non-ASCII characters
TEST_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = re.compile(TEST_WORD)
OUT = ("n_words", "n_hit", "item_ids", "spans", "contaminated", "clean_text")


class SuffixAutomaton:
    """Of several word sequences. ``window`` words of an item make a window; an item
    with fewer is one window itself."""

    def __init__(self, items: Iterable[tuple[str, Sequence[str]]], window: int = 13):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.words: dict[str, int] = {}
        coded = []
        for item_id, words in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in words]
            if ids:
                coded.append((item_id, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self._mark(coded)

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the strings of ``q`` no longer than those of ``p`` plus ``c``."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # an earlier item has this string
            return self._split(last, self.next[last][c], c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """Which items have a window that ends in a state: at ``window`` words by the
        state on its suffix path that holds strings of that length, and for shorter
        items by the states of the whole items."""
        k, n = self.window, len(self.next)
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        self.at_window, self.short = [-1] * n, [-1] * n  # nearest marked state on the suffix path
        self.items: dict[int, set[str]] = {}
        whole: dict[int, tuple[int, set[str]]] = {}  # state of a short item: its words, its ids
        for item_id, ids in coded:
            if len(ids) < k:
                state = 0
                for c in ids:
                    state = self.next[state][c]
                whole.setdefault(state, (len(ids), set()))[1].add(item_id)
        for s in by_length:
            up = self.link[s]
            self.short[s] = s if s in whole else self.short[up]
            if self.length[s] >= k:
                self.at_window[s] = s if self.length[up] < k else self.at_window[up]
        self.whole = whole
        for item_id, ids in coded:
            if len(ids) >= k:
                for end, state, length in self._walk(ids):
                    if length >= k:
                        self.items.setdefault(self.at_window[state], set()).add(item_id)

    def _walk(self, ids: Sequence[int]):
        """(end, state, matched length) after each word."""
        arcs, link, lengths = self.next, self.link, self.length
        state = length = 0
        for end, c in enumerate(ids, 1):
            to = arcs[state].get(c)
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = arcs[state].get(c)
            if to is None:
                length = 0
            else:
                state = to
                length += 1
            yield end, state, length

    def match(self, words: Sequence[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (start, stop), in order and apart, and the items hit."""
        known = self.words.get
        arcs, link, lengths, at_window, short, k = self.next, self.link, self.length, self.at_window, self.short, self.window
        spans: list[list[int]] = []
        items: set[str] = set()
        seen: set[int] = set()
        state = length = 0
        for end, w in enumerate(words, 1):
            c = known(w)
            if c is None:
                state = length = 0
                continue
            to = arcs[state].get(c)
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = arcs[state].get(c)
            if to is None:
                length = 0
                continue
            state = to
            length += 1
            reach = 0
            if length >= k:
                reach = length
                seen.add(at_window[state])
            mark = short[state]
            while mark != -1:
                size, ids = self.whole[mark]
                if size <= length:
                    reach = max(reach, size)
                    items |= ids
                mark = short[link[mark]]
            if reach:
                start = end - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, end])
        for s in seen:
            items |= self.items[s]
        return [tuple(s) for s in spans], items


def normal(text: F.Column) -> F.Column:
    return lower_ascii(text.cast("string"))




def cut(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in _WORDS.finditer(lowered(text))]
    parts, done = [], 0
    for start, stop in spans:
        parts.append(text[done : at[start][0]])
        done = at[stop - 1][1]
    return "".join([*parts, text[done:]])


def _pass(df: DataFrame, text: str, items: list[tuple[str, list[str]]], window: int, before: bool, finish: tuple[int, int] | None) -> DataFrame:
    """One automaton over all documents: adds its spans and items to those before it;
    ``finish``, the coverage limit as a fraction, makes the verdict in the last pass."""
    sent = df.sparkSession.sparkContext.broadcast(items)
    ddl = "_spans array<struct<start: int, stop: int>>, _items array<string>"
    if finish:
        ddl = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, stop: int>>, contaminated boolean, clean_text string"

    def make():
        automaton = SuffixAutomaton(sent.value, window)

        def compute(array, *earlier):
            rows = []
            known = zip(*(e.to_pylist() for e in earlier), strict=True) if earlier else None
            for value in array.to_pylist():
                value = value or ""
                words = _WORDS.findall(lowered(value))
                spans, found = automaton.match(words)
                if known is not None:
                    old_spans, old_items = next(known)
                    spans = united([*spans, *((s["start"], s["stop"]) for s in old_spans)])
                    found |= set(old_items)
                listed = [{"start": a, "stop": b} for a, b in spans]
                if not finish:
                    rows.append((listed, sorted(found)))
                    continue
                n_hit = sum(b - a for a, b in spans)
                over = n_hit > 0 and n_hit * finish[1] >= finish[0] * len(words)
                rows.append((len(words), n_hit, sorted(found), listed, over, cut(value, spans)))
            return list(zip(*rows, strict=True))

        return compute

    return add_columns(df, [col(text).cast("string"), *([F.col("_spans"), F.col("_items")] if before else [])], ddl, make)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13,
    limit: tuple[int, int] = (1, 20), block_words: int = 2_000_000,
) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted as strings), spans of hit words,
    contaminated (n_hit / n_words at or over ``limit``) and clean_text, the text
    without the spans."""
    items = benchmark.select(
        F.coalesce(col(item).cast("string"), F.lit("null")).alias("id"),
        F.regexp_extract_all(F.coalesce(normal(col(item_text)), F.lit("")), F.lit(f"({TEST_WORD})"), 1).alias("words"),
    ).filter(F.size("words") > 0)
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    out = docs
    for b in range(blocks):  # one block unless the benchmark is larger than an automaton may be
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows = [(r["id"], r["words"]) for r in part.collect()]
        out = _pass(out, text, rows, window, b > 0, limit if b == blocks - 1 else None)
    return out.drop("_spans", "_items")
