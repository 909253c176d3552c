"""Quality rules as a short-circuit cascade.

Each rule is a test on one text. On a bounded random sample (``sample_rows`` texts)
every rule is run and timed: its cost is seconds a text and its selectivity the share of texts it rejects.
Rules then run in order of rejection per cost, and a text stops at the first rule
that rejects it. The order changes the work, never the verdict.

Defined cases: a null text has no words and fails ``few_words``; repeated rows
are judged alike; an empty table, or one without text, keeps the given order.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow_ops import WORD, add_columns, col, texts

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[^\W\d_a-z]")


class Text:
    """A text and its counts; each is made when a rule first asks for it."""

    def __init__(self, text: str):
        self.text = text
        self.words = _WORDS.findall(text)
        self.made: dict[str, int] = {}

    def get(self, name: str) -> int:
        if name not in self.made:
            self.made[name] = COUNTS[name](self)
        return self.made[name]


def repeated_words(words: Sequence[str]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(index) + ids[1:]
    if len(index) >= 1 << 20:  # keeps the window code below 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, count = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    again = count[where] >= 2
    hit = np.zeros(n, bool)
    for shift in range(3):
        hit[shift : shift + n - 2] |= again
    return int(hit.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(lines) - len(set(lines))


COUNTS: dict[str, Callable[[Text], int]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: sum(map(len, t.words)),
    "n_symbols": lambda t: len(_SYMBOLS.findall(t.text)),
    "n_lines": lambda t: sum(1 for x in t.text.split("\n") if _WORDS.search(x)),
    "n_dup_lines": lambda t: duplicate_lines(t.text),
    "n_repeat_words": lambda t: repeated_words(t.words),
    "n_upper": lambda t: sum(1 for c in t.text if c.isupper()),
    "n_letters": lambda t: sum(1 for c in t.text if c.isalpha()),
    "n_bangs": lambda t: t.text.count("!!"),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``left * counts[0] > right * counts[1]`` (1 for no second
    count): ratios as whole numbers, so that there is no rounding."""

    name: str
    left: int
    count: str
    right: int
    other: str | None = None
    negate: bool = False

    def rejects(self, t: Text) -> bool:
        a, b = self.left * t.get(self.count), self.right * (t.get(self.other) if self.other else 1)
        return a < b if self.negate else a > b


BASE = (Rule("few_words", 1, "n_words", 50, negate=True), Rule("repeated_windows", 100, "n_repeat_words", 50, "n_words"))
RULES = (
    *BASE,
    Rule("symbols", 10, "n_symbols", 1, "n_words"),  # more than one symbol in ten words
    Rule("short_words", 1, "word_chars", 2, "n_words", negate=True),  # words shorter than 2 on average
    Rule("long_words", 1, "word_chars", 20, "n_words"),  # longer than 20
    Rule("duplicate_lines", 10, "n_dup_lines", 3, "n_lines"),  # three lines in ten seen before
    Rule("shouting", 2, "n_upper", 1, "n_letters"),  # more than half of the letters are capitals
    Rule("bangs", 10, "n_bangs", 1, "n_words"),  # "!!" at more than one word in ten
)


def plan_order(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 512) -> list[Rule]:
    """The rules by rejection per cost, measured on the sample in a Spark task. Rows are drawn
    at a rate that leaves about four times the sample, whatever the number of partitions."""
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rate = 4 * sample_rows / max(df.count(), 1)
    drawn = df.select(body.alias("text"))
    if rate < 1:
        drawn = drawn.filter(F.rand(11) < rate)
    sample = drawn.orderBy(F.rand(7)).limit(sample_rows)

    def measure(batches):
        spent, rejected, n = np.zeros(len(rules)), np.zeros(len(rules)), 0
        for frame in batches:
            for value in frame["text"]:
                n += 1
                for i, rule in enumerate(rules):
                    fresh = Text(value)
                    start = time.perf_counter()
                    rejected[i] += rule.rejects(fresh)
                    spent[i] += time.perf_counter() - start
        import pandas as pd  # noqa: PLC0415

        yield pd.DataFrame({"rule": np.arange(len(rules)), "spent": spent, "rejected": rejected, "n": np.full(len(rules), n)})

    found = sample.mapInPandas(measure, "rule long, spent double, rejected double, n long").groupBy("rule").agg(
        F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected")
    )
    gain = {r["rule"]: r["rejected"] / max(r["spent"], 1e-9) for r in found.collect()}  # a row per rule
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i))]


def apply_rules(
    df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, counts: Sequence[str] = (), sample_rows: int = 512
) -> DataFrame:
    """``df`` with ``kept``, ``failed_rule`` (the first that rejected, null if none),
    ``n_rules_run`` and the ``counts`` asked for, which are made for every row."""
    order = plan_order(df, text, rules, sample_rows)
    ddl = ", ".join(["kept boolean", "failed_rule string", "n_rules_run int", *(f"{c} long" for c in counts)])

    def make():
        def compute(array):
            rows = []
            for value in texts(array):
                t, failed, run = Text(value), None, 0
                for rule in order:
                    run += 1
                    if rule.rejects(t):
                        failed = rule.name
                        break
                rows.append((failed is None, failed, run, *(t.get(c) for c in counts)))
            return list(zip(*rows, strict=True)) if rows else [[] for _ in range(3 + len(counts))]

        return compute

    return add_columns(df, [col(text).cast("string")], ddl, make)
