"""Chat formatting in budgeted windows.

A conversation becomes one or more windows of whole turns. Prefix sums of the
turns' token counts choose each window's span: the first turn of the
conversation, if it is a system turn, stands in every window; then come up to
``history`` earlier turns, as far as they fit, repeated as context; then new
turns up to the budget. A new turn that alone exceeds the budget gets a window
of its own and ``over_budget`` is true: texts are never cut. The loss mask covers
assistant texts that are new in their window, so each is a target once.

Rows stream through a task in (conversation, turn) order; it holds one window's
turns and the history, never a whole conversation.

Defined cases: a null text or role is empty; a null conversation id is one
conversation of its own; turns with the same number are ordered by role, then
text; repeated rows are repeated turns; an empty table gives no windows. Other
input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow_ops import col

#: strings that steer chat models; a text that holds one is escaped
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(\\?)")
_TOKENS = re.compile(r"\w+|[^\w\s]")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)
#: tokens of the three marks of a turn
MARKS = 3

WINDOWS = (
    "conv_id long, window int, formatted string, loss array<struct<start: int, stop: int>>, "
    "n_context int, n_tokens int, over_budget boolean"
)


def escape(text: str) -> str:
    """Puts a backslash after the first character of each control string and
    doubles backslashes, so no control string is left and ``unescape`` undoes it."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def spans(sizes: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Spans of turns by the prefix sums of their sizes: as many as fit, one at least."""
    ends, out, start = np.concatenate([[0], np.cumsum(sizes)]), [], 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + room, "right")) - 1)
        out.append((start, stop))
        start = stop
    return out


def _render(turns: list[tuple[str, str]], n_context: int) -> tuple[str, list[dict]]:
    parts, at, loss = [], 0, []
    for i, (role, text) in enumerate(turns):
        head = f"<|turn|>{escape(role)}<|text|>"
        body = escape(text)
        if i >= n_context and role == "assistant" and body:
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        piece = f"{head}{body}<|end|>\n"
        parts.append(piece)
        at += len(piece)
    return "".join(parts), loss


class _Conversation:
    """Windows of one conversation, made while its turns arrive."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system, self.past, self.fresh, self.n, self.first = [], [], [], 0, True

    def _window(self, fresh: list) -> dict:
        room = self.budget - sum(t[2] for t in [*self.system, *fresh])
        context: list = []
        for turn in reversed(self.past):
            if turn[2] > room:
                break
            room -= turn[2]
            context.insert(0, turn)
        shown = [*self.system, *context, *fresh]
        # the system turn is new in the first window and context later; it is never a target
        n_context = len(context) + (len(self.system) if self.n else 0)
        formatted, loss = _render([t[:2] for t in shown], n_context)
        total = sum(t[2] for t in shown)
        out = {
            "conv_id": self.conv_id, "window": self.n, "formatted": formatted, "loss": loss, "n_context": n_context,
            "n_tokens": total, "over_budget": total > self.budget,
        }
        self.n += 1
        self.past = [*self.past, *fresh][-self.history :] if self.history else []
        return out

    def add(self, role: str, text: str) -> Iterator[dict]:
        turn = (role, text, len(_TOKENS.findall(escape(text))) + MARKS)
        if self.first and role == "system":
            self.system, self.first = [turn], False
            return
        self.first = False
        self.fresh.append(turn)
        room = self.budget - sum(t[2] for t in self.system)
        cut = spans(np.array([t[2] for t in self.fresh]), room)
        if len(cut) > 1:  # the new turn opens the next window
            yield self._window(self.fresh[: cut[0][1]])
            self.fresh = self.fresh[cut[0][1] :]

    def end(self) -> Iterator[dict]:
        if self.fresh or not self.n:
            yield self._window(self.fresh)


def format_windows(df: DataFrame, budget: int = 1024, history: int = 2) -> DataFrame:
    """One row per window of the conversations in ``df`` (conv_id, turn, role, text).

    ``loss`` has code point spans of ``formatted``; ``n_context`` turns at its
    start are repeated from earlier windows. Windows of a conversation stay in one
    partition, in order.
    """
    turns = df.select(
        col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"),
        F.coalesce(col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("conv_id", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("n_context", pa.int32()),
            ("n_tokens", pa.int32()), ("over_budget", pa.bool_()),
        ])
        now: _Conversation | None = None
        out: list[dict] = []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.extend(now.end())
                    now = _Conversation(conv_id, budget, history)
                out.extend(now.add(role, text))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if now is not None:
            out.extend(now.end())
        yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(run, WINDOWS)


def read_turns(formatted: str, n_context: int = 0) -> list[tuple[str, str]]:
    """The turns that are new in a window, read back from its formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)[n_context:]]


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation: what its formatted windows hold, as counts and digests.
    Takes ``format_windows`` output as it comes, in its partitions and order."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ddl.split(", ")]
        now, started, out = None, False, []
        n_turns = loss_chars = chars = n_windows = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def row() -> dict:
            return dict(zip(names, (now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows), strict=True))

        schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
        for batch in batches:
            for conv_id, window, formatted, spans_, n_context in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "window", "formatted", "loss", "n_context")), strict=True
            ):
                if window == 0:
                    if started:
                        out.append(row())
                    now, started = conv_id, True
                    n_turns = loss_chars = chars = n_windows = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                n_windows += 1
                chars += len(formatted)
                for role, text in read_turns(formatted, n_context):
                    n_turns += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in spans_:
                    target = unescape(formatted[span["start"] : span["stop"]])
                    loss_chars += len(target)
                    loss.update(target.encode())
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if started:
            out.append(row())
        yield pa.RecordBatch.from_pylist(out, schema)

    return windows.mapInArrow(run, ddl)
