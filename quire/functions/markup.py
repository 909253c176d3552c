"""HTML blocks and positioned text to Markdown: the per-cell helpers.

Both are order-dependent walks over one page (a tag stack, a row assignment), so
they are small Python functions called from Arrow-batched UDFs; everything
around them (filters, sorting, metrics, joins) stays in DataFrame expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from html.parser import HTMLParser

import numpy as np

from quire import fixed_values as fv

VOID = frozenset("area base basefont br col command embed frame hr img input isindex keygen link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
IMPLIED_END = {
    **{tag: {"p"} for tag in CLOSES_P},
    "li": {"li"}, "tr": {"tr", "th", "td"}, "th": {"th"}, "td": {"thead", "th", "td"},
    "dd": {"dt", "dd"}, "dt": {"dt", "dd"}, "option": {"option"}, "body": {"head", "link", "script"},
}
AROUND = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}


def strip(text: str) -> str:
    return text.strip(fv.WS_CHARS)


class _Frame:
    __slots__ = ("tag", "parts", "rows", "cells", "in_cell")

    def __init__(self, tag: str, in_cell: bool):
        self.tag, self.parts, self.rows, self.cells, self.in_cell = tag, [], [], [], in_cell


class BlockRenderer(HTMLParser):
    """Markdown built bottom-up: closing a tag turns its frame into text that is
    handed to the frame below."""

    def __init__(self, display_math: bool):
        super().__init__(convert_charrefs=True)
        self.display_math = display_math
        self.stack = [_Frame("", False)]
        self.formulas: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.stack[-1].tag in IMPLIED_END.get(tag, ()):
            self._close()
        if tag in VOID:
            if tag == "br":
                self.stack[-1].parts.append("\n")
            return
        frame = _Frame(tag, self.stack[-1].in_cell or tag in ("td", "th"))
        if tag == "tr":
            for table in (f for f in self.stack if f.tag == "table"):
                table.rows.append(frame.cells)
        self.stack.append(frame)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(f.tag == tag for f in self.stack[1:]):
            while self.stack[-1].tag != tag:
                self._close()
            self._close()
        elif tag == "p":
            self.stack[-1].parts.append("\n\n")
        elif tag == "br":
            self.stack[-1].parts.append("\n")

    def handle_data(self, data):
        self.stack[-1].parts.append(data)

    def finish(self, html: str) -> str:
        self.feed(html)
        self.close()
        while len(self.stack) > 1:
            self._close()
        return "".join(self.stack[0].parts)

    def _close(self):
        frame = self.stack.pop()
        inner = "".join(frame.parts)
        below = self.stack[-1]
        if frame.tag in ("td", "th") and below.tag == "tr":
            below.cells.append(strip(inner).replace("|", "\\|"))
        # inside a formula only its text counts
        below.parts.append(inner if any(f.tag == "math" for f in self.stack) else self._render(frame, inner))

    def _render(self, frame: _Frame, inner: str) -> str:
        tag, cut = frame.tag, strip(inner)
        if tag == "math":
            self.formulas.append(cut)
            display = self.display_math and not frame.in_cell
            return "" if not cut else f"\n$${cut}$$\n" if display else f"${cut}$"
        if tag == "table":
            return _table(frame.rows)
        if tag in AROUND:
            return f"{AROUND[tag]}{cut}{AROUND[tag]}"
        if tag in ("sup", "sub"):
            return f"<{tag}>{cut}</{tag}>"
        if tag == "li":
            return f"- {cut}\n"
        if re.fullmatch("h[1-6]", tag):
            return f"### {cut}\n\n"
        return f"{cut}\n\n" if tag in ("p", "div", "section", "ul", "ol") else inner


def _table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(len(r) for r in rows)
    line = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |\n"
    return line(rows[0]) + line(["---"] * width) + "".join(line(r) for r in rows[1:])


def html_to_markdown(html: str, display_math: bool = False) -> tuple[str, bool]:
    """(Markdown, whether a formula got lost on the way)."""
    renderer = BlockRenderer(display_math)
    text = renderer.finish(html)
    text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", text))
    text = strip(re.sub(r"\n{3,}", "\n\n", text))
    return text, any(f and f not in text for f in renderer.formulas)


# ---- positioned text ------------------------------------------------------

_BULLET = re.compile(r"^[•●▪◦]\s*")
_NUMBER = re.compile(r"^(\d+)[.)]\s+", re.ASCII)
_ESCAPE = re.compile(r"([\\`*_{}\[\]<>])")
_SPACES = re.compile("[" + re.escape(fv.WS_CHARS) + "]+")


def _rows(y: Sequence[float], tolerance: Sequence[float], order: Sequence[int]) -> list[np.ndarray]:
    """Runs, from the top, to rows of run numbers; stretches of one height and tolerance
    go together. The rows' first heights fall from row to row, so the topmost
    row within a stretch's tolerance is found by bisection; mostly it is the last one."""
    rows: list[list[np.ndarray]] = []
    heights: list[float] = []  # negated: rising
    order = np.asarray(order)
    ys, ts = np.asarray(y, np.float64)[order], np.asarray(tolerance, np.float64)[order]
    starts = np.concatenate([[0], np.flatnonzero((ys[1:] != ys[:-1]) | (ts[1:] != ts[:-1])) + 1, [len(order)]]).tolist()
    for a, b in zip(starts, starts[1:]):
        top = float(ys[a])
        reach = -(top + float(ts[a]))
        if not heights or heights[-1] < reach:
            rows.append([order[a:b]])
            heights.append(-top)
        elif len(heights) == 1 or heights[-2] < reach:
            rows[-1].append(order[a:b])
        else:
            rows[bisect_left(heights, reach)].append(order[a:b])
    return [row[0] if len(row) == 1 else np.concatenate(row) for row in rows]


def lines_to_markdown(words: Sequence[str], x: Sequence[float], y: Sequence[float], width: Sequence[float], size: Sequence[float]) -> str:
    """Positioned text runs of one page to Markdown: size decides headings, marks
    decide lists, gaps decide paragraphs."""
    if not len(words):
        return ""
    x, y, width, size = (np.asarray(c, np.float64) for c in (x, y, width, size))
    sizes = np.sort(size[size > 3])
    body = float(sizes[len(sizes) // 2]) if len(sizes) else fv.BODY_SIZE_DEFAULT
    tolerance = np.maximum(fv.ROW_TOLERANCE, size * fv.ROW_TOLERANCE_RATIO)
    rows = _rows(y, tolerance, np.lexsort((x, -y)))
    tops, counts = y[[row[0] for row in rows]].tolist(), [len(row) for row in rows]
    placed = np.concatenate(rows)
    placed = placed[np.lexsort((x[placed], np.repeat(np.arange(len(rows)), counts)))]
    ends = x[placed] + width[placed]
    spaced = [False, *(x[placed[1:]] - ends[:-1] > tolerance[placed[1:]]).tolist()]
    pieces_of = [f" {words[i]}" if gap else words[i] for i, gap in zip(placed.tolist(), spaced)]
    row_sizes = size[placed].tolist()
    # most pages have neither marks to escape nor white space inside a run
    every = "".join(words)
    marked, loose = bool(_ESCAPE.search(every)), bool(_SPACES.search(every))
    blocks: list[list[str]] = []  # pieces of each block
    above, end = None, 0
    for count, first_y in zip(counts, tops):
        start, end = end, end + count
        parts = pieces_of[start:end]
        parts[0] = words[placed[start]]
        text = "".join(parts)
        if marked:
            text = _ESCAPE.sub(r"\\\1", text)
        if loose:
            text = strip(_SPACES.sub(" ", text))
        if not text:
            continue
        mean, top = sum(row_sizes[start:end]) / count, first_y
        gap = 0 if above is None else above - top
        above = top
        number = _NUMBER.match(text)
        if mean > body * fv.HEADING_RATIO and len(text) < fv.HEADING_CHARS:
            blocks.append([f"### {text}"])
        elif mean > body * fv.SUBHEADING_RATIO and len(text) < fv.SUBHEADING_CHARS:
            blocks.append([f"#### {text}"])
        elif _BULLET.match(text):
            blocks.append(["- " + _BULLET.sub("", text)])
        elif number:
            blocks.append([f"{number[1]}. {text[number.end():]}"])
        elif blocks and blocks[-1][0][0] not in "#-" and gap < body * fv.PARAGRAPH_GAP:
            pieces = blocks[-1]
            if pieces[-1].endswith("-"):
                pieces[-1] = pieces[-1][:-1]
                pieces.append(text)
            else:
                pieces.append(f" {text}")
        else:
            blocks.append([text])
    return "\n\n".join(map("".join, blocks))


# ---- print chunks ---------------------------------------------------------

_SPACE_CLASS = re.escape(fv.WS_CHARS)
_BLANKS = re.escape(fv.WS_CHARS.replace("\n", ""))
#: a code fence from its opening line to the line that closes it, or to the end
_FENCED = re.compile(
    rf"^ {{0,3}}(?:(`{{3,}})|(~{{3,}}))[^\n]*(?:\n(?! {{0,3}}(?:\1`*|\2~*)[{_BLANKS}]*(?:\n|\Z))[^\n]*)*(?:\n[^\n]*)?", re.M)
_HEADING = re.compile(rf"^ {{0,3}}#{{1,6}}[{_SPACE_CLASS}]")


def print_chunks(markdown: str, target: int = fv.PRINT_CHUNK_BYTES) -> list[str]:
    """Cuts before a heading once a chunk has ``target`` bytes, or at a blank line
    once it has twice that; never inside a code fence or a ``$$`` block. Joined
    with line feeds the chunks are the text again.

    Lines where a cut may fall are flagged for the whole text; each cut is then looked up
    in the running byte counts of those lines."""
    lines = markdown.split("\n")
    starts = np.cumsum([0, *(len(line) + 1 for line in lines)])
    before = np.cumsum([0, *(len(line.encode()) + 1 for line in lines)])
    blank = np.array([not strip(line) for line in lines])
    fenced, inside = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    for m in _FENCED.finditer(markdown):
        a, b = np.searchsorted(starts, [m.start(), m.end()], "right") - 1
        fenced[a : b + 1], inside[a + 1 : b + 1] = True, True
    odd = np.array([line.count("$$") % 2 == 1 for line in lines]) & ~fenced
    free = ~inside & ((np.cumsum(odd) - odd) % 2 == 0)
    heads = np.flatnonzero(free & np.array([bool(_HEADING.match(line)) for line in lines]))
    gaps, text = np.flatnonzero(free & blank), np.flatnonzero(~blank)
    cuts = [0]
    while True:
        content = np.searchsorted(text, cuts[-1])
        if content == len(text):
            break
        # the first place of each kind behind the first line with text at which enough bytes have come together
        least = [np.searchsorted(at, text[content], "right") for at in (heads, gaps)]
        full = [np.searchsorted(before[at], before[cuts[-1]] + size) for at, size in ((heads, target), (gaps, 2 * target))]
        found = [at[max(x, y)] for at, x, y in zip((heads, gaps), least, full, strict=True) if max(x, y) < len(at)]
        if not found:
            break
        cuts.append(int(min(found)))
    if len(cuts) > 1 and not len(text[text >= cuts[-1]]):
        cuts.pop()  # only blank lines are left: they stay with the chunk before
    return ["\n".join(lines[a:b]) for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True)]
