"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: text between the borders of block elements, with the
chain of elements above it. Features are the tags and class or id words of these
ancestors and what the text looks like (length, links, punctuation, place). A
two-label chain over the blocks, content or not, is trained on labelled pages and
decoded by Viterbi; content blocks are joined by line ends.

No page carries labels, so ``fit`` labels pages by their markup where that is plain: a
bounded sample of pages with an ``<article>`` (or ``<main>``), whose blocks are content
unless they are in a menu, form, comment list and the like. Each sample page is also
rewritten in other markup (classes and ids instead of article, nav or footer; sidebars,
notices, forms and comments added from the page's own other blocks), with the labels
carried over, so that weights rest on many signs and not on one tag.

Defined cases: null or empty html, or a page without content, has the empty text;
scripts, styles, comments, head, hidden and embedded elements (``UNSEEN``) have no blocks, the text of math is kept; unclosed and
crossing tags are tolerated; repeated rows give equal texts; without a page to learn
from the weights are those of the built-in signs; an empty table gives no rows. Other
columns are kept; an input column named like an output column is replaced.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow_ops import add_columns, col, texts

# elements that start a new block; others stand inside one
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# elements whose content is no text of the page; those of RAW run to their own end tag, the others end at that of an element around them too
RAW = frozenset("script style textarea title".split())
UNSEEN = frozenset("head noscript template select iframe object svg canvas audio video".split())
# what may stand in a head; anything else ends it
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# an opening tag ends an open element of these kinds
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ATTR = r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>{_ATTR})>|<[!?/a-zA-Z][^>]*>", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>|(?=<body\b)", re.I) for name in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"(?:\A|;)\s*display\s*:\s*none\b", re.I)
_PART = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Block:
    text: str
    above: tuple[str, ...]  # features of the elements above, outermost first
    links: int  # characters of the text that are in links


def hides(attr: str) -> bool:
    """Whether the attributes of a tag hide the element: ``hidden`` itself (but for
    until-found), ``aria-hidden`` true, or a style without display."""
    if not _MAY_HIDE.search(attr):
        return False
    for name, value in _ATTRIBUTE.findall(attr):
        name, value = name.lower(), html.unescape(value.strip("\"'")).strip()
        if name == "hidden" and value.lower() != "until-found":
            return True
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order, with decoded text and single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = [0, 0]  # open <a>, characters in them
    hidden = 0

    unseen = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text and not hidden:
                out.append(Block(text, tuple(f for _, fs in stack for f in fs), links[1]))
            parts.clear()
        links[1] = 0

    def pop() -> None:
        nonlocal hidden, unseen
        name, fs = stack.pop()
        hidden -= "hidden" in fs
        unseen -= name in UNSEEN

    def put(start: int, stop: int) -> None:
        if stack and stack[-1][0] == "head" and not page[start:stop].isspace():
            pop()
        if not unseen:
            parts.append(page[start:stop])
            links[1] += (stop - start) * (links[0] > 0)

    def leave(name: str) -> None:
        """Ends the innermost element of this name and all in it, if there is one."""
        if not any(n == name for n, _ in stack):
            return
        if unseen:  # what was read before the unseen element has the elements around that above it
            first = next(i for i, (n, _) in enumerate(stack) if n in UNSEEN)
            at = max(i for i, (n, _) in enumerate(stack) if n == name)
            while len(stack) > max(first, at):
                pop()
            if at >= first:
                return
            flush()
        while stack[-1][0] != name:
            pop()
        pop()

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            put(at, m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        closed = m["attr"].endswith("/")
        if stack and stack[-1][0] == "head" and not m["end"] and name not in IN_HEAD:
            pop()
        if name in RAW:
            if not m["end"] and not (closed and any(n == "svg" for n, _ in stack)):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
        elif name in UNSEEN:
            if m["end"]:
                leave(name)
            elif not closed:
                stack.append((name, ()))
                unseen += 1
        elif name in BLOCK:
            if m["end"]:
                if not unseen:
                    flush()
                leave(name)
            elif name not in VOID:
                while unseen and name == "body":
                    pop()
                if not unseen:
                    flush()
                ends = CLOSES.get(name) or ({"p"} if name not in ("html", "body") else ())
                while stack and stack[-1][0] in ends:
                    pop()
                attr = m["attr"]
                fs = [f"tag={name}"]
                if attr:
                    for value in _NAMES.findall(attr):
                        fs += [f"name={w.lower()}" for w in _PART.findall(_CAMEL.sub(" ", value))]
                    if hides(attr):
                        fs.append("hidden")
                        hidden += 1
                stack.append((name, tuple(fs)))
            elif not unseen:
                flush()
        elif unseen:
            continue
        elif name == "a":
            links[0] = 0 if m["end"] else 1
        elif name in ("br", "button", "label", "option", "input"):
            parts.append(" ")
    if at < len(page):
        put(at, len(page))
    while unseen:
        pop()
    flush()
    return out


def text_features(block: Block, i: int, n: int) -> list[str]:
    t = block.text
    words = t.count(" ") + 1
    share = min(1.0, block.links / max(1, len(t)))
    out = ["bias", f"words={min(6, words.bit_length())}", f"links={0 if not share else 1 if share < 0.5 else 2}"]
    out.append(f"end={'stop' if t[-1] in '.!?:;”\"»' else 'other'}")
    if "©" in t or "copyright" in t[:200].lower():
        out.append("copyright")
    if t[:1].islower():
        out.append("lower")
    if i == 0:
        out.append("first")
    if i == n - 1:
        out.append("last")
    return out


def features(found: Sequence[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(found):
        leaf = next((f for f in reversed(b.above) if f.startswith("tag=")), "tag=none")
        out.append([*set(b.above), f"leaf{leaf}", *text_features(b, i, len(found))])
    return out


# words of tags, classes and ids that mark what is not the article, and what is
OUTSIDE = frozenset(
    "nav menu header footer aside sidebar ad ads advert advertisement banner promo sponsored cookie consent notice alert newsletter subscribe "
    "form login search comment comments reply share social related breadcrumb pagination widget popup modal dialog copyright toolbar legal".split()
)
INSIDE = frozenset("article main content post entry story body text".split())
# what the rewritten training pages use in place of plain elements
_ARTICLES = ("<main>", '<div class="content">', '<div id="main-content">', '<section class="post-body">', '<div class="entry-content">', '<div class="story">', '<article class="post">', '<div class="article-text">')
_MENUS = ('<div class="menu">', '<ul class="nav-bar">', '<div id="navigation">', '<header class="site-header">', "<nav>", '<div class="breadcrumb">', '<div role="navigation">')
_FOOTERS = ('<div class="footer">', '<div id="site-footer">', "<footer>", '<section class="copyright">', '<div class="legal">')
_EXTRAS = (
    '<aside>', '<aside class="sidebar">', '<div class="sidebar widget">', '<div class="cookie-notice">', '<div class="alert notice">', '<form action="/s">',
    '<div class="newsletter subscribe">', '<section id="comments">', '<div class="comment-list">', '<ol class="comments">', '<div class="reply">',
    '<div class="ad">', '<div class="advert banner">', '<div class="promo sponsored">', '<div class="related">', '<div class="share social">', '<header>',
    '<div id="popup" role="dialog">', '<div class="login">',
)


def marked(page: str) -> list[tuple[Block, int]] | None:
    """Blocks with labels by the page's own plain markup, None if it has none."""
    found = blocks(page)
    inside = [any(f in ("tag=article", "tag=main") for f in b.above) for b in found]
    if not any(inside):
        return None
    label = lambda b: int(not any(f.partition("=")[2] in OUTSIDE for f in b.above))
    return [(b, label(b) if x else 0) for b, x in zip(found, inside, strict=True)]


def _close(opening: str) -> str:
    return f"</{re.match('<([a-z0-9]+)', opening)[1]}>"


def rewritten(rows: Sequence[tuple[Block, int]], rng: random.Random) -> list[tuple[Block, int]]:
    """The page's blocks in other markup, labels carried over."""
    page: list[str] = []
    labels: list[int] = []

    def put(opening: str, items: Sequence[str], inner: str, label: int) -> None:
        close = f"</{inner}>" if inner else " "
        page.append(opening + "".join(f"<{inner}>{x}{close}" if inner else x for x in items) + _close(opening))
        labels.extend([label] * (len(items) if inner else bool(items)))

    esc = lambda b: html.escape(b.text, quote=False)
    body = [b for b, y in rows if y]
    rest = [b for b, y in rows if not y]
    links = [f'<a href="#">{esc(b)}</a>' for b in rest if b.links] or ['<a href="#">home</a>']
    other = [esc(b) for b in rest if not b.links] or ["all rights reserved"]
    extra = lambda: put(rng.choice(_EXTRAS), [rng.choice(other + [esc(b) for b in body[:3]])] * rng.choice((1, 1, 2)), "p", 0)
    page.append("<body>")
    if rng.random() < 0.8:
        put(rng.choice(_MENUS), links[:6], "li", 0)
    for _ in range(rng.randrange(3)):
        extra()
    opening = rng.choice(_ARTICLES)
    page.append(opening)
    for k, b in enumerate(body):
        tag = "h1" if k == 0 else rng.choice(("p", "p", "p", "p", "blockquote", "li", "h2", "pre", "div"))
        page.append(f"<{tag}>{esc(b)}</{tag}>")
        labels.append(1)
        if rng.random() < 0.1:
            extra()
    if rng.random() < 0.5:
        extra()
    page.append(_close(opening))
    for _ in range(rng.randrange(3)):
        extra()
    put(rng.choice(_FOOTERS), [rng.choice(other)], rng.choice(("p", "div")), 0)
    found = blocks("".join(page))
    return list(zip(found, labels, strict=True)) if len(found) == len(labels) else []


@dataclass(frozen=True)
class Chain:
    """Weights of features for label 1 against 0, and of label pairs."""

    weight: dict[str, float]
    pair: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, rows: Sequence[Sequence[str]]) -> list[int]:
        """The best label sequence (Viterbi)."""
        w = self.weight.get
        (p00, p01), (p10, p11) = self.pair
        a = b = 0.0
        back: list[tuple[int, int]] = []
        for i, row in enumerate(rows):
            s = 0.0
            for f in row:
                s += w(f, 0.0)
            if i:
                from0 = (0, a + p00) if a + p00 >= b + p10 else (1, b + p10)
                from1 = (0, a + p01) if a + p01 > b + p11 else (1, b + p11)
                back.append((from0[0], from1[0]))
                a, b = from0[1], from1[1] + s
            else:
                b = s
        out = [int(b > a)] if rows else []
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(sequences: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], steps: int = 200, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood with a ridge, by Adam on all sequences; forward and
    backward sums run over all sequences at once, padded to one length."""
    sequences = [s for s in sequences if s[1]]
    seen: dict[str, int] = {}
    for rows, _ in sequences:
        for row in rows:
            for f in row:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(f for f, n in seen.items() if n >= 3)}
    n, most = len(sequences), max((len(y) for _, y in sequences), default=0)
    if not n:
        return prior()
    mask, gold = np.zeros((n, most), bool), np.zeros((n, most), np.int64)
    cell, which = [], []
    for s, (rows, y) in enumerate(sequences):
        mask[s, : len(y)], gold[s, : len(y)] = True, y
        for t, row in enumerate(rows):
            for f in row:
                if f in index:
                    cell.append(s * most + t)
                    which.append(index[f])
    cell, which = np.array(cell), np.array(which)
    w, pair = np.zeros(len(index)), np.zeros((2, 2))
    m, v = np.zeros(len(index) + 4), np.zeros(len(index) + 4)
    both = mask[:, 1:] & mask[:, :-1]
    told = np.zeros((2, 2))
    np.add.at(told, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(1, steps + 1):
        score = np.bincount(cell, w[which], n * most).reshape(n, most)
        emit = np.stack([np.zeros_like(score), score], -1)
        forward = np.zeros((n, most, 2))
        forward[:, 0] = emit[:, 0]
        for t in range(1, most):
            go = np.logaddexp(forward[:, t - 1, :1] + pair[0], forward[:, t - 1, 1:] + pair[1]) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], go, forward[:, t - 1])
        backward = np.zeros((n, most, 2))
        expected = np.zeros((2, 2))
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(most - 2, -1, -1):
            ahead = emit[:, t + 1] + backward[:, t + 1]
            go = np.logaddexp(pair[:, 0] + ahead[:, :1], pair[:, 1] + ahead[:, 1:])
            live = mask[:, t + 1]
            backward[:, t] = np.where(live[:, None], go, backward[:, t + 1])
            joint = np.exp(forward[:, t, :, None] + pair + ahead[:, None, :] - norm[:, None, None])
            expected += joint[live].sum(0)
        chance = np.exp(forward[..., 1] + backward[..., 1] - norm[:, None]) * mask
        slope = np.bincount(which, ((gold * mask) - chance).ravel()[cell], len(index)) - ridge * n * w
        grad = np.concatenate([slope, (told - expected).ravel() - ridge * n * pair.ravel()]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, pair = w + move[:-4], pair + move[-4:].reshape(2, 2)
    return Chain({f: float(w[i]) for f, i in index.items()}, tuple(tuple(float(x) for x in row) for row in pair))


def prior() -> Chain:
    """Without training pages: the signs alone."""
    weight = {f"{kind}={w}": s for kind in ("tag", "name") for words, s in ((OUTSIDE, -4.0), (INSIDE, 1.0)) for w in words}
    return Chain({**weight, "tag=body": 0.0, "bias": 0.5, "links=2": -2.0}, ((0.5, -0.5), (-0.5, 0.5)))


def training_rows(page: str, seed: int, variants: int = 3) -> list[list[tuple[Block, int]]]:
    rows = marked(page)
    if not rows:
        return []
    rng = random.Random(seed)
    return [rows, *(r for r in (rewritten(rows[:60], rng) for _ in range(variants)) if r)]


def fit(pages: DataFrame, page: str = "html", sample_pages: int = 200, longest: int = 40_000) -> Chain:
    """A chain from ``sample_pages`` different pages of at most ``longest`` characters, those
    with the smallest hashes. The hashes are found first, then only their pages are fetched; this
    bounded sample comes to the driver."""
    chosen = pages.select(col(page).cast("string").alias("html")).filter((F.length("html") > 0) & (F.length("html") <= longest))
    chosen = chosen.filter(F.col("html").rlike("(?i)<(article|main)\\b")).withColumn("at", F.xxhash64("html"))
    least = [r[0] for r in chosen.select("at").distinct().orderBy("at").limit(sample_pages).collect()]
    chosen = chosen.filter(F.col("at") <= max(least, default=0)).groupBy("at").agg(F.min("html").alias("html")).orderBy("at")
    sequences, longest_chain = [], 80
    for number, row in enumerate(chosen.collect()):  # sample_pages rows of bounded size
        for rows in training_rows(row["html"], number):
            for start in range(0, len(rows), longest_chain):
                part = rows[start : start + longest_chain]
                sequences.append((features([b for b, _ in rows])[start : start + longest_chain], [y for _, y in part]))
    return train(sequences)


def main_text(chain: Chain, page: str) -> tuple[str, list[int]]:
    found = blocks(page)
    labels = chain.labels(features(found))
    return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y), labels


def extract(pages: DataFrame, chain: Chain, page: str = "html") -> DataFrame:
    """``pages`` with text, n_chars (its code points), n_blocks and n_content_blocks."""
    sent = pages.sparkSession.sparkContext.broadcast(chain)  # one weight for each kind of feature in the sample

    def make():
        chain = sent.value

        def compute(array):
            made = [main_text(chain, t) for t in texts(array)]
            return [t for t, _ in made], [len(t) for t, _ in made], [len(y) for _, y in made], [sum(y) for _, y in made]

        return compute

    return add_columns(pages, [col(page).cast("string")], "text string, n_chars long, n_blocks int, n_content_blocks int", make)
