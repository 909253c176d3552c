"""Markdown text expressions: metrics, cleanup, previews, titles, snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.base import js_trim, js_trim_end, js_trim_start, squash

# The formula pattern, shaped for a backtracking engine: the run between two
# dollars is taken possessively (a loop, where a plain group would recurse once
# per character), and a dollar behind a backslash closes only when the rest of the
# line holds no plain one. The matches are the same.
_RUN = r"(?:[^$\n\\]++|\\.|\\)++"
_FORMULA_JAVA = rf"\$\$[\s\S]*?\$\$|\${_RUN}\$|\$(?={_RUN}(?:\n|\z))[^\n]*\\\$"

_INLINE_JAVA = rf"(?:^|[^\\$])\$({_RUN}(?=\$)|(?={_RUN}(?:\n|\z))[^\n]*\\)\$"
#: the formula without the character before it
_INLINE_SPAN = _INLINE_JAVA.replace(r"(?:^|[^\\$])", r"(?<![\\$])", 1)


def count_formulas(md: Column) -> Column:
    return F.when(F.contains(md, F.lit("$")), F.regexp_count(md, F.lit(_FORMULA_JAVA))).otherwise(0)


def count_options(md: Column) -> Column:
    return F.regexp_count(md, F.lit(fv.OPTION))


def visible_length(md: Column) -> Column:
    return F.char_length(F.translate(md, fv.MARK_CHARS + fv.WS_CHARS, ""))


def escape_markdown(c: Column) -> Column:
    return js_trim(squash(F.regexp_replace(c, fv.ESCAPABLE, r"\\$1")))


def link_text(c: Column) -> Column:
    """Images and links reduced to their text."""
    return F.regexp_replace(F.regexp_replace(c, fv.IMAGE_MARKUP, "$1"), fv.LINK_MARKUP, "$1")


def tidy(c: Column) -> Column:
    return squash(F.regexp_replace(link_text(c), fv.SNIPPET_MARKS, " "))


def flat(c: Column) -> Column:
    """Like ``tidy`` but images vanish, links stay, and the ends are trimmed."""
    bare = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")
    return js_trim(squash(F.regexp_replace(bare, fv.SNIPPET_MARKS, " ")))


def plain(c: Column) -> Column:
    """Marks dropped, white space squashed, ends trimmed."""
    return js_trim(squash(F.regexp_replace(c, fv.PREVIEW_MARKS, "")))


def preview(md: Column) -> Column:
    """Opening of the body: own title, provenance, page headings, rules and
    empty-page notes are skipped. Lines are removed by anchored patterns, so the
    text is never cut into an array of lines."""
    text = F.coalesce(md, F.lit(""))
    gap = f"[{fv.WS_SET.replace(chr(92) + 'n', '', 1)}]"  # white space inside a line
    title = rf"(?dm)\A([\s\S]*?)^{gap}*#{gap}+[^{fv.WS_SET}][^\n]*$"
    own = "|".join([
        rf">{gap}*由[^，\n]*转换[^\n]*", rf"##{gap}+(?:PDF 第 [0-9]+ 页|第 [0-9]+ 张图){gap}*", rf"-{{3,}}{gap}*", rf"_\[[^\n]*\]_{gap}*",
    ])
    body = F.regexp_replace(F.regexp_replace(text, title, "$1"), rf"(?dm)^{gap}*(?:{own})$", "")
    return F.left(plain(link_text(body)), F.lit(fv.PREVIEW_LENGTH))


def card_content(md: Column) -> Column:
    """Text handed to a titling model; NULL when there is too little of it."""
    text = F.left(plain(F.coalesce(md, F.lit(""))), F.lit(fv.CARD_LENGTH))
    return F.when(F.char_length(text) >= fv.CARD_MINIMUM, text)


def strip_frontmatter(md: Column) -> Column:
    block = F.regexp_extract(md, fv.FRONTMATTER, 0)
    body = F.regexp_extract(md, fv.FRONTMATTER, 1)
    has_key = (block != "") & body.rlike(fv.FRONTMATTER_KEY)
    return F.when(has_key, F.substr(md, F.char_length(block) + 1)).otherwise(md)


def markdown_title(md: Column, fallback: Column) -> Column:
    heading = F.regexp_extract(strip_frontmatter(md), fv.FIRST_H1, 1)
    bare = F.regexp_replace(heading, fv.MARKDOWN_ESCAPE, "$1")
    found = js_trim(F.when(heading != "", bare).otherwise(fallback))
    return F.when(found == "", fallback).otherwise(found)


def formulas(md: Column) -> Column:
    """Display formulas, then the inline ones of the remaining text."""
    display = F.transform(F.regexp_extract_all(md, F.lit(fv.DISPLAY_FORMULA), F.lit(1)), js_trim)
    rest = F.regexp_replace(md, fv.DISPLAY_FORMULA, fv.FORMULA_STASH)
    inline = F.regexp_extract_all(rest, F.lit(_INLINE_JAVA), F.lit(1))
    return F.concat(
        F.transform(display, lambda x: F.struct(F.lit(True).alias("display"), x.alias("latex"))),
        F.transform(inline, lambda x: F.struct(F.lit(False).alias("display"), x.alias("latex"))),
    )


def callouts(md: Column) -> Column:
    """``> [!type] title`` blocks; the title defaults to the type's name."""
    kinds = F.regexp_extract_all(md, F.lit(fv.CALLOUT), F.lit(1))
    titles = F.regexp_extract_all(md, F.lit(fv.CALLOUT), F.lit(2))
    return F.zip_with(
        kinds, titles,
        lambda k, t: F.struct(
            F.lower(k).alias("kind"),
            F.when(js_trim(t) != "", js_trim(t)).otherwise(F.concat(F.upper(F.left(k, F.lit(1))), F.lower(F.substr(k, F.lit(2))))).alias("title"),
        ),
    )


def callout_blocks(md: Column) -> Column:
    """The callouts of a text with their bodies: kind, title and body (one quote mark less on
    each line). A callout is a run of quoted lines whose first one opens it."""
    def block(run: Column) -> Column:
        kind, title = (F.regexp_extract(run, fv.CALLOUT_HEAD, k) for k in (1, 2))
        body = F.regexp_replace(F.regexp_replace(run, r"\A[^\n]*\n?", ""), fv.QUOTE_MARK, "")
        named = F.concat(F.upper(F.left(kind, F.lit(1))), F.lower(F.substr(kind, F.lit(2))))
        return F.struct(F.lower(kind).alias("kind"), F.when(js_trim(title) != "", js_trim(title)).otherwise(named).alias("title"), body.alias("body"))

    runs = F.regexp_extract_all(md, F.lit(fv.QUOTE_RUN), 0)
    return F.transform(F.filter(runs, lambda r: r.rlike(fv.CALLOUT_HEAD)), block)


def quote_depth(md: Column) -> Column:
    """The most quote marks in front of a line."""
    fronts = F.regexp_extract_all(md, F.lit(r"(?m)^(?: {0,3}>)++"), 0)
    return F.coalesce(F.array_max(F.transform(fronts, lambda x: F.char_length(F.regexp_replace(x, " ", "")))), F.lit(0))


def outside_formulas(md: Column, change: Callable[[Column], Column]) -> Column:
    """The text with ``change`` applied to everything between its formulas; formulas, any
    number of them, stay as they are. Each list is made once and met by position. (The two private
    characters that stand for a display formula meanwhile must not be in the text.)"""
    shown = F.regexp_extract_all(md, F.lit(fv.DISPLAY_FORMULA), 0)
    rest = F.regexp_replace(md, fv.DISPLAY_FORMULA, fv.FORMULA_STASH)
    inline = F.regexp_extract_all(rest, F.lit(_INLINE_SPAN), 0)
    beside = lambda free, kept, how: F.array_join(F.zip_with(free, kept, lambda p, f: F.concat(how(p), F.coalesce(f, F.lit("")))), "")
    changed = beside(F.split(rest, _INLINE_SPAN, -1), inline, change)
    return beside(F.split(changed, fv.FORMULA_STASH, -1), shown, lambda p: p)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def highlights(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(fv.HIGHLIGHT), F.lit(1))


def wikilinks(md: Column) -> Column:
    part = lambda n: F.regexp_extract_all(md, F.lit(fv.WIKILINK), F.lit(n))
    return F.transform(
        F.arrays_zip(part(1).alias("bang"), part(2).alias("note"), part(3).alias("label")),
        lambda x: F.struct(
            (x["bang"] == "!").alias("embed"),
            js_trim(F.when(F.coalesce(x["label"], F.lit("")) != "", x["label"]).otherwise(x["note"])).alias("text"),
        ),
    )


# ---- occurrences ----------------------------------------------------------

def literal(needle: str, ignore_case: bool = False) -> str:
    """Pattern matching exactly the needle; with ``ignore_case`` ASCII letters,
    and only those, match in either case, so offsets fit the text as it is."""
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return f"(?i){quoted}" if ignore_case else quoted


def count_occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping exact occurrences, left to right."""
    gone = F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))
    return (gone / F.lit(len(needle))).cast("long")


def occurrence_offsets(text: Column, needle: str, limit: int | None = None, ignore_case: bool = False) -> Column:
    """Zero-based offsets of the first ``limit`` occurrences (all when None).

    A running sum over the lengths of the pieces between occurrences, so each
    character is visited once.
    """
    width = len(needle)
    pieces = F.split(text, literal(needle, ignore_case), -1 if limit is None else limit + 1)
    lengths = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.char_length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offsets"))
    return F.aggregate(
        lengths,
        start,
        lambda acc, n: F.struct(
            (acc["at"] + n + F.lit(width)).cast("int").alias("at"),
            F.concat(acc["offsets"], F.array((acc["at"] + n).cast("int"))).alias("offsets"),
        ),
        lambda acc: acc["offsets"],
    )


def context_before(text: Column, at: Column, width: int) -> Column:
    start = F.greatest(F.lit(0), at - width)
    cut = F.substring(text, start + 1, at - start)
    return F.concat(F.when(start > 0, F.lit(fv.ELLIPSIS)).otherwise(F.lit("")), js_trim_start(tidy(cut)))


def context_after(text: Column, at: Column, needle_size: int, width: int) -> Column:
    end = F.least(F.char_length(text), at + needle_size + width)
    cut = F.substring(text, at + needle_size + 1, end - at - needle_size)
    tail = F.when(end < F.char_length(text), F.lit(fv.ELLIPSIS)).otherwise(F.lit(""))
    return F.concat(js_trim_end(tidy(cut)), tail)


def snippet(text: Column, at: Column, needle_size: Column, width: int = fv.WORD_SNIPPET) -> Column:
    start = F.greatest(F.lit(0), at - width)
    end = F.least(F.char_length(text), at + needle_size + width)
    return F.concat(
        F.when(start > 0, F.lit(fv.ELLIPSIS)).otherwise(F.lit("")),
        flat(F.substring(text, start + 1, end - start)),
        F.when(end < F.char_length(text), F.lit(fv.ELLIPSIS)).otherwise(F.lit("")),
    )


def translate_service_text(c: Column) -> Column:
    """Service messages in English; unknown ones stay as they are, null is empty."""
    out = F.when(c.isNull(), F.lit(""))
    for pattern, template in fv.SERVICE_MESSAGES:
        # an end is the text's own end, and a pattern without one takes all that follows
        whole = pattern[:-1] + r"\z" if pattern.endswith("$") else pattern + r"[\s\S]*\z"
        made = F.regexp_replace(c, whole, template)
        out = out.when(c.rlike(whole), F.regexp_replace(made, r"(^|[^\d./])1 pages\b", "$11 page"))
    return out.otherwise(c)
