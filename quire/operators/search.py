"""Full-text search and the look-up commands.

Pages are scanned once with the needle as a literal: a ``contains`` filter, a
count, and the first offsets, all inside code generation. What is shuffled is
one partial sum per document, never page text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import text
from quire.functions.base import clip, clip_cell, flat_cell, or_else, parse_tags
from quire.operators.ordered import row_numbers


def needle_of(query: str) -> str:
    """Trimmed, ASCII-folded search term; empty when it is too short to search."""
    needle = (query or "").strip(fv.WS_CHARS).translate(str.maketrans(fv.ASCII_UPPER, fv.ASCII_LOWER))
    return needle if len(needle) >= 2 else ""


def _counted(pages: DataFrame, needle: str) -> DataFrame:
    """Pages holding the needle, with its number of occurrences."""
    if not needle:
        return pages.filter(F.lit(False)).withColumn("_n", F.lit(0).cast("long"))
    pattern = F.lit(text.literal(needle, ignore_case=True))
    return pages.withColumn("_n", F.regexp_count("markdown", pattern).cast("long")).filter(F.col("_n") > 0)


def hit_counts(pages: DataFrame, query: str) -> DataFrame:
    """Occurrences per document; no ranking, no limit."""
    return _counted(pages, needle_of(query)).groupBy("job_id").agg(F.sum("_n").alias("hits"))


def search(pages: DataFrame, query: str, limit: int = fv.SEARCH_LIMIT) -> DataFrame:
    return hit_counts(pages, query).orderBy(F.col("hits").desc(), "job_id").limit(limit)


def search_hits(
    pages: DataFrame, query: str, per_doc: int = fv.HITS_PER_DOC, context: int = fv.CONTEXT, limit: int = fv.SEARCH_LIMIT
) -> DataFrame:
    """The ranked documents with their first hits in (page, offset) order.

    The at most ``limit`` ranked ids go into the plan as an IN filter, which
    reaches the Parquet scan: the text of other documents is not read again.
    A page's first offsets are cut out with their context where the page is read; what is ranked
    and shuffled are these short pieces.
    """
    needle = needle_of(query)
    ranked = [row["job_id"] for row in search(pages, query, limit).collect()]
    width = max(len(needle), 1)
    found = _counted(pages.filter(F.col("job_id").isin(ranked)), needle)
    md = F.col("markdown")
    piece = lambda at: F.struct(
        at.alias("at"), text.context_before(md, at, context).alias("before"), F.substring(md, at + 1, F.lit(width)).alias("match"),
        text.context_after(md, at, width, context).alias("after"))
    offsets = text.occurrence_offsets(md, needle or "\0", per_doc, ignore_case=True)
    each = found.select("job_id", "page", F.inline(F.transform(offsets, piece)))
    w = Window.partitionBy("job_id").orderBy("page", "at")
    first = each.withColumn("hit", F.row_number().over(w)).filter(F.col("hit") <= per_doc)
    return first.select("job_id", "hit", "page", "before", "match", "after")


def _meta(jobs: DataFrame) -> Column:
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    tags = F.array_join(parse_tags(F.col("tags")), " ")
    return F.lower(F.concat_ws(" ", cell("ai_title"), cell("filename"), cell("ai_one_line"), tags))


def word_search(jobs: DataFrame, pages: DataFrame, words: Sequence[str], match_any: bool = False) -> DataFrame:
    """Documents mentioning all (or any) of the words in title, tags or text.

    Each page is read once for all words; a document's counts meet its metadata
    in one equi-join. ``total`` is the size of the whole result, before any limit.
    """
    needles = [w.lower() for w in words if w]
    body = F.lower(F.coalesce(F.col("markdown"), F.lit("")))
    counts = [text.count_occurrences(F.col("_b"), w).alias(f"c{i}") for i, w in enumerate(needles)]
    relevant = pages.withColumn("_b", body).filter(_any([F.contains(F.col("_b"), F.lit(w)) for w in needles]))
    per_doc = (
        relevant.select(F.col("job_id").cast("string").alias("id"), *counts)
        .groupBy("id")
        .agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(needles))])
    )
    joined = jobs.withColumn("_meta", _meta(jobs)).join(per_doc, "id", "left")
    in_meta = [F.contains(F.col("_meta"), F.lit(w)) for w in needles]
    count = [F.coalesce(F.col(f"c{i}"), F.lit(0)) for i in range(len(needles))]
    found = [m | (c > 0) for m, c in zip(in_meta, count)]
    keep = _any(found) if match_any else _all(found)
    score = sum(count[1:], count[0]) + F.when(_any(in_meta), fv.META_BONUS).otherwise(0)
    return joined.filter(keep).select("id", "created_at", score.alias("score"))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def top_scores(found: DataFrame, limit: int = fv.WORD_LIMIT) -> DataFrame:
    total = found.select(F.count(F.lit(1))).scalar()
    return found.orderBy(F.col("score").desc(), F.col("created_at").desc(), "id").limit(limit).withColumn("total", total)


def word_snippets(pages: DataFrame, words: Sequence[str], per_doc: int = fv.SNIPPETS_PER_DOC) -> DataFrame:
    """First snippets of each document, page by page and word by word."""
    needles = [w.lower() for w in words if w]
    body = F.lower(F.coalesce(F.col("markdown"), F.lit("")))

    def spot(i: int, word: str) -> Column:
        piece = lambda at: text.snippet(F.col("markdown"), at, F.lit(len(word)))
        tagged = lambda at: F.struct(F.lit(i).alias("word"), at.alias("at"), piece(at).alias("snippet"))
        return F.transform(text.occurrence_offsets(F.col("_b"), word, per_doc), tagged)

    spots = F.concat(*[spot(i, word) for i, word in enumerate(needles)])
    hits = (
        pages.withColumn("_b", body)
        .filter(_any([F.contains(F.col("_b"), F.lit(w)) for w in needles]))
        .select("job_id", "page", F.inline(F.slice(spots, 1, per_doc)))
    )
    w = Window.partitionBy("job_id").orderBy("page", "word", "at")
    kept = hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_doc)
    return kept.select("job_id", "n", "page", "snippet")


def word_hits(pages: DataFrame, word: str, limit: int = fv.WORD_LIMIT) -> DataFrame:
    """Each document's first occurrences of a word, with page and snippet."""
    return word_snippets(pages, [word], limit)


def read_window(pages: DataFrame, word: str, chars: int = fv.READ_CHARS) -> DataFrame:
    """Per document: the first page holding the word, and the text around it."""
    needle = word.lower()
    md = F.col("markdown")
    found = pages.filter(F.contains(F.lower(md), F.lit(needle)))
    start = F.greatest(F.lit(0), F.instr(F.lower(md), F.lit(needle)) - 1 - chars // 3)
    cut = found.select("job_id", "page", start.alias("start"), F.substring(md, start + 1, F.lit(chars)).alias("text"), (start + chars < F.char_length(md)).alias("more"))
    # the windows, not the pages, are compared and moved
    return cut.groupBy("job_id").agg(F.min_by(F.struct("page", "start", "text", "more"), "page").alias("_w")).select("job_id", "_w.*")


def read_page(pages: DataFrame, job_id, page: int, chars: int = fv.READ_CHARS) -> DataFrame:
    """One page's opening; an unknown number falls back to the first page."""
    doc = pages.filter(F.col("job_id") == F.lit(job_id))
    pick = doc.orderBy((F.col("page") != page).cast("int"), "page").limit(1)
    return pick.select("job_id", "page", F.left("markdown", F.lit(chars)).alias("text"))


def outline(pages: DataFrame, limit: int = fv.OUTLINE_LIMIT) -> DataFrame:
    """First headings of each document with their page."""
    lines = pages.filter(F.contains("markdown", F.lit("#"))).select(
        "job_id", "page", F.posexplode(F.split("markdown", "\n", -1)).alias("line", "raw")
    )
    heads = lines.withColumn("_h", F.regexp_extract("raw", fv.HEADING_1_TO_3, 1)).filter(F.col("_h") != "")
    w = Window.partitionBy("job_id").orderBy("page", "line")
    kept = heads.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)
    return kept.select("job_id", "n", "page", clip(text.flat(F.col("_h")), fv.OUTLINE_CLIP).alias("heading"))


def resolve_prefixes(ids: DataFrame, refs: DataFrame) -> DataFrame:
    """Short ids to full ids: at least four characters and exactly one match.

    An id is expanded to its prefixes of the lengths asked for, counts are partly
    added before the shuffle, and the join is an equality.
    """
    wanted = refs.select(F.lower("ref").alias("ref")).filter(F.char_length("ref") >= fv.MIN_PREFIX).distinct()
    # the lengths asked for, usually one: a set no larger than the longest reference
    lengths = wanted.select(F.collect_set(F.char_length("ref"))).scalar()
    each = ids.select("id", F.explode(lengths).alias("_n")).filter(F.char_length("id") >= F.col("_n"))
    prefixes = each.select("id", F.left("id", F.col("_n")).alias("ref"))
    counted = prefixes.groupBy("ref").agg(F.count(F.lit(1)).alias("matches"), F.min("id").alias("id"))
    return wanted.join(counted, "ref", "left").select(
        "ref", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("id")).alias("id")
    )


def catalog(done: DataFrame, full: bool = True) -> DataFrame:
    """Numbered catalogue lines, newest first; without ``full`` a line drops its
    one-liner and tags. A prompt that must stay short asks for the short form."""
    c = fv.CATALOG_CLIP
    sources = [x for x in ("ai_title", "filename", "ai_one_line", "preview", "tags", "page_count") if x in done.columns]
    rows = done.select("id", "created_at", *sources)
    preview = F.col("preview") if "preview" in sources else F.lit(None).cast("string")

    def cells(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "_title": flat_cell(or_else(F.col("ai_title"), F.col("filename"))),
            "_line": flat_cell(or_else(F.col("ai_one_line"), preview)),
            "_tags": flat_cell(F.array_join(parse_tags(F.col("tags")), fv.TAG_JOINER)),
            "_file": flat_cell(F.col("filename")),
        })

    def body() -> Column:
        return F.concat_ws(
            " | ",
            F.date_format("created_at", "yyyy-MM-dd"),
            clip(F.col("_title"), c["title"]),
            clip(F.col("_line"), c["one_line"]) if full else F.lit(""),
            clip(F.col("_tags"), c["tags"]) if full else F.lit(""),
            clip(F.col("_file"), c["filename"]),
            F.concat(F.coalesce("page_count", F.lit(0)).cast("string"), F.lit("页")),
        )

    # numbered before the text is made: ranges are cut over the short columns
    numbered = cells(row_numbers(rows, [F.col("created_at").desc(), F.col("id")]))
    return numbered.select("n", "id", F.concat_ws(" | ", F.col("n").cast("string"), body()).alias("line"))


def find_results(answers: DataFrame, catalog_rows: DataFrame, limit: int = fv.FIND_RESULTS) -> DataFrame:
    """A model's picks (``question``, ``position``, ``n``, ``why``) as documents:
    unknown and repeated numbers go, the first eight of a question stay."""
    picks = answers.withColumn("n", F.col("n").try_cast("long")).join(catalog_rows.select("n", "id"), "n")
    once = picks.groupBy("question", "id").agg(F.min_by(F.struct("position", "why"), "position").alias("_a"))
    w = Window.partitionBy("question").orderBy("_a.position")
    ranked = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.select("question", "rank", "id", clip_cell(F.col("_a.why"), 60).alias("why"))


def deep_results(answers: DataFrame, done: DataFrame, limit: int = fv.FIND_RESULTS) -> DataFrame:
    """A tool-using model's picks (``question``, ``position``, ``d``, ``page``,
    ``why``): short ids must resolve to one document, pages must exist in it."""
    known = resolve_prefixes(done.select("id"), answers.select(F.col("d").alias("ref")))
    picks = (
        answers.withColumn("ref", F.lower("d"))
        .join(known.filter(F.col("id").isNotNull()).select("ref", "id"), "ref")
        .join(done.select("id", "page_count"), "id")
    )
    page = F.col("page").try_cast("long")
    valid = F.when((page >= 1) & (page <= F.coalesce("page_count", F.lit(0))), page)
    once = picks.withColumn("page", valid).groupBy("question", "id").agg(F.min_by(F.struct("position", "page", "why"), "position").alias("_a"))
    w = Window.partitionBy("question").orderBy("_a.position")
    ranked = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.select("question", "rank", "id", F.col("_a.page").alias("page"), clip_cell(F.col("_a.why"), 80).alias("why"))


def find(question: str, done: DataFrame, ask) -> DataFrame:
    """Ask a model for documents. ``ask(question, catalog_rows)`` is supplied by
    the caller and returns its picks as (question, position, n, why) rows."""
    q = " ".join(question.split())[:300]
    if not q:
        raise ValueError("a question is needed")
    lines = catalog(done)
    return find_results(ask(q, lines), lines)
