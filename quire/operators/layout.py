"""Pages from layout: positioned text, recognised blocks, HTML, print chunks.

A page's runs or blocks arrive as one array column, so no shuffle regroups them;
the Python helpers see Arrow batches of pages.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import fixed_values as fv
from quire.functions.base import js_trim, line_count
from quire.functions.markup import html_to_markdown, lines_to_markdown, print_chunks, strip
from quire.functions.text import callout_blocks, count_formulas, count_options, quote_depth, visible_length

MARKDOWN = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("formula_lost", T.BooleanType())])


@F.pandas_udf(MARKDOWN)
def _html_markdown(html: pd.Series, display: pd.Series) -> pd.DataFrame:
    rows = [html_to_markdown(h, bool(d)) if h else ("", False) for h, d in zip(html, display)]
    return pd.DataFrame(rows, columns=["markdown", "formula_lost"])


@F.pandas_udf(T.ArrayType(MARKDOWN))
def _blocks_markdown(html: pd.Series, display: pd.Series) -> pd.Series:
    def page(blocks, flags):
        out = [html_to_markdown(h, bool(d)) if h else ("", False) for h, d in zip(blocks, flags)]
        return [{"markdown": m, "formula_lost": lost} for m, lost in out]

    return pd.Series([page(b, f) for b, f in zip(html, display)])


LAID_OUT = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("raw", T.IntegerType())])


@F.arrow_udf(LAID_OUT)
def _lines_markdown(items: pa.Array) -> pa.Array:
    """Markdown of each page's runs and the length of their text. The runs of a batch lie in flat columns; a page is a stretch of these."""
    runs, page = items.flatten(), pc.list_parent_indices(items)
    text = pc.struct_field(runs, "text")
    kept = pc.fill_null(pc.not_equal(pc.utf8_trim(text, characters=fv.WS_CHARS), ""), False)
    text, page = text.filter(kept), page.filter(kept).to_numpy()
    part = lambda c: pc.struct_field(runs, c).filter(kept).cast(pa.float64())
    x, y, width = (part(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "width"))
    size = np.maximum(1.0, pc.fill_null(part("size"), 1.0).to_numpy(zero_copy_only=False))
    bounds = np.searchsorted(page, np.arange(len(items) + 1)).tolist()
    markdown, raw = [], []
    for a, b in zip(bounds, bounds[1:]):
        words = text.slice(a, b - a).to_numpy(zero_copy_only=False).tolist()
        markdown.append(lines_to_markdown(words, x[a:b], y[a:b], width[a:b], size[a:b]))
        raw.append(len(strip("".join(words))))
    return pa.StructArray.from_arrays([pa.array(markdown, pa.string()), pa.array(raw, pa.int32())], names=["markdown", "raw"])


def _chunker(target: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunk(text: pd.Series) -> pd.Series:
        return pd.Series([print_chunks(t or "", target) for t in text])

    return chunk


def html_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """HTML to Markdown; a page that lost a formula is marked, not dropped."""
    done = pages.withColumn("_m", _html_markdown(F.col(html), F.lit(False)))
    return done.withColumn("markdown", F.col("_m.markdown")).withColumn("formula_lost", F.col("_m.formula_lost")).drop("_m")


def _metrics(md: Column) -> list[Column]:
    return [
        visible_length(md).cast("long").alias("char_count"),
        line_count(md).cast("long").alias("line_count"),
        count_formulas(md).cast("long").alias("formula_count"),
        count_options(md).cast("long").alias("option_count"),
    ]


def block_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages from recognised blocks. ``blocks``: array of (label, html,
    reading_order, error) structs; running heads go, the rest is read in order,
    pictures without text become a note."""
    indexed = F.transform(F.col("blocks"), lambda b, i: F.struct(F.coalesce(b["reading_order"], F.lit(0)).alias("o"), i.alias("i"), b.alias("b")))
    ordered = F.filter(F.array_sort(indexed), lambda x: ~F.coalesce(x["b"]["label"], F.lit("")).isin("PageHeader", "PageFooter"))
    blocks = pages.withColumn("_blocks", F.transform(ordered, lambda x: x["b"]))
    visual = lambda b: F.coalesce(b["label"], F.lit("")).isin("Picture", "Diagram")
    empty = lambda b: F.coalesce(b["html"], F.lit("")) == ""
    flags = blocks.select(
        *keys,
        F.transform("_blocks", lambda b: b["html"]).alias("_html"),
        F.transform("_blocks", lambda b: b["label"].eqNullSafe(F.lit("Equation"))).alias("_display"),
        F.transform("_blocks", lambda b: visual(b) & empty(b)).alias("_note"),
        F.exists("_blocks", visual).alias("_visual"),
        F.exists("_blocks", lambda b: F.coalesce(b["error"], F.lit(False))).alias("_error"),
    )
    rendered = flags.withColumn("_md", _blocks_markdown("_html", "_display"))
    parts = F.zip_with("_md", "_note", lambda m, n: F.when(n, F.lit(fv.PICTURE_NOTE)).otherwise(m["markdown"]))
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
    whole = rendered.withColumn("markdown", js_trim(F.regexp_replace(joined, "\n{3,}", "\n\n"))).withColumn(
        "formula_lost", F.exists("_md", lambda m: m["formula_lost"])
    )
    md = F.col("markdown")
    reasons = F.array_compact(F.array(
        F.when(F.col("_error"), F.lit(fv.REASON_BAD_BLOCK)), F.when(F.col("_visual"), F.lit(fv.REASON_HAS_IMAGE)),
        F.when(md == "", F.lit(fv.REASON_NO_TEXT_FOUND))))
    return whole.withColumn("reasons", reasons).select(
        *keys, "markdown", *_metrics(md), F.when(md != "", "surya").otherwise("empty").alias("method"),
        F.when(F.size("reasons") > 0, "review").otherwise("good").alias("status"), "reasons", "formula_lost")


def text_layer_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages from a text layer. ``items``: array of (text, x, y, width, size)."""
    rendered = pages.select(*keys, _lines_markdown(F.col("items")).alias("_m")).select(*keys, "_m.markdown", "_m.raw")
    md, thin = F.col("markdown"), F.col("raw") < fv.THIN_TEXT
    return rendered.select(
        *keys, "markdown", *_metrics(md), F.when(md != "", "text").otherwise("empty").alias("method"),
        F.when(thin, "review").otherwise("good").alias("status"),
        F.when(thin, F.array(F.lit(fv.REASON_THIN_TEXT))).otherwise(F.array().cast("array<string>")).alias("reasons"))


def require_page_count(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents whose recognised pages differ in number from the source's."""
    counts = found.groupBy("job_id").agg(F.count(F.lit(1)).alias("found"))
    return expected.join(counts, "job_id", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter(
        F.col("found") != F.col("page_count"))


def chunked(documents: DataFrame, keys: list[str], target: int = fv.PRINT_CHUNK_BYTES) -> DataFrame:
    """Print chunks, one row each, numbered from 0."""
    return documents.select(*keys, F.posexplode(_chunker(target)(F.col("markdown"))).alias("chunk", "markdown"))


def callouts(pages: DataFrame, keys: list[str], markdown: str = "markdown") -> DataFrame:
    """The callouts of each text and those inside them: keys, path (places from the outermost
    in, from 0), kind, title, body. Levels are as many as quote marks stand before one line
    anywhere; each is one narrow step on the bodies of the one before."""
    depth = pages.agg(F.max(quote_depth(F.col(markdown)))).first()[0] or 0
    blocks = lambda c: F.posexplode(callout_blocks(c)).alias("_at", "_b")
    level = pages.select(*keys, F.array().cast("array<int>").alias("_path"), F.col(markdown).alias("_text"))
    levels = []
    for _ in range(depth):
        found = level.select(*keys, "_path", blocks(F.col("_text")))
        levels.append(found.select(*keys, F.concat("_path", F.array("_at")).alias("path"), "_b.kind", "_b.title", "_b.body"))
        level = levels[-1].select(*keys, F.col("path").alias("_path"), F.col("body").alias("_text"))
    if not levels:
        return level.select(*keys, F.col("_path").alias("path"), *(F.lit("").alias(c) for c in ("kind", "title", "body"))).filter(F.lit(False))
    return reduce(DataFrame.unionByName, levels)
