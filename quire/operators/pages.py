"""Page-level jobs: refinement, rescue, reruns, causes, assembly, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import page_state
from quire.functions.base import js_round
from quire.functions.text import escape_markdown, preview

KEY = ["job_id", "page"]


def with_replies(drafts: DataFrame, replies: DataFrame) -> DataFrame:
    """Final pages. Keyed by (document, page), so a huge document is spread too."""
    return page_state.answered(drafts, replies, KEY)


def resume(drafts: DataFrame, archived: DataFrame, kept: DataFrame) -> DataFrame:
    """Finished pages of a restarted run: the checkpoint wins over kept pages."""
    a = archived.select(*KEY, F.col("result").alias("_a"))
    k = kept.select(*KEY, F.col("result").alias("_k"))
    joined = drafts.select(*KEY).join(a, KEY, "left").join(k, KEY, "left")
    return joined.select(*KEY, F.coalesce("_a", "_k").alias("result")).filter(F.col("result").isNotNull())


def rescue(finals: DataFrame, second: DataFrame) -> DataFrame:
    """Pages whose call failed take the second round's result where that one
    did not fail; the marker of a failed call leaves with it."""
    again = second.filter(~F.coalesce("ai_failed", F.lit(False)))
    cols = [c for c in finals.columns if c not in (*KEY, "ai_failed")]
    new = again.select(*(F.col(k).alias(f"_new_{k}") for k in KEY), F.struct(*cols).alias("_new"))
    # final pages are made once: the others go through the join too and meet nothing there
    same = [F.col(k) == F.col(f"_new_{k}") for k in KEY]
    joined = finals.join(new, same[0] & same[1] & F.coalesce("ai_failed", F.lit(False)), "left")
    # a replaced row takes the new values even where they are NULL
    picked = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    return joined.select(*KEY, *picked)


def fallback_rerun(finals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For a rerun of the fallback pages only: (drafts to send, pages to keep)."""
    fell = page_state.is_fallback()
    return page_state.to_draft(finals.filter(fell)), finals.filter(~fell)


def summary(pages: DataFrame) -> DataFrame:
    """Per-document summary kept beside the job row."""
    return pages.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.col("status") == "review").alias("review_count"),
        F.count_if(F.col("method") == "ai").alias("ai_pages"),
        F.coalesce(F.sum("char_count"), F.lit(0)).alias("char_count"),
        F.count_if(page_state.is_fallback()).alias("fallback_count"),
    )


def outcome_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(page_state.outcome().alias("outcome")).agg(F.count(F.lit(1)).alias("pages"))


def failure_causes(pages: DataFrame) -> DataFrame:
    """Fallback pages by cause: pages, empty ones, and whether a rerun can help."""
    cause = page_state.fallback_cause(F.col("reasons"))
    c = pages.filter(page_state.is_fallback()).select(cause.alias("c"))
    kind = F.when(F.col("c").isNull(), "unknown").otherwise(page_state.error_kind(F.col("c.message"), F.col("c.stage")))
    g = c.select(kind.alias("kind"), F.coalesce(F.col("c.page_empty"), F.lit(False)).alias("empty")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("empty")).alias("empty_pages")
    )
    return g.withColumn("blocker", F.coalesce(~page_state.retry_helps(F.col("kind")), F.lit(False)))


def scores(pages: DataFrame) -> DataFrame:
    """Passed, to review, without text, and formulas, per document."""
    quiet = page_state.outcome() == "noText"
    review = (F.col("status") == "review") & ~quiet
    return pages.groupBy("job_id").agg(
        (F.count(F.lit(1)) - F.count_if(review) - F.count_if(quiet)).alias("passed"),
        F.count_if(review).alias("review"),
        F.count_if(quiet).alias("no_text"),
        F.sum("formula_count").alias("formulas"),
    )


def next_problem(pages: DataFrame, current: Column) -> DataFrame:
    """Per document: the next page to check after ``current``, from the start
    again at the end; NULL when it is the current one."""
    wanted = pages.filter((F.col("status") == "review") & (page_state.outcome() != "noText"))
    g = wanted.groupBy("job_id").agg(
        F.min(F.when(F.col("page") > current, F.col("page"))).alias("_after"),
        F.min("page").alias("_first"),
        F.max(current).alias("_at"),
    )
    target = F.coalesce("_after", "_first")
    return g.select("job_id", F.when(target != F.col("_at"), target).alias("next_page"))


def page_times(pages: DataFrame, ms: Column) -> DataFrame:
    """Mean seconds per page and the slowest page (first of equals)."""
    g = pages.withColumn("_ms", ms).filter(F.col("_ms").isNotNull()).groupBy("job_id").agg(
        F.sum("_ms").alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct(F.col("_ms").alias("ms"), (-F.col("page")).alias("minus_page"))).alias("_worst"),
    )
    return g.select(
        "job_id",
        js_round(F.col("_sum") / F.col("_n") / 1000, 1).alias("mean_sec"),
        (-F.col("_worst.minus_page")).alias("slowest_page"),
        js_round(F.col("_worst.ms") / 1000, 1).alias("slowest_sec"),
    )


def _heading(page: Column, noun: str) -> Column:
    if noun == "图":
        return F.concat(F.lit("## 第 "), page.cast("string"), F.lit(" 张图"))
    return F.concat(F.lit("## PDF 第 "), page.cast("string"), F.lit(" 页"))


def _empty_note(no_text: Column, note: Column, noun: str) -> Column:
    subject = "这张图" if noun == "图" else "此页"
    plain = "_[未检测到文字，请查看原图。]_" if noun == "图" else "_[此页未检测到文字，请查看原始 PDF。]_"
    detail = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("（"), note, F.lit("）"))).otherwise(F.lit(""))
    seen = F.concat(F.lit(f"_[AI 检测：{subject}没有可提取的文字"), detail, F.lit("。]_"))
    return F.when(F.coalesce(no_text, F.lit(False)), seen).otherwise(F.lit(plain))


def page_sections(pages: DataFrame, noun: str = "页") -> DataFrame:
    """One text block per page; rows in (document, page) order make the file."""
    body = F.when(F.col("markdown") != "", F.col("markdown")).otherwise(_empty_note(F.col("no_text"), F.col("note"), noun))
    return pages.select(
        *KEY, "method", F.concat(_heading(F.col("page"), noun), F.lit("\n\n"), body, F.lit("\n\n---\n")).alias("section")
    )


def assembled(pages: DataFrame, titles: DataFrame, mode: str = "ai", maker: str = "", noun: str = "页") -> DataFrame:
    """One Markdown text per document: title, provenance, page sections.

    ``titles``: job_id, title. The text is one cell, so this form suits documents
    that fit one; ``write_documents`` in the sinks writes the same text as sorted
    sections without ever holding a document in memory.
    """
    unit = "张图" if noun == "图" else "页"
    joined = lambda at, part: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, part))), lambda x: x[part]), "\n")
    # first stretches of pages, then the stretches: no task gathers a long document page by page
    stretches = page_sections(pages, noun).groupBy("job_id", F.floor(F.col("page") / 256).alias("stretch")).agg(
        joined("page", "section").alias("text"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("method") == "ai").alias("ai")
    )
    g = stretches.groupBy("job_id").agg(joined("stretch", "text").alias("_body"), F.sum("n").alias("_n"), F.sum("ai").alias("_ai"))
    how = {
        "ai": F.concat(F.lit("由视觉模型直接识别 "), F.col("_ai").cast("string"), F.lit("/"), F.col("_n").cast("string"),
                       F.lit(" 页；PDF 文字层作为提示与回退，识别未通过校验的页面回退文字层。")),
        "fast": F.lit("直接读取 PDF 文字层，文件未上传。"),
    }.get(mode, F.lit("使用本机 Surya 解析版面与公式，文件未上传。"))
    head = F.concat(
        F.lit("# "), escape_markdown(F.col("title")), F.lit(f"\n\n> 由{maker}转换，共 "), F.col("_n").cast("string"), F.lit(f" {unit}。"), how, F.lit("\n\n")
    )
    whole = F.concat(F.regexp_replace(F.concat(head, F.col("_body")), rf"{fv.WS}+\z", ""), F.lit("\n"))
    return g.join(titles, "job_id").select("job_id", whole.alias("markdown"))


def previews(documents: DataFrame) -> DataFrame:
    return documents.select("job_id", preview(F.col("markdown")).alias("preview"))


def nothing_to_rerun(finals: DataFrame) -> DataFrame:
    """Documents without a fallback page: a rerun of the fallback pages is refused."""
    fell = page_state.is_fallback()
    return finals.groupBy("job_id").agg(F.count_if(fell).alias("_n")).filter(F.col("_n") == 0).select("job_id")
