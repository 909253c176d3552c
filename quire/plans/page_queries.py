"""Pages: metrics, states, validation, reruns, assembly."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import page_state, text
from quire.functions.base import line_count
from quire.operators import layout, pages
from quire.plans.registry import query
from quire.plans.views_sql import (
    DRAFTS, FINALS, FORMULAS, LINES, OPTIONS, PAGES, SQUASH, TRIM, VISIBLE, q, with_,
)
from quire.session import shared_dir
from quire.sources import changelog, views
from quire.sources.views import lib_drafts, lib_finals, lib_pages, lib_replies

JOIN = lambda c: F.array_join(c, "|")


@query("page_metrics", with_(PAGES) + f"""
select job_id, page, {FORMULAS('markdown')} formulas, {OPTIONS('markdown')} options, {VISIBLE('markdown')} visible, {LINES('markdown')} lines from lib_pages""")
def page_metrics(spark, folder):
    md = F.col("markdown")
    return lib_pages(spark, folder).select(
        "job_id", "page",
        text.count_formulas(md).cast("long").alias("formulas"), text.count_options(md).cast("long").alias("options"),
        text.visible_length(md).cast("long").alias("visible"), line_count(md).cast("long").alias("lines"))


@query("fast_pages", with_(DRAFTS) + """
select job_id, page, char_count, line_count, method, status, array_to_string(reasons, '|') reasons, formula_count, option_count from drafts""")
def fast_pages(spark, folder):
    return lib_drafts(spark, folder).drop("markdown").withColumn("reasons", JOIN("reasons"))


@query("validate_pages", with_(FINALS) + """
select job_id, page, array_to_string(failures, '|') failures from stepped where len(failures) > 0""")
def validate_pages(spark, folder):
    joined = lib_drafts(spark, folder).join(page_state.measured(lib_replies(spark, folder)), ["job_id", "page"])
    failed = page_state.checked(joined).filter(F.size("_failures") > 0)
    return failed.select("job_id", "page", JOIN("_failures").alias("failures"))


@query("apply_replies", with_(FINALS) + """
select job_id, page, outcome, md5(markdown) text_md5, char_count, line_count, method, status, array_to_string(reasons, '|') reasons, formula_count, option_count from finals""")
def apply_replies(spark, folder):
    f = lib_finals(spark, folder)
    return f.select(
        "job_id", "page", page_state.outcome().alias("outcome"), F.md5("markdown").alias("text_md5"), "char_count",
        "line_count", "method", "status", JOIN("reasons").alias("reasons"), "formula_count", "option_count")


@query("outcome_counts", with_(FINALS) + "select outcome, count(*) pages from finals group by outcome")
def outcome_counts(spark, folder):
    return pages.outcome_counts(lib_finals(spark, folder))


@query("document_summary", with_(FINALS) + """
select job_id, count(*) page_count, count(*) filter (where status = 'review') review_count, count(*) filter (where method = 'ai') ai_pages,
  cast(sum(char_count) as bigint) as char_count, count(*) filter (where outcome = 'fallback') fallback_count from finals group by job_id""")
def document_summary(spark, folder):
    return pages.summary(lib_finals(spark, folder))


@query("failure_causes", with_(FINALS) + """,
c as (select reasons[-1] r, markdown from finals where outcome = 'fallback'),
k as (select case when starts_with(r, 'AI 结果未通过程序校验：') then 'rejected' when contains(r, 'credits are depleted') then 'credits'
   when contains(r, '超时') then 'timeout' when contains(r, 'fetch failed') then 'network' when contains(r, '有效 JSON') then 'badOutput' else 'unknown' end kind,
   starts_with(r, 'AI 识别失败，且此页没有文字层可回退：') empty from c)
select kind, count(*) pages, count(*) filter (where empty) empty_pages, kind = 'credits' blocker from k group by kind""")
def failure_causes(spark, folder):
    return pages.failure_causes(lib_finals(spark, folder))


@query("score_strip", with_(FINALS) + """
select job_id, count(*) - count(*) filter (where status = 'review') passed, count(*) filter (where status = 'review' and outcome <> 'noText') review,
  count(*) filter (where outcome = 'noText') no_text, cast(sum(formula_count) as bigint) formulas from finals group by job_id""")
def score_strip(spark, folder):
    return pages.scores(lib_finals(spark, folder))


@query("next_problem_page", with_(FINALS) + """,
p as (select job_id, min(page) filter (where page > job_id % 5) a, min(page) f, any_value(job_id % 5) cur from finals where status = 'review' and outcome <> 'noText' group by job_id)
select job_id, case when coalesce(a, f) <> cur then coalesce(a, f) end next_page from p""")
def next_problem_page(spark, folder):
    return pages.next_problem(lib_finals(spark, folder), F.col("job_id") % 5)


@query("page_times", with_(PAGES) + """,
t as (select job_id, page, length(markdown) * 7 ms from lib_pages)
select job_id, floor(sum(ms) / count(*) / 1000 * 10 + 0.5) / 10 mean_sec, cast(-max(row(ms, -page))[2] as int) slowest_page, floor(max(ms) / 1000 * 10 + 0.5) / 10 slowest_sec from t group by job_id""")
def page_times(spark, folder):
    return pages.page_times(lib_pages(spark, folder), F.char_length("markdown") * 7)


@query("refine_targets", with_(FINALS) + """
select d.job_id, d.page from drafts d left join finals f on f.job_id = d.job_id and f.page = d.page and f.outcome <> 'fallback'
where f.job_id is null and (d.status = 'review' or d.formula_count > 0 or d.option_count > 0)""")
def refine_targets(spark, folder):
    finished = lib_finals(spark, folder).filter(~page_state.is_fallback())
    return page_state.refine_targets(lib_drafts(spark, folder), finished, scope="marked").select("job_id", "page")


@query("fallback_rerun", with_(FINALS) + f"""
select job_id, page, md5(coalesce(raw_markdown, markdown)) text_md5, case when method <> 'ai' then method when raw_markdown <> '' then 'surya' else 'empty' end as method, status,
  array_to_string(list_filter(reasons, lambda r: not regexp_matches(r, '{fv.AI_REASON}')), '|') reasons
from finals where outcome = 'fallback'""")
def fallback_rerun(spark, folder):
    drafts, _ = pages.fallback_rerun(lib_finals(spark, folder))
    return drafts.select("job_id", "page", F.md5("markdown").alias("text_md5"), "method", "status", JOIN("reasons").alias("reasons"))


@query("redraft_pages", with_(FINALS) + f"""
select job_id, page, {VISIBLE('raw_markdown')} char_count, {LINES('raw_markdown')} line_count,
  case when method <> 'ai' then method when raw_markdown <> '' then 'surya' else 'empty' end as method, status,
  array_to_string(list_filter(reasons, lambda r: not regexp_matches(r, '{fv.AI_REASON}')), '|') reasons,
  {FORMULAS('raw_markdown')} formula_count, {OPTIONS('raw_markdown')} option_count from finals""")
def redraft_pages(spark, folder):
    return page_state.to_draft(lib_finals(spark, folder)).drop("markdown").withColumn("reasons", JOIN("reasons"))


@query("rescue_round", with_(FINALS) + """
select f.job_id, f.page, case when f.step = 'failed' and length(f.raw_markdown) > 200 then 'ai' else f.outcome end outcome,
  case when f.step = 'failed' and length(f.raw_markdown) > 200 then md5(trim(f.raw_markdown, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(12288))) else md5(f.markdown) end text_md5
from finals f""")
def rescue_round(spark, folder):
    """Second round: the failed pages of some length get their full text back."""
    finals = lib_finals(spark, folder)
    again = lib_replies(spark, folder).join(
        finals.filter(F.coalesce("ai_failed", F.lit(False))).select("job_id", "page", F.col("raw_markdown").alias("_md")), ["job_id", "page"])
    long = F.char_length("_md") > 200
    second = again.withColumn("r_markdown", F.when(long, F.col("_md"))).withColumn(
        "r_error", F.when(~long, F.col("r_error"))).withColumn("r_no_text", F.lit(False)).drop("_md")
    answers = page_state.apply_reply(lib_drafts(spark, folder).join(page_state.measured(second), ["job_id", "page"]))
    healed = pages.rescue(finals, answers)
    return healed.select("job_id", "page", page_state.outcome().alias("outcome"), F.md5("markdown").alias("text_md5"))


@query("latest_checkpoint", with_(PAGES) + """
select job_id, page, case when length(markdown) <= 200 then md5(markdown) else md5(markdown || '!') end result_md5 from lib_pages""")
def latest_checkpoint(spark, folder):
    """The pages in a change log: all of them, then the longer ones again, then one half-written
    line of each document. The log is compacted between."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    p = lib_pages(spark, folder)
    entry = lambda md: p.select("job_id", "page", F.struct(md.alias("markdown")).alias("result"))
    changelog.append_log(entry(F.col("markdown")), path)
    changelog.append_log(entry(F.concat("markdown", F.lit("!"))).filter(F.char_length("result.markdown") > 201), path)
    changelog.compact_log(spark, path)
    log = changelog.read_log(spark, path)
    last = F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in (("append", 2**62, "long"), ("file", "", "string"), ("block", 0, "long"), ("row", 0, "long"))))
    half = p.filter(F.col("page") == 1).select(F.col("job_id").cast("string").alias("job_id"), last.alias("seq"), F.lit('{"page":1,"result":{"mark').alias("line"))
    latest = changelog.latest_pages(log.unionByName(half), "markdown string")
    return latest.select(F.col("job_id").cast("long").alias("job_id"), "page", F.md5("result.markdown").alias("result_md5"))


@query("resumed_pages", with_(FINALS) + """
select job_id, page, case when length(raw_markdown) > 200 then 'archive' else 'kept' end src from finals where length(raw_markdown) > 200 or outcome <> 'fallback'""")
def resumed_pages(spark, folder):
    finals = lib_finals(spark, folder)
    archived = lib_pages(spark, folder).filter(F.char_length("markdown") > 200).select("job_id", "page", F.lit("archive").alias("result"))
    kept = finals.filter(~page_state.is_fallback()).select("job_id", "page", F.lit("kept").alias("result"))
    return pages.resume(lib_drafts(spark, folder), archived, kept).withColumnRenamed("result", "src")


@query("assembled_markdown", with_(FINALS) + f""",
b as (select job_id, string_agg('## PDF 第 ' || page || ' 页' || chr(10) || chr(10) || case when markdown <> '' then markdown when outcome = 'noText' then
    '_[AI 检测：此页没有可提取的文字（photo）。]_' else '_[此页未检测到文字，请查看原始 PDF。]_' end || chr(10) || chr(10) || '---' || chr(10), chr(10) order by page) body,
  count(*) n, count(*) filter (where method = 'ai') ai from finals group by job_id),
m as (select job_id, regexp_replace('# Doc\\_' || job_id || chr(10) || chr(10) || '> 由quire转换，共 ' || n || ' 页。由视觉模型直接识别 ' || ai || '/' || n ||
  ' 页；PDF 文字层作为提示与回退，识别未通过校验的页面回退文字层。' || chr(10) || chr(10) || body, '{fv.WS}+\\z', '') || chr(10) md from b)
select job_id, length(md) size, md5(md) text_md5 from m""")
def assembled_markdown(spark, folder):
    finals = lib_finals(spark, folder)
    titles = views.table(spark, folder, "documents").select(F.col("doc_id").alias("job_id"), F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")).alias("title"))
    md = pages.assembled(finals, titles, maker="quire")
    return md.select("job_id", F.char_length("markdown").cast("long").alias("size"), F.md5("markdown").alias("text_md5"))


PREVIEW_SQL = lambda md: f"""left({TRIM(SQUASH(f"regexp_replace(regexp_replace(regexp_replace({md}, {q(fv.IMAGE_MARKUP)}, {q(chr(92) + '1')}, 'g'), {q(fv.LINK_MARKUP)}, {q(chr(92) + '1')}, 'g'), {q(fv.PREVIEW_MARKS)}, '', 'g')"))}, {fv.PREVIEW_LENGTH})"""


@query("preview_text", f"""
with l as (select doc_id, unnest(string_split(md, chr(10))) raw, unnest(range(1, len(string_split(md, chr(10))) + 1)) i
  from (select doc_id, case when doc_id % 3 = 0 then '# Title of ' || doc_id || chr(10) || chr(10) || '> 由quire转换，共 1 页。' || chr(10) || chr(10) || '## PDF 第 1 页' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' else text end md from documents)),
t as (select *, {TRIM('raw')} cut from l),
h as (select doc_id, min(i) filter (where regexp_matches(cut, '^#{fv.WS}')) ti from t group by doc_id),
b as (select t.doc_id, string_agg(raw, ' ' order by i) body from t join h on h.doc_id = t.doc_id
  where i is distinct from ti and not regexp_matches(cut, {q(fv.PROVENANCE_LINE)}) and not regexp_matches(cut, {q(fv.PAGE_HEADING_LINE)})
    and not regexp_matches(cut, {q(fv.RULE_LINE)}) and not regexp_matches(cut, {q(fv.EMPTY_NOTE_LINE)}) group by t.doc_id)
select doc_id, {PREVIEW_SQL('body')} preview from b""")
def preview_text(spark, folder):
    md, k = F.col("text"), F.col("doc_id")
    dressed = F.concat(F.lit("# Title of "), k.cast("string"), F.lit("\n\n> 由quire转换，共 1 页。\n\n## PDF 第 1 页\n\n"), md, F.lit("\n\n---"))
    docs = views.table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", text.preview(F.when(k % 3 == 0, dressed).otherwise(md)).alias("preview"))


@query("card_content", f"""
select doc_id, c as content from (select doc_id, left({TRIM(SQUASH(f"regexp_replace(text, {q(fv.PREVIEW_MARKS)}, '', 'g')"))}, {fv.CARD_LENGTH}) c from documents) where length(c) >= {fv.CARD_MINIMUM}""")
def card_content(spark, folder):
    docs = views.table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", text.card_content(F.col("text")).alias("content")).filter(F.col("content").isNotNull())


@query("markdown_titles", f"""
with d as (select doc_id, case doc_id % 3 when 0 then '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || '# My\\_' || source || ' paper ' || chr(10) || text
  when 1 then '---' || chr(10) || 'no key here' || chr(10) || '---' || chr(10) || text else text end md from documents),
s as (select doc_id, case when doc_id % 3 = 0 then substr(md, length(regexp_extract(md, {q(fv.FRONTMATTER)})) + 1) else md end md from d),
h as (select doc_id, regexp_extract(md, {q(fv.FIRST_H1)}, 1) h from s)
select doc_id, case when h = '' then 'document' else {TRIM(f"regexp_replace(h, {q(fv.MARKDOWN_ESCAPE)}, {q(chr(92) + '1')}, 'g')")} end title from h""")
def markdown_titles(spark, folder):
    k = F.col("doc_id")
    docs = views.table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    md = (
        F.when(k % 3 == 0, F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\n---\n# My\\_"), F.col("source"), F.lit(" paper \n"), F.col("text")))
        .when(k % 3 == 1, F.concat(F.lit("---\nno key here\n---\n"), F.col("text"))).otherwise(F.col("text"))
    )
    return docs.select("doc_id", text.markdown_title(md, F.lit("document")).alias("title"))


@query("formula_inventory", f"""
with r as (select doc_id, list_transform(regexp_extract_all(text, {q(fv.DISPLAY_FORMULA)}, 1), lambda x: {TRIM('x')}) d,
  regexp_extract_all(regexp_replace(text, {q(fv.DISPLAY_FORMULA)}, chr(57344) || chr(57345), 'g'), {q(fv.INLINE_FORMULA)}, 1) i from documents)
select doc_id, len(d) display_count, len(i) inline_count, md5(array_to_string(d, chr(1))) display_md5, md5(array_to_string(i, chr(1))) inline_md5 from r where len(d) + len(i) > 0""")
def formula_inventory(spark, folder):
    docs = views.table(spark, folder, "documents").select("doc_id", "text")
    f = docs.select("doc_id", text.formulas(F.col("text")).alias("f")).filter(F.size("f") > 0)
    part = lambda shown: F.transform(F.filter("f", lambda x: x["display"] == shown), lambda x: x["latex"])
    return f.select(
        "doc_id", F.size(part(True)).cast("long").alias("display_count"), F.size(part(False)).cast("long").alias("inline_count"),
        F.md5(F.array_join(part(True), "\x01")).alias("display_md5"), F.md5(F.array_join(part(False), "\x01")).alias("inline_md5"))


@query("note_marks", f"""
with n as (select conv_id, turn, '> [!' || role || ']- ' || case when turn % 2 = 0 then 'About ' || conv_id else '' end || chr(10) || '> ' || text || chr(10)
  || '==key ' || turn || '== see [[Note ' || conv_id || '|alias]] and ![[pic ' || turn || ']]' md from conversations)
select conv_id, turn,
  lower(regexp_extract(md, {q(fv.CALLOUT)}, 1)) callout,
  case when {TRIM(f'regexp_extract(md, {q(fv.CALLOUT)}, 2)')} <> '' then {TRIM(f'regexp_extract(md, {q(fv.CALLOUT)}, 2)')} else upper(left(regexp_extract(md, {q(fv.CALLOUT)}, 1), 1)) || lower(substr(regexp_extract(md, {q(fv.CALLOUT)}, 1), 2)) end title,
  array_to_string(regexp_extract_all(md, {q(fv.HIGHLIGHT)}, 1), '|') highlights,
  array_to_string(list_transform(regexp_extract_all(md, {q(fv.WIKILINK)}, 0), lambda x: case when x like '!%' then 'embed:' else 'link:' end ||
    case when regexp_extract(x, {q(fv.WIKILINK)}, 3) <> '' then regexp_extract(x, {q(fv.WIKILINK)}, 3) else regexp_extract(x, {q(fv.WIKILINK)}, 2) end), '|') links
from n""")
def note_marks(spark, folder):
    c = views.table(spark, folder, "conversations")
    k, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    md = F.concat(
        F.lit("> [!"), F.col("role"), F.lit("]- "), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("About "), k)).otherwise(""), F.lit("\n> "), F.col("text"),
        F.lit("\n==key "), t, F.lit("== see [[Note "), k, F.lit("|alias]] and ![[pic "), t, F.lit("]]"))
    n = c.select("conv_id", "turn", md.alias("md"))
    call = F.get(text.callouts(F.col("md")), F.lit(0))
    link = lambda x: F.concat(F.when(x["embed"], "embed:").otherwise("link:"), x["text"])
    return n.select(
        "conv_id", "turn", call["kind"].alias("callout"), call["title"].alias("title"), JOIN(text.highlights(F.col("md"))).alias("highlights"),
        JOIN(F.transform(text.wikilinks(F.col("md")), link)).alias("links"))


# two levels: the check cuts out the runs of quoted lines, and again those of the bodies
_RUN = fv.QUOTE_RUN.replace("*+", "*")
_OPEN = lambda x: f"list_filter(regexp_extract_all({x}, {q(_RUN)}), lambda r: regexp_matches(r, {q(fv.CALLOUT_HEAD)}))"
_BODY = f"regexp_replace(regexp_replace(run, '^[^\n]*\n?', ''), {q(fv.QUOTE_MARK)}, '', 'g')"
_PLAIN = lambda x: f"regexp_extract({x}, {q(fv.CALLOUT_HEAD)}, "


@query("callout_bodies", f"""
with n as (select conv_id, turn, '> [!' || role || ']+ About ' || conv_id || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10)
  || '> > [!Tip]' || chr(10) || '> > turn ' || turn || chr(10) || '>> [!no] not first' || chr(10) || '> tail' || chr(10) || 'plain' || chr(10) || '> quoted' || chr(10) || '> [!no] inside' || chr(10) || chr(10)
  || '>[!end-{{x}}]'.replace('{{x}}', cast(turn % 3 as varchar)) md from conversations),
a as (select conv_id, turn, unnest(runs) run, unnest(range(len(runs))) i from (select conv_id, turn, {_OPEN('md')} runs from n)),
b as (select conv_id, turn, cast(i as varchar) path, run, {_BODY} body from a),
c as (select conv_id, turn, path || '.' || j path, run, {_BODY} body from (
  select conv_id, turn, path, unnest(runs) run, unnest(range(len(runs))) j from (select conv_id, turn, path, {_OPEN('body')} runs from b)))
select conv_id, turn, path, lower({_PLAIN('run')}1)) kind,
  case when {TRIM(_PLAIN('run') + '2)')} <> '' then {TRIM(_PLAIN('run') + '2)')} else upper(left({_PLAIN('run')}1), 1)) || lower(substr({_PLAIN('run')}1), 2)) end title, md5(body) body_md5
from (select * from b union all select * from c)""".replace("'>[!end-{x}]'.replace('{x}', cast(turn % 3 as varchar))", "'>[!end-' || turn % 3 || ']'"))
def callout_bodies(spark, folder):
    c = views.table(spark, folder, "conversations")
    k, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    md = F.concat(
        F.lit("> [!"), F.col("role"), F.lit("]+ About "), k, F.lit("\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\n> > [!Tip]\n> > turn "), t,
        F.lit("\n>> [!no] not first\n> tail\nplain\n> quoted\n> [!no] inside\n\n>[!end-"), (F.col("turn") % 3).cast("string"), F.lit("]"))
    found = layout.callouts(c.select("conv_id", "turn", md.alias("markdown")), ["conv_id", "turn"])
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), ".")
    return found.select("conv_id", "turn", path.alias("path"), "kind", "title", F.md5("body").alias("body_md5"))


@query("escaped_around_formulas", f"""
with d as (select doc_id, '<b>' || replace(text, ' the ', ' <$a<b$ & $$c<' || doc_id || '$$ "the" ') md from documents),
r as (select doc_id, regexp_extract_all(md, {q(fv.DISPLAY_FORMULA)}) shown, regexp_replace(md, {q(fv.DISPLAY_FORMULA)}, chr(57344) || chr(57345), 'g') rest from d),
i as (select doc_id, shown, rest, list_transform(regexp_extract_all(rest, {q(fv.INLINE_FORMULA)}, 1), lambda x: '$' || x || '$') kept from r),
e as (select doc_id, shown, kept, replace(replace(replace(replace(rest, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') t from i),
s as (select doc_id, shown, list_reduce(list_prepend(t, kept), lambda acc, f: replace(acc, replace(replace(replace(replace(f, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), f)) t from e),
p as (select doc_id, shown, string_split(t, chr(57344) || chr(57345)) parts from s)
select doc_id, md5(array_to_string(list_transform(range(1, len(parts) + 1), lambda n: parts[n] || coalesce(shown[n], '')), '')) html_md5 from p""")
def escaped_around_formulas(spark, folder):
    """The documents with formulas put in, escaped for HTML but for these."""
    d = views.table(spark, folder, "documents")
    put = F.concat(F.lit(' <$a<b$ & $$c<'), F.col("doc_id").cast("string"), F.lit('$$ "the" '))
    md = F.concat(F.lit("<b>"), F.replace("text", F.lit(" the "), put))
    return d.select("doc_id", F.md5(text.outside_formulas(md, text.escape_html)).alias("html_md5"))


# messages of a service: the reasons of pages, and what it says on the way, with numbers and
# words of the documents in it; the last ones are none of its messages
SAID = [
    ("已完成 {a}/{b} 页", "Done {a}/{b} {s}"), ("读取文字层 {a}/{b} 页", "Reading text layer {a}/{b} {s}"),
    ("续跑：已有 {a} 页存档，跳过", "Resuming: {a} {p} already archived"), ("补救 {a} 页失败的识别", "Retrying {a} failed pages"),
    ("第 {a} 页跳过", "Page {a} skipped"), ("正在使用 Surya 逐页解析 {a}", "Surya is parsing layout, tables and formulas page by page (the first run is slow)"),
    ("重新精校排队中，只重跑 {a} 页回退页 {l}", "Queued for re-refine, only {a} fallback pages will be re-run"),
    ("重新精校排队中 {a}", "Queued for re-refine, reusing the current result as the draft"), ("保留 {a} 页上次已成功的 AI 结果", "Keeping {a} {p} that AI already got right"),
    ("Chrome 打印中途退出（exit {l}）：{a}\n{b}", "Chrome exited while printing (exit {l}): {a}\n{b}"), ("请求超时（{b}s 未返回）。", "Request timed out ({b} s)."),
    ("图片转 PDF 失败：{l}", "Image → PDF failed: {l}"), ("图片转 PDF 失败：{l}\n{l}", "图片转 PDF 失败：{l}\n{l}"),
    ("连不上本机 Ollama（{l}）：{a}。{b}", "Can't reach local Ollama ({l}): {a}. Make sure Ollama is open (its icon is in the menu bar)."),
    ("{b} 页待识别，按 {a} 页一组滚动生成图像", "{b} {q} to recognize, rendering {a} at a time"), ("已取消 {a}", "已取消 {a}"), ("{l}", "{l}"),
]


def _said_sql(template: str) -> str:
    """The message as SQL over n (a number) and l (a word)."""
    plural = lambda n: f"case when {n} = 1 then 'page' else 'pages' end"
    # a number behind a slash stays plural
    parts = {"{a}": "a", "{b}": "b", "{l}": "l", "{p}": plural("a"), "{q}": plural("b"), "{s}": "'pages'"}
    out = re.split(r"(\{\w\})", template)
    return " || ".join(parts[x] if x in parts else q(x).replace("\n", "' || chr(10) || '") for x in out if x)


@query("service_messages", with_(FINALS) + f"""
select m message, count(*) pages from (select case when starts_with(r, '{fv.REASON_REJECTED}') then 'AI result failed validation: ' || substr(r, length('{fv.REASON_REJECTED}') + 1)
  when starts_with(r, '{fv.REASON_FAILED_TEXT}') then 'AI failed, fell back to the text layer: ' || substr(r, length('{fv.REASON_FAILED_TEXT}') + 1)
  when starts_with(r, '{fv.REASON_FAILED_EMPTY}') then 'AI failed and this page has no text layer to fall back to: ' || substr(r, length('{fv.REASON_FAILED_EMPTY}') + 1)
  when r = '{fv.REASON_NO_TEXT}（photo）' then 'AI detection: no extractable text (photo)'
  when r = '{fv.REASON_UNREADABLE}' then 'Unreadable symbols remain in the result' when r = '{fv.REASON_UNCERTAIN}symbol' then 'Model marked as uncertain: symbol'
  when r = '{fv.REASON_THIN_TEXT}' then 'Very little text layer; use High accuracy for scanned or formula pages' end m
  from (select unnest(reasons) r from finals)
  union all select case k {' '.join(f"when {i} then {_said_sql(said)}" for i, (_, said) in enumerate(SAID))} end
  from (select doc_id % {len(SAID)} k, cast(n_chars % 4 as varchar) a, cast(n_chars % 3 as varchar) b, lang l from documents)) group by 1""")
def service_messages(spark, folder):
    reasons = lib_finals(spark, folder).select(F.explode("reasons").alias("r"))
    d = views.table(spark, folder, "documents")
    words = {"a": (F.col("n_chars") % 4).cast("string"), "b": (F.col("n_chars") % 3).cast("string"), "l": F.col("lang")}
    said = F.coalesce(*(
        F.when(F.col("doc_id") % len(SAID) == i, F.concat(*(words.get(x[1:-1], F.lit(x)) for x in re.split(r"(\{\w\})", template) if x)))
        for i, (template, _) in enumerate(SAID)))
    every = reasons.unionAll(d.select(said.alias("r")))
    # each distinct text is translated once
    distinct = every.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy(text.translate_service_text(F.col("r")).alias("message")).agg(F.sum("n").alias("pages"))


@query("method_labels", with_(FINALS) + """
select case when method = 'ai' then 'gemini · gemini-2.5-flash' when method = 'empty' then 'AI 未通过 · 这页没有文字层可回退，结果为空' when method = 'text' then 'AI 未通过 · 已回退 PDF 文字层' end label, count(*) pages
from finals group by 1""")
def method_labels(spark, folder):
    from quire.functions import labels

    return lib_finals(spark, folder).groupBy(labels.method_label().alias("label")).agg(F.count(F.lit(1)).alias("pages"))


@query("document_sections", with_(FINALS) + """
select job_id, page, md5('## PDF 第 ' || page || ' 页' || chr(10) || chr(10) || case when markdown <> '' then markdown when outcome = 'noText' then
    '_[AI 检测：此页没有可提取的文字（photo）。]_' else '_[此页未检测到文字，请查看原始 PDF。]_' end || chr(10) || chr(10) || '---' || chr(10)) section_md5 from finals""")
def document_sections(spark, folder):
    return pages.page_sections(lib_finals(spark, folder)).select("job_id", "page", F.md5("section").alias("section_md5"))


@query("nothing_to_rerun", with_(FINALS) + "select job_id from finals group by job_id having count(*) filter (where outcome = 'fallback') = 0")
def nothing_to_rerun(spark, folder):
    return pages.nothing_to_rerun(lib_finals(spark, folder))


@query("page_time_labels", with_(PAGES) + """
select job_id, page, '耗时 ' || cast(cast(floor(ms / 1000 * 10 + 0.5) / 10 as decimal(30,1)) as varchar) || ' 秒' ||
  case when ms - m >= 1000 then ' · 模型 ' || cast(cast(floor(m / 1000 * 10 + 0.5) / 10 as decimal(30,1)) as varchar) || ' 秒' else '' end label
from (select job_id, page, length(markdown) * 9 ms, case when page % 3 <> 0 then length(markdown) * 4 end m from lib_pages)""")
def page_time_labels(spark, folder):
    from quire.functions import labels

    size = F.char_length("markdown")
    label = labels.page_time_label(size * 9, F.when(F.col("page") % 3 != 0, size * 4))
    return lib_pages(spark, folder).select("job_id", "page", label.alias("label"))
