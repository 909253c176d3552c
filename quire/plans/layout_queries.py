"""Layout, HTML and print chunks over the given texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators import layout
from quire.plans.registry import query
from quire.plans.views_sql import FORMULAS, LINES, OPTIONS, SQUASH, TRIM, VISIBLE, q
from quire.sources import views


@query("html_to_markdown")
def html_to_markdown(spark, folder):
    p = views.table(spark, folder, "pages").select("page_id", "html")
    return layout.html_pages(p).select("page_id", "markdown", "formula_lost")


@query("block_pages")
def block_pages(spark, folder):
    """Each page's paragraphs as recognised blocks with labels in turn."""
    p = views.table(spark, folder, "pages").select("page_id", "html")
    labels = F.array(*[F.lit(x) for x in ("Text", "PageHeader", "Picture", "Equation", "Text", "Diagram")])
    parts = F.split("html", "(?=<p>)", -1)
    blocks = F.transform(parts, lambda h, i: F.struct(
        F.get(labels, (i + F.col("page_id")).cast("int") % 6).alias("label"), F.when((i % 7) != 2, h).alias("html"),
        F.when(i % 5 != 4, (i * 7 % 11).cast("int")).alias("reading_order"), (i % 13 == 12).alias("error")))
    return layout.block_pages(p.select("page_id", blocks.alias("blocks")), ["page_id"]).withColumn("reasons", F.array_join("reasons", "|"))


# on this grid every twelve words are one row, so rows need no clustering in the
# check; whether a row opens a block follows from the last opener and the last
# row that a block could go on after
@query("layout_to_markdown", f"""
with w as (select doc_id, unnest(ws) w, unnest(range(len(ws))) i from (select doc_id, regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') ws from documents)),
k as (select doc_id, w, i // 12 r, i % 12 * 50 x, length(w) * 8 wd, case when i < 12 then 24 else 12 end sz from w where {TRIM('w')} <> ''),
b as (select doc_id, case when count(*) filter (sz = 12) > count(*) // 2 then 12 else 24 end body, length({TRIM("string_agg(w, '' order by r, x)")}) raw from k group by doc_id),
g as (select *, lag(x + wd) over (partition by doc_id, r order by x) e from k),
t as (select doc_id, r, any_value(sz) sz, {TRIM(SQUASH("regexp_replace(string_agg(case when x - e > greatest(2.5, sz * 0.24) then ' ' || w else w end, '' order by x), " + q(fv.ESCAPABLE) + ", " + q(chr(92) * 3 + "1") + ", 'g')"))} txt from g group by 1, 2),
c as (select t.doc_id, r, body, txt, r - lag(r) over (partition by t.doc_id order by r) gap, row_number() over (partition by t.doc_id order by r) n,
    case when sz > body * {fv.HEADING_RATIO} and length(txt) < {fv.HEADING_CHARS} then 'h' when sz > body * {fv.SUBHEADING_RATIO} and length(txt) < {fv.SUBHEADING_CHARS} then 'hh'
      when regexp_matches(txt, '^[•●▪◦]') then 'b' when regexp_matches(txt, '^[0-9]+[.)] ') then 'n' else 'p' end kind
  from t join b on b.doc_id = t.doc_id where txt <> ''),
d as (select *, case kind when 'h' then '### ' || txt when 'hh' then '#### ' || txt when 'b' then '- ' || ltrim(substr(txt, 2)) when 'n' then regexp_replace(txt, '^([0-9]+)[.)] +', '\\1. ') else txt end out,
    kind <> 'p' or n = 1 or gap * 14 >= body * {fv.PARAGRAPH_GAP} opener from c),
o as (select *, coalesce(max(case when opener then n end) over (partition by doc_id order by n rows unbounded preceding), 0)
      > coalesce(max(case when out[1] not in ('#', '-') then n end) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) opens from d),
j as (select *, lead(opens) over (partition by doc_id order by n) nxt from o),
m as (select doc_id, string_agg(case when nxt is null then out when nxt then out || chr(10) || chr(10) when out[-1] = '-' then left(out, -1) else out || ' ' end, '' order by n) md from j group by doc_id),
f as (select doc_id, coalesce(md, '') markdown, coalesce(raw, 0) raw from documents left join m using (doc_id) left join b using (doc_id))
select doc_id, markdown, {VISIBLE('markdown')} as "char_count", {LINES('markdown')} line_count, {FORMULAS('markdown')} formula_count, {OPTIONS('markdown')} option_count,
  case when markdown <> '' then 'text' else 'empty' end as method, case when raw < {fv.THIN_TEXT} then 'review' else 'good' end status, case when raw < {fv.THIN_TEXT} then {q(fv.REASON_THIN_TEXT)} else '' end reasons from f""")
def layout_to_markdown(spark, folder):
    """The words of each document set in twelve columns, the first row larger."""
    d = views.table(spark, folder, "documents").select("doc_id", "text")
    items = F.transform(F.split("text", r"\s+", -1), lambda w, i: F.struct(
        w.alias("text"), (i % 12 * 50.0).alias("x"), (700.0 - F.floor(i / 12) * 14.0).cast("double").alias("y"),
        (F.char_length(w) * 8.0).alias("width"), F.when(i < 12, F.lit(24.0)).otherwise(F.lit(12.0)).alias("size")))
    pages = d.select("doc_id", items.alias("items"))
    return layout.text_layer_pages(pages, ["doc_id"]).withColumn("reasons", F.array_join("reasons", "|"))


# the given texts hold no code fences, so the check tracks formula blocks only
@query("print_chunks", f"""
with recursive l as (
  select doc_id, n, unnest(parts) line, unnest(range(1, n + 1)) i from (
    select doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10)) parts, len(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10))) n from documents)),
m as (
  select doc_id, n, i, line, {TRIM('line')} = '' blank, regexp_matches(line, '^ {{0,3}}#{{1,6}}{fv.WS}') head,
    strlen(line) + 1 bytes, (length(line) - length(replace(line, '$$', ''))) // 2 % 2 = 1 odd from l),
r as (
  select distinct doc_id, cast(0 as bigint) i, cast(0 as bigint) size, false filled, false math, 0 chunk from m
  union all
  select doc_id, i, case when cut then 0 else size end + bytes, (filled and not cut) or not blank, math <> odd, chunk + case when cut then 1 else 0 end from (
    select m.doc_id, m.i, r.size, r.filled, r.math, r.chunk, m.bytes, m.blank, m.odd,
      r.filled and not r.math and ((r.size >= 2000 and m.head) or (r.size >= 4000 and m.blank)) cut
    from r join m on m.doc_id = r.doc_id and m.i = r.i + 1)),
f as (select r.*, m.line, last_value(r.filled) over w full_end, last_value(r.chunk) over w last_chunk
  from r join m on m.doc_id = r.doc_id and m.i = r.i window w as (partition by r.doc_id order by r.i rows between unbounded preceding and unbounded following))
select doc_id, c as chunk, string_agg(line, chr(10) order by i) markdown from (
  select *, case when chunk = last_chunk and not full_end and chunk > 0 then chunk - 1 else chunk end c from f) group by 1, 2""")
def print_chunks(spark, folder):
    """Documents with a blank line between their lines, cut for printing."""
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("markdown")
    d = views.table(spark, folder, "documents").select("doc_id", spaced)
    return layout.chunked(d, ["doc_id"], target=2000)
