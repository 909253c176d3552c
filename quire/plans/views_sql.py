"""The views of ``quire.sources.views`` in SQL, as CTE bodies."""

from __future__ import annotations

from quire import fixed_values as fv
from quire.sources.views import NOW


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


WS_SQL = "(" + "||".join(f"chr({ord(c)})" for c in fv.WS_CHARS) + ")"
TRIM = lambda x: f"trim({x}, {WS_SQL})"
SQUASH = lambda x: f"regexp_replace({x}, {q(fv.WS + '+')}, ' ', 'g')"
FOLD = lambda x: f"translate({x}, '{fv.ASCII_UPPER}', '{fv.ASCII_LOWER}')"
ROUND = lambda x, k: f"(floor(({x}) * {float(10**k)} + 0.5) / {float(10**k)})"
FORMULAS = lambda x: f"len(regexp_extract_all({x}, {q(fv.FORMULA)}))"
OPTIONS = lambda x: f"len(regexp_extract_all({x}, {q(fv.OPTION)}))"
VISIBLE = lambda x: f"length(translate({x}, {q(fv.MARK_CHARS)} || {WS_SQL}, ''))"
LINES = lambda x: f"(case when {x} = '' then 0 else len(regexp_split_to_array({x}, '\\n+')) end)"
TAGS = lambda x: f"""coalesce(from_json(case when json_valid({x}) and json_type({x}) = 'ARRAY' then {x} end, '["VARCHAR"]'), [])"""
CLIP = lambda x, n: f"(case when length({x}) > {n} then left({x}, {n}) || '…' else {x} end)"

PAGES = """lib_pages as (
  select doc_id as job_id, cast(unnest(range(1, len(l) + 1)) as int) as page, unnest(l) as markdown
  from (select doc_id, string_split(text, chr(10)) l from documents))"""

JOBS = f"""li as (select l_orderkey, count(*) as n, cast(sum(l_quantity) as bigint) as q from lineitem group by l_orderkey),
jobs0 as (
  select o.o_orderkey k, o.o_custkey ck, c.c_name, c.c_mktsegment seg, o.o_orderpriority pri,
    coalesce(li.n, 0) pages, coalesce(li.q, 0) q, cast(floor(o.o_totalprice) as bigint) ms,
    o.o_orderdate + to_seconds(o.o_orderkey * 37 % 86400) created
  from orders o join customer c on o.o_custkey = c.c_custkey left join li on li.l_orderkey = o.o_orderkey),
lib_jobs as (
  select cast(k as varchar) id, 'Doc_' || (k % 400) || case when k % 5 = 0 then '.docx' else '.pdf' end filename,
    ms % 4096 as file_size, substr(pri, 1, 1) as mode,
    case when k % 10 < 7 then 'done' when k % 10 = 7 then 'failed' when k % 10 = 8 then 'running' else 'queued' end status,
    created created_at, created + to_seconds(ms // 1000) finished_at, created + to_seconds(ms // 1000) updated_at,
    pages page_count, q char_count, case when pages = 0 then 0 else k % (pages + 1) end review_count,
    (case when pages = 0 then 0 else k % (pages + 1) end) // 2 fallback_count,
    case when ck % 3 = 0 then cast(ck as varchar) end batch_id, case when ck % 3 = 0 then c_name end batch_label,
    ms duration_ms,
    case when k % 11 = 0 then null when k % 13 = 0 then '[bad' else '["' || seg || '","' || substr(pri, 3) || '"]' end tags,
    case when k % 4 = 0 then 'Report ' || c_name end ai_title,
    case when k % 6 = 0 then seg || ' | order of ' || substr(pri, 3) end ai_one_line,
    case when k % 7 = 0 then null else k % 2 = 0 end filename_meaningful,
    least(k % 9, pages) page
  from jobs0)"""

CALLS = """lib_calls as (
  select event_id, ts, event_type as provider,
    case user_id % 6 when 0 then 'gemini-2.5-flash' when 1 then 'gemini-2.5-pro' when 2 then 'gemini-2.5-flash-lite-001'
      when 3 then 'kimi-k2.6' when 4 then 'gemini-3.5-flash' else 'unlisted-model' end as model,
    case event_id % 4 when 0 then 'refine' when 1 then 'card' when 2 then 'reflect' else 'find' end as purpose,
    cast(user_id as varchar) as ref, cast(event_id % 50 as int) as page,
    cast(floor(value * 1000) as bigint) as input_tokens, event_id % 4000 as output_tokens,
    cast(floor(value * 250) as bigint) as cached_tokens, (event_id % 7) * 10 as thinking_tokens,
    case when event_id % 9 = 0 then value / 100 end as reported_cost
  from events)"""


def _price_rows() -> str:
    rows = []
    for name, tiers, cached in fv.PRICES:
        low = 0
        for limit, i, o in tiers:
            high = "cast(null as bigint)" if limit is None else str(limit)
            rows.append(f"('{name}', {low}, {high}, {float(i)}::double, {float(o)}::double, {float(cached)}::double)")
            low = (limit or 0) + 1
    return ", ".join(rows)


PRICED = CALLS + f""",
price_list(name, low, high, rin, rout, rcached) as (values {_price_rows()}),
model_price as (
  select m.model, coalesce(max(case when p.name = m.model then p.name end),
                           max_by(p.name, length(p.name))) name
  from (select distinct model from lib_calls) m join price_list p on starts_with(m.model, p.name) group by m.model),
calls as (
  select c.*, case when c.reported_cost is not null then c.reported_cost else
      floor((greatest(0, c.input_tokens - c.cached_tokens) * p.rin + c.cached_tokens * p.rcached
        + (c.output_tokens + c.thinking_tokens) * p.rout) / 1e6 * 1e6 + 0.5) / 1e6 end cost_usd,
    case when c.reported_cost is not null then 'reported' when p.name is not null then 'table' end cost_source, m.name price_name
  from lib_calls c left join model_price m on m.model = c.model
  left join price_list p on p.name = m.name and c.input_tokens >= p.low and (p.high is null or c.input_tokens <= p.high))"""

DRAFTS = PAGES + f""",
drafts as (
  select job_id, page, markdown, {VISIBLE('markdown')} char_count, {LINES('markdown')} line_count,
    case when markdown <> '' then 'text' else 'empty' end as method,
    case when length({TRIM('markdown')}) < {fv.THIN_TEXT} then 'review' else 'good' end status,
    case when length({TRIM('markdown')}) < {fv.THIN_TEXT} then [{q(fv.REASON_THIN_TEXT)}] else []::varchar[] end reasons,
    {FORMULAS('markdown')} formula_count, {OPTIONS('markdown')} option_count
  from lib_pages)"""

FINALS = DRAFTS + f""",
replies as (
  select job_id, page,
    case (job_id + page) % 6 when 2 then left(markdown, length(markdown) // 5) when 3 then replace(markdown, '$', '')
      when 4 then markdown || ' [unclear]' when 5 then markdown end r_markdown,
    (job_id + page) % 6 = 1 r_no_text,
    case when (job_id + page) % 6 = 4 then ['symbol'] else []::varchar[] end r_uncertain,
    case when (job_id + page) % 6 = 0 then case (job_id + page) % 5 when 0 then '请求超时（90s 未返回）。' when 1 then 'fetch failed'
      when 2 then '模型请求失败（429）：Your prepayment credits are depleted.' when 3 then '模型没有返回有效 JSON。'
      else 'Something odd happened upstream' end end r_error
  from lib_pages),
checked as (
  select d.*, coalesce(r.r_markdown, '') reply, r.r_no_text, r.r_uncertain, r.r_error,
    case when r.r_no_text then [] else list_filter([
      case when {TRIM("coalesce(r.r_markdown, '')")} = '' then {q(fv.FAIL_BLANK)} end,
      case when d.char_count >= {fv.SHORT_DRAFT} and {VISIBLE("coalesce(r.r_markdown, '')")} < greatest({fv.SHORT_FLOOR}, d.char_count * {fv.SHORT_RATIO}::double) then {q(fv.FAIL_SHORT)} end,
      case when d.formula_count > 0 and {FORMULAS("coalesce(r.r_markdown, '')")} < d.formula_count then {q(fv.FAIL_FORMULA)} end,
      case when d.option_count >= 2 and {OPTIONS("coalesce(r.r_markdown, '')")} < d.option_count then {q(fv.FAIL_OPTION)} end],
      lambda x: x is not null) end failures
  from drafts d join replies r on r.job_id = d.job_id and r.page = d.page),
stepped as (
  select *, case when r_error is not null then 'failed' when len(failures) > 0 then 'rejected' when r_no_text then 'noText' else 'ok' end step
  from checked),
finals0 as (
  select job_id, page, step, failures, markdown raw_markdown,
    case step when 'ok' then {TRIM('reply')} when 'noText' then '' else markdown end markdown,
    case step when 'ok' then {VISIBLE('reply')} when 'noText' then 0 else char_count end char_count,
    case step when 'ok' then {LINES(TRIM('reply'))} when 'noText' then 0 else line_count end line_count,
    case when step in ('ok', 'noText') then 'ai' else method end as method,
    case step when 'ok' then list_concat(list_transform(r_uncertain, lambda x: {q(fv.REASON_UNCERTAIN)} || x),
        case when contains(reply, '[unclear]') then [{q(fv.REASON_UNREADABLE)}] else [] end)
      when 'noText' then ['{fv.REASON_NO_TEXT}（photo）']
      when 'rejected' then list_concat(reasons, ['{fv.REASON_REJECTED}' || array_to_string(failures, '{fv.FAILURE_JOINER}')])
      else list_concat(reasons, [case when markdown <> '' then '{fv.REASON_FAILED_TEXT}' else '{fv.REASON_FAILED_EMPTY}' end || r_error]) end reasons,
    case step when 'ok' then {FORMULAS('reply')} when 'noText' then 0 else formula_count end formula_count,
    case step when 'ok' then {OPTIONS('reply')} when 'noText' then 0 else option_count end option_count
  from stepped),
finals as (
  select *, case when step = 'ok' and len(reasons) = 0 then 'good' else 'review' end status,
    case step when 'ok' then 'ai' when 'noText' then 'noText' else 'fallback' end outcome
  from finals0)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


NOW_SQL = f"timestamp '{NOW}'"
