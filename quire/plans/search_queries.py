"""Search, look-up commands, catalogue and model answers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import answers
from quire.operators import search, search_index
from quire.plans.library_queries import DONE
from quire.plans.registry import query
from quire.plans.views_sql import FOLD, JOBS, PAGES, SQUASH, TAGS, TRIM, CLIP, q, with_
from quire.session import shared_dir
from quire.sources import views
from quire.sources.views import done_jobs, lib_jobs, lib_pages

TERM = "The "
N = "the"
BS1 = chr(92) + "1"
TIDY = lambda x: SQUASH(f"regexp_replace(regexp_replace(regexp_replace({x}, {q(fv.IMAGE_MARKUP)}, '{BS1}', 'g'), {q(fv.LINK_MARKUP)}, '{BS1}', 'g'), {q(fv.SNIPPET_MARKS)}, ' ', 'g')")
FLAT = lambda x: TRIM(SQUASH(f"regexp_replace(regexp_replace({x}, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), {q(fv.SNIPPET_MARKS)}, ' ', 'g')"))
COUNT = lambda f, n: f"((length({f}) - length(replace({f}, '{n}', ''))) // {len(n)})"
HITS = with_(PAGES) + f""",
f as (select *, {FOLD('markdown')} f from lib_pages where contains({FOLD('markdown')}, '{N}')),
counts as (select job_id, cast(sum({COUNT('f', N)}) as bigint) hits from f group by job_id),
top as (select * from counts order by hits desc, job_id limit {fv.SEARCH_LIMIT})"""


def offsets(f: str, n: str) -> str:
    """Zero-based offsets of the occurrences of n in f, as a list."""
    pieces = f"string_split({f}, '{n}')"
    return f"list_transform(range(1, len({pieces})), lambda i: cast(list_sum(list_transform({pieces}[1:i], lambda s: length(s))) as bigint) + (i - 1) * {len(n)})"


@query("search_counts", HITS + "select * from top")
def search_counts(spark, folder):
    return search.search(lib_pages(spark, folder), TERM)


INDEXED = ["tion", "OU", "the ", "e. "]


@query("indexed_search", with_(PAGES) + f""",
n as (select unnest([{', '.join(q(x) for x in INDEXED)}]) needle),
c as (select needle, job_id, {FOLD('markdown')} f, trim({FOLD('needle')}) k from lib_pages, n where job_id % 7 <> 0 and length(trim(needle)) >= 2)
select needle, cast(job_id as varchar) job_id, cast(sum((length(f) - length(replace(f, k, ''))) // length(k)) as bigint) hits from c where contains(f, k) group by 1, 2""")
def indexed_search(spark, folder):
    """The index of older texts, brought up to date (a third have changed, one in seven are gone)
    and searched."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    p, k = lib_pages(spark, folder), F.col("job_id")
    jobs = p.select(k.alias("id")).distinct()
    old = p.withColumn("markdown", F.when(k % 3 == 0, F.reverse("markdown")).otherwise(F.col("markdown")))
    search_index.sync(jobs.withColumn("updated_at", F.lit("1")), old, path)
    now = jobs.filter(F.col("id") % 7 != 0).withColumn("updated_at", F.when(F.col("id") % 3 == 0, "2").otherwise("1"))
    search_index.sync(now, p, path)
    found = [search_index.hit_counts(spark, path, n).select(F.lit(n).alias("needle"), "job_id", "hits") for n in INDEXED]
    return reduce(DataFrame.unionByName, found)


@query("search_hits", HITS + f""",
e as (select job_id, page, markdown, unnest({offsets('f', N)}[1:{fv.HITS_PER_DOC}]) as pos from f where job_id in (select job_id from top)),
r as (select *, row_number() over (partition by job_id order by page, pos) hit, greatest(0, pos - {fv.CONTEXT}) s, least(length(markdown), pos + {len(N)} + {fv.CONTEXT}) t from e)
select job_id, hit, page, case when s > 0 then '…' else '' end || ltrim({TIDY('substr(markdown, s + 1, pos - s)')}, ' ') before,
  substr(markdown, pos + 1, {len(N)}) as match,
  rtrim({TIDY(f'substr(markdown, pos + {len(N)} + 1, t - pos - {len(N)})')}, ' ') || case when t < length(markdown) then '…' else '' end after
from r where hit <= {fv.HITS_PER_DOC}""")
def search_hits(spark, folder):
    return search.search_hits(lib_pages(spark, folder), TERM)


def _words_sql(words: list[str], any_: bool) -> str:
    cs = ", ".join(f"cast(sum({COUNT('lower(markdown)', w)}) as bigint) c{i}" for i, w in enumerate(words))
    inm = [f"contains(meta, '{w}')" for w in words]
    found = [f"({m} or coalesce(c{i}, 0) > 0)" for i, m in enumerate(inm)]
    return with_(DONE, PAGES) + f""",
pd as (select cast(job_id as varchar) id, {cs} from lib_pages group by 1),
m as (select *, lower(concat_ws(' ', coalesce(ai_title, ''), filename, coalesce(ai_one_line, ''), array_to_string({TAGS('tags')}, ' '))) meta from done),
x as (select m.id, m.created_at, {' + '.join(f'coalesce(c{i}, 0)' for i in range(len(words)))} + case when {' or '.join(inm)} then {fv.META_BONUS} else 0 end score
  from m left join pd on pd.id = m.id where {(' or ' if any_ else ' and ').join(found)})
select id, score, (select count(*) from x) total from x order by score desc, created_at desc, id limit {fv.WORD_LIMIT}"""


WORDS = ["building", "the"]


@query("word_search_all", _words_sql(WORDS, False))
def word_search_all(spark, folder):
    found = search.word_search(done_jobs(spark, folder), lib_pages(spark, folder), WORDS)
    return search.top_scores(found).select("id", "score", "total")


@query("word_search_any", _words_sql(WORDS, True))
def word_search_any(spark, folder):
    found = search.word_search(done_jobs(spark, folder), lib_pages(spark, folder), WORDS, match_any=True)
    return search.top_scores(found).select("id", "score", "total")


def _snippets_sql(words: list[str], per_doc: int) -> str:
    union = " union all ".join(
        f"select job_id, page, markdown, {i} word, {len(w)} size, unnest({offsets('lower(markdown)', w)}[1:{per_doc}]) pos from lib_pages where contains(lower(markdown), '{w}')"
        for i, w in enumerate(words))
    return with_(PAGES) + f""",
e as ({union}),
r as (select *, row_number() over (partition by job_id order by page, word, pos) n, greatest(0, pos - {fv.WORD_SNIPPET}) s, least(length(markdown), pos + size + {fv.WORD_SNIPPET}) t from e)
select job_id, n, page, case when s > 0 then '…' else '' end || {FLAT('substr(markdown, s + 1, t - s)')} || case when t < length(markdown) then '…' else '' end snippet from r where n <= {per_doc}"""


@query("word_snippets", _snippets_sql(["was", "and"], fv.SNIPPETS_PER_DOC))
def word_snippets(spark, folder):
    return search.word_snippets(lib_pages(spark, folder), ["Was", "and"])


@query("word_hits", _snippets_sql(["was"], fv.WORD_LIMIT))
def word_hits(spark, folder):
    return search.word_hits(lib_pages(spark, folder), "was")


@query("read_window", with_(PAGES) + f""",
p as (select job_id, arg_min(page, page) page, arg_min(markdown, page) md from lib_pages where contains(lower(markdown), 'was') group by job_id),
s as (select *, greatest(0, instr(lower(md), 'was') - 1 - {fv.READ_CHARS // 3}) s from p)
select job_id, page, s "start", substr(md, s + 1, {fv.READ_CHARS}) "text", s + {fv.READ_CHARS} < length(md) more from s""")
def read_window(spark, folder):
    return search.read_window(lib_pages(spark, folder), "was")


@query("document_outline", with_(PAGES) + f""",
dressed as (select job_id, page, case when page % 2 = 0 then repeat('#', page % 5 + 1) || ' ' || markdown else markdown end md from lib_pages),
l as (select job_id, page, unnest(string_split(md, chr(10))) raw, unnest(range(len(string_split(md, chr(10))))) line from dressed),
h as (select *, regexp_extract(raw, {q(fv.HEADING_1_TO_3)}, 1) h from l),
r as (select *, row_number() over (partition by job_id order by page, line) n from h where h <> '')
select job_id, n, page, {CLIP(FLAT('h'), fv.OUTLINE_CLIP)} heading from r where n <= {fv.OUTLINE_LIMIT}""")
def document_outline(spark, folder):
    p = lib_pages(spark, folder)
    marks = F.expr("repeat('#', page % 5 + 1)")
    md = F.when(F.col("page") % 2 == 0, F.concat(marks, F.lit(" "), F.col("markdown"))).otherwise(F.col("markdown"))
    return search.outline(p.withColumn("markdown", md))


@query("prefix_resolve", with_(JOBS) + """,
refs as (select distinct cast(p_partkey * 7 as varchar) ref from part where length(cast(p_partkey * 7 as varchar)) >= 4)
select ref, count(id) matches, case when count(id) = 1 then min(id) end id from refs left join lib_jobs on starts_with(id, ref) group by ref""")
def prefix_resolve(spark, folder):
    refs = views.table(spark, folder, "part").select((F.col("p_partkey") * 7).cast("string").alias("ref"))
    return search.resolve_prefixes(lib_jobs(spark, folder).select("id"), refs)


CELL = lambda x, n: CLIP(TRIM(SQUASH(f"regexp_replace(coalesce({x}, ''), '[|\\r\\n\\t]+', ' ', 'g')")), n)
CAT = with_(DONE) + f""",
n as (select *, row_number() over (order by created_at desc, id) n from done),
l as (select n, id, concat_ws(' | ', n, strftime(created_at, '%Y-%m-%d'), {CELL("coalesce(nullif(ai_title, ''), filename)", 40)}, {CELL("nullif(ai_one_line, '')", 70)},
    {CELL(f"array_to_string({TAGS('tags')}, '、')", 40)}, {CELL('filename', 60)}, page_count || '页') f,
  concat_ws(' | ', n, strftime(created_at, '%Y-%m-%d'), {CELL("coalesce(nullif(ai_title, ''), filename)", 40)}, '', '', {CELL('filename', 60)}, page_count || '页') s from n),
cat as (select n, id, {{form}} line from l)"""


@query("catalog_lines", CAT.replace("{form}", "s") + "select n, id, line from cat")
def catalog_lines(spark, folder):
    return search.catalog(done_jobs(spark, folder), full=False)


@query("catalog_lines_full", CAT.replace("{form}", "f") + "select n, id, line from cat")
def catalog_lines_full(spark, folder):
    return search.catalog(done_jobs(spark, folder))


@query("find_results", with_(DONE) + """,
n as (select id, row_number() over (order by created_at desc, id) n from done),
a as (select c_nationkey question, c_custkey pos, c_custkey % 37 * 11 n, c_name why from customer),
f as (select question, id, min(pos) pos, arg_min(why, pos) why from a join n on n.n = a.n group by 1, 2),
r as (select *, row_number() over (partition by question order by pos) rank from f)
select question, rank, id, why from r where rank <= 8""")
def find_results(spark, folder):
    c = views.table(spark, folder, "customer")
    picks = c.select(
        F.col("c_nationkey").alias("question"), F.col("c_custkey").alias("position"),
        (F.col("c_custkey") % 37 * 11).cast("string").alias("n"), F.col("c_name").alias("why"))
    return search.find_results(picks, search.catalog(done_jobs(spark, folder)).select("n", "id"))


@query("deep_results", with_(DONE) + """,
a as (select c_nationkey question, c_custkey pos, cast(c_custkey * 9 as varchar) d, c_custkey % 9 page, c_name why from customer),
u as (select d, min(id) id from (select distinct d from a where length(d) >= 4) x join done on starts_with(id, d) group by d having count(*) = 1),
f as (select question, u.id, min(pos) pos, arg_min(case when a.page between 1 and page_count then a.page end, pos) p0, arg_min(row(a.page, page_count), pos) pp, arg_min(why, pos) why
  from a join u on u.d = a.d join done on done.id = u.id group by 1, 2),
r as (select *, row_number() over (partition by question order by pos) rank from f)
select question, rank, id, case when pp[1] between 1 and pp[2] then pp[1] end page, why from r where rank <= 8""")
def deep_results(spark, folder):
    c = views.table(spark, folder, "customer")
    k = F.col("c_custkey")
    picks = c.select(
        F.col("c_nationkey").alias("question"), k.alias("position"), (k * 9).cast("string").alias("d"),
        (k % 9).cast("string").alias("page"), F.col("c_name").alias("why"))
    return search.deep_results(picks, done_jobs(spark, folder))


@query("page_answers", f"""
with a as (select doc_id, doc_id % 5 k, text t from documents)
select doc_id, case when k in (0, 1) then {TRIM('t')} else '' end markdown, k = 2 no_text, case when k = 2 then 'photo of ' || doc_id else '' end note,
  case when k in (0, 1) then greatest(0, doc_id % 7 - 2) else 0 end formula_count,
  case when k in (0, 1) then 'q1|q2' else '' end questions,
  case when k = 3 then '模型返回了空白 Markdown。' when k = 4 then '模型没有返回有效 JSON。' end error from a""")
def page_answers(spark, folder):
    """Raw answers derived from the documents: fenced, wrapped, empty and broken ones."""
    k = F.col("doc_id") % 5
    body = F.to_json(F.struct(
        F.when(k < 2, F.col("text")).otherwise("").alias("markdown"), (F.col("doc_id") % 7 - 2).alias("formulaCount"),
        F.array(F.lit("q1"), F.lit("q2")).alias("questionNumbers"), (k == 2).alias("noText"),
        F.when(k == 2, F.concat(F.lit("photo of "), F.col("doc_id").cast("string"))).otherwise("").alias("note")))
    raw = (
        F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
        .when(k == 4, F.lit("no json at all")).otherwise(body)
    )
    docs = views.table(spark, folder, "documents").select("doc_id", raw.alias("raw"), k.alias("k"))
    a = answers.page_answers(docs, F.col("raw"), "a")
    text_ok = F.col("k") < 2
    return a.select(
        "doc_id", F.col("a.markdown").alias("markdown"), F.col("a.no_text").alias("no_text"), F.col("a.note").alias("note"),
        F.when(text_ok, F.col("a.formula_count")).otherwise(0).alias("formula_count"),
        F.when(text_ok, F.array_join("a.question_numbers", "|")).otherwise("").alias("questions"), F.col("a.error").alias("error"))


@query("card_answers", with_(JOBS) + f"""
select id, array_to_string({TAGS('tags')}[1:4], '|') tags, nullif(left(coalesce(ai_title, ''), 30), '') title, nullif(left(coalesce(ai_one_line, ''), 60), '') one_line, filename_meaningful meaningful
from lib_jobs where len({TAGS('tags')}) > 0""")
def card_answers(spark, folder):
    jobs = lib_jobs(spark, folder)
    tags = F.from_json("tags", "array<string>")
    body = F.to_json(F.struct(
        F.concat(F.array(F.lit("  ")), F.coalesce(tags, F.array().cast("array<string>"))).alias("tags"), F.col("ai_title").alias("title"),
        F.col("ai_one_line").alias("one_line"), "filename_meaningful"))
    raw = jobs.select("id", F.concat(F.lit("```\n"), body, F.lit("\n```")).alias("raw"))
    c = answers.card_answers(raw, F.col("raw"), "c")
    return c.select("id", F.array_join("c.tags", "|").alias("tags"), "c.title", "c.one_line", F.col("c.filename_meaningful").alias("meaningful"))


@query("narrative_answers", """
select c_custkey, case when c_custkey % 4 = 0 then null else 'In ' || c_mktsegment end headline, case when c_custkey % 4 = 0 then null else 'Mostly ' || c_name end narrative,
  case when c_custkey % 4 = 0 then null else c_mktsegment || '=' || case when c_custkey % 2 = 0 then c_mktsegment else 'Topic ' || c_nationkey end end topics from customer""")
def narrative_answers(spark, folder):
    c, k = F.col, F.col("c_custkey")
    body = F.to_json(F.struct(
        F.struct(F.when(k % 4 != 0, F.concat(F.lit("In "), c("c_mktsegment"), F.lit("..。"))).alias("headline"),
                 F.concat(F.lit(" Mostly "), c("c_name"), F.lit(" ")).alias("narrative")).alias("en"),
        F.array(F.struct(c("c_mktsegment").alias("tag"), F.when(k % 2 != 0, F.concat(F.lit("Topic "), c("c_nationkey").cast("string"))).alias("name_en"))).alias("topics")))
    raw = F.when(k % 3 == 0, F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Result: "), body))
    a = answers.narratives(views.table(spark, folder, "customer").select(k, raw.alias("raw")), F.col("raw"), "en", "a")
    return a.select("c_custkey", "a.headline", "a.narrative",
                    F.when(F.col("a").isNotNull(), F.array_join(F.transform("a.topics", lambda t: F.concat(t["tag"], F.lit("="), t["name"])), "|")).alias("topics"))


@query("command_steps", """
select o_orderkey, v as verb, case v when 'search' then o_orderpriority || '|' || o_orderkey when 'read' then cast(o_orderkey as varchar) || '|p' || (o_custkey % 9) when 'list' then '' end args
from (select *, case o_orderkey % 4 when 0 then 'search' when 1 then 'read' when 2 then 'list' else null end v from orders)""")
def command_steps(spark, folder):
    k = F.col("o_orderkey")
    o = views.table(spark, folder, "orders")
    ks = k.cast("string")
    command = (
        F.when(k % 4 == 0, F.concat(F.lit("python /opt/look.py search \""), F.col("o_orderpriority"), F.lit("\" "), ks, F.lit(" --any --n 5")))
        .when(k % 4 == 1, F.concat(F.lit("look read "), ks, F.lit(" --page "), (F.col("o_custkey") % 9).cast("string")))
        .when(k % 4 == 2, F.lit("bin/look list --since 2024-01-01")).otherwise(F.concat(F.lit("ls "), ks))
    )
    s = answers.command_steps(o.select(k, command.alias("command")), F.col("command"), out="s")
    return s.select("o_orderkey", "s.verb", F.array_join("s.args", "|").alias("args"))


@query("find_answers", with_(DONE) + """,
n as (select id, row_number() over (order by created_at desc, id) n from done),
a as (select c_custkey question, unnest([c_custkey % 37 * 11, c_nationkey + 1, c_custkey % 37 * 11, 10000000000]) n, unnest([0, 1, 2, 3]) pos, c_name from customer where c_mktsegment <> 'BUILDING'),
f as (select question, id, min(pos) pos, any_value(c_name) why from a join n on n.n = a.n group by 1, 2)
select question, row_number() over (partition by question order by pos) rank, id, why from f""")
def find_answers(spark, folder):
    """Raw answers, one per customer: with a repeated and an unknown number, in prose; one segment's answers are cut off."""
    k, why = F.col("c_custkey"), F.col("c_name")
    pick = lambda n: F.struct(n.cast("string").alias("n"), why.alias("why"))
    body = F.to_json(F.struct(F.array(pick(k % 37 * 11), pick(F.col("c_nationkey") + 1), pick(k % 37 * 11), pick(F.lit(10**10))).alias("results")))
    raw = F.when(F.col("c_mktsegment") == "BUILDING", F.replace(body, F.lit("}"), F.lit(""))).otherwise(F.concat(F.lit("I found: "), body, F.lit(" Good luck.")))
    picks = answers.find_picks(views.table(spark, folder, "customer").select(k.alias("question"), raw.alias("raw")), F.col("raw"))
    return search.find_results(picks.filter(F.col("error").isNull()), search.catalog(done_jobs(spark, folder)).select("n", "id"))
