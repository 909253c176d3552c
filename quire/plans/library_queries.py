"""Library listings and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import files, labels
from quire.functions.base import js_round
from quire.operators import library, search
from quire.plans.registry import query
from quire.plans.views_sql import FINALS, JOBS, NOW_SQL, PAGES, ROUND, SQUASH, TAGS, TRIM, FOLD, q, with_
from quire.sources import views
from quire.sources.views import NOW, done_jobs, lib_finals, lib_jobs, lib_pages

DONE = JOBS + ",\ndone as (select * from lib_jobs where status = 'done')"
DAY = lambda c: F.date_format(c, "yyyy-MM-dd")
STAMP = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
STAMP_SQL = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
DAY_SQL = lambda c: f"strftime({c}, '%Y-%m-%d')"


@query("library_listing", with_(DONE) + f"""
select id, filename, {STAMP_SQL('created_at')} created_at, page_count from done order by done.created_at desc, id limit {fv.TIMELINE_LIMIT}""")
def library_listing(spark, folder):
    jobs = library.listing(done_jobs(spark, folder))
    return jobs.select("id", "filename", STAMP("created_at").alias("created_at"), "page_count")


@query("unfinished_jobs", with_(JOBS) + f"""
select id, status, {STAMP_SQL('created_at')} created_at from lib_jobs where status in ('queued', 'running')""")
def unfinished_jobs(spark, folder):
    return library.unfinished(lib_jobs(spark, folder)).select("id", "status", STAMP("created_at").alias("created_at"))


@query("jobs_in_range", with_(DONE) + """
select id, page_count from done where strftime(created_at, '%Y-%m-%d') between '1997-03-01' and '1997-06-30'""")
def jobs_in_range(spark, folder):
    return library.in_day_range(done_jobs(spark, folder), "1997-03-01", "1997-06-30").select("id", "page_count")


@query("recovered_jobs", with_(JOBS) + """
select id, case when s.p_partkey is not null then 'queued' else 'failed' end status,
  case when s.p_partkey is not null then '服务重启，已重新排队' end detail,
  case when s.p_partkey is null then '服务重启时源文件已丢失。' end error
from lib_jobs left join part s on cast(s.p_partkey as varchar) = id where status in ('queued', 'running')""")
def recovered_jobs(spark, folder):
    sources = views.table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return library.recovered(lib_jobs(spark, folder), sources)


@query("batch_summary", with_(JOBS) + f"""
select batch_id, label, total, done, active, failed, pages, {STAMP_SQL('c')} created_at, {STAMP_SQL('u')} updated_at from (
select batch_id, max(batch_label) as label, count(*) as total, count(*) filter (where status = 'done') done,
  count(*) filter (where status in ('queued', 'running')) active, count(*) filter (where status in ('failed', 'cancelled')) failed,
  cast(sum(page_count) as bigint) pages, min(created_at) c, max(updated_at) u
from lib_jobs where batch_id is not null group by batch_id order by c desc, batch_id limit {fv.BATCH_LIMIT})""")
def batch_summary(spark, folder):
    b = library.batch_summary(lib_jobs(spark, folder))
    return b.withColumn("created_at", STAMP("created_at")).withColumn("updated_at", STAMP("updated_at"))


@query("library_totals", with_(DONE) + """
select count(*) docs, cast(coalesce(sum(page_count), 0) as bigint) pages, cast(coalesce(sum(char_count), 0) as bigint) chars from done""")
def library_totals(spark, folder):
    return library.totals(done_jobs(spark, folder))


@query("daily_timeline", with_(DONE) + """
select strftime(created_at, '%Y-%m-%d') as day, cast(sum(page_count) as bigint) pages, count(*) docs from done group by 1""")
def daily_timeline(spark, folder):
    return library.daily(done_jobs(spark, folder)).withColumn("day", F.col("day").cast("string"))


@query("cumulative_pages", with_(DONE) + """,
days as (select cast(created_at as date) d, sum(page_count) p from done group by 1),
cal as (select cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) d from days)
select cast(cal.d as varchar) as day, cast(sum(coalesce(p, 0)) over (order by cal.d) as bigint) pages from cal left join days using (d)""")
def cumulative_pages(spark, folder):
    return library.cumulative_pages(done_jobs(spark, folder)).withColumn("day", F.col("day").cast("string"))


@query("top_tags", with_(DONE) + f"""
select tag, count(*) docs from (select unnest({TAGS('tags')}) tag from done) group by tag order by docs desc, tag limit {fv.TOP_TAGS}""")
def top_tags(spark, folder):
    return library.top_tags(done_jobs(spark, folder))


@query("docs_by_mode", with_(DONE) + """
select mode, count(*) docs, cast(sum(page_count) as bigint) pages from done group by mode""")
def docs_by_mode(spark, folder):
    return library.by_mode(done_jobs(spark, folder))


@query("speed_table", with_(DONE) + f""",
r as (select *, row_number() over (partition by mode order by finished_at desc, id) rn from done where duration_ms > 0 and page_count > 0)
select mode, count(*) n, case when count(*) >= 3 then {ROUND('median(duration_ms / 1000 / page_count)', 2)} end sec_per_page
from r where rn <= {fv.SPEED_WINDOW} group by mode""")
def speed_table(spark, folder):
    return library.speed_table(done_jobs(spark, folder))


@query("month_histogram", with_(DONE) + """
select strftime(created_at, '%Y-%m') as month, count(*) docs, cast(sum(page_count) as bigint) pages from done group by 1""")
def month_histogram(spark, folder):
    return library.months(done_jobs(spark, folder))


@query("quality_counts", with_(DONE) + """
select count(*) filter (where fallback_count > 0) fallback, count(*) filter (where review_count > 0 and fallback_count = 0) review from done""")
def quality_counts(spark, folder):
    return library.quality_counts(done_jobs(spark, folder))


@query("quality_badges", with_(DONE) + """
select case when fallback_count > 0 then 'bad' when review_count > 0 then 'soft' else 'good' end tone, count(*) docs from done group by 1""")
def quality_badges(spark, folder):
    return library.badges(done_jobs(spark, folder))


@query("library_filter", with_(DONE, PAGES) + f""",
hits as (select cast(job_id as varchar) id, cast(sum((length({FOLD('markdown')}) - length(replace({FOLD('markdown')}, 'build', ''))) // 5) as bigint) hits
  from lib_pages where contains({FOLD('markdown')}, 'build') group by 1)
select id, filename, coalesce(hits, 0) hits from done left join hits using (id)
where contains(lower(filename), 'build') or contains(lower(coalesce(ai_title, '')), 'build') or contains(lower(coalesce(ai_one_line, '')), 'build')
  or len(list_filter({TAGS('tags')}, lambda x: contains(lower(x), 'build'))) > 0 or hits is not null""")
def library_filter(spark, folder):
    hits = search.hit_counts(lib_pages(spark, folder), "build")
    return library.library_filter(done_jobs(spark, folder), "build", hits).select("id", "filename", "hits")


@query("library_timeline", with_(JOBS) + f""",
done as (select * from lib_jobs where status = 'done'),
batches as (select batch_id, max(updated_at) updated_at from lib_jobs where batch_id is not null group by 1),
entries as (
  select id entry, updated_at, 0 is_batch, 1 docs from done where batch_id is null
  union all
  select b.batch_id, b.updated_at, 1, count(*) from batches b join done d on d.batch_id = b.batch_id group by 1, 2),
runs as (select *, cast(updated_at as date) d,
  sum(is_batch) over (partition by cast(updated_at as date) order by updated_at desc, is_batch, entry rows unbounded preceding) run from entries)
select cast(d as varchar) as day, case when is_batch = 1 then 'batch:' || entry else 'run:' || run end row_key,
  {STAMP_SQL('max(updated_at)')} updated_at, cast(sum(docs) as bigint) docs, max(is_batch) is_batch
from runs group by 1, 2""")
def library_timeline(spark, folder):
    jobs = lib_jobs(spark, folder)
    rows = library.timeline(jobs.filter(F.col("status") == "done"), library.batch_summary(jobs, limit=None))
    return rows.withColumn("day", F.col("day").cast("string")).withColumn("updated_at", STAMP("updated_at"))


ENTRY_SQL = lambda name: f"""coalesce(nullif({TRIM(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({name}, {q(fv.SOURCE_EXTENSION)}, ''), {q('[/' + chr(92) * 2 + ']')}, '_', 'g'), {q('[:*?' + chr(34) + '<>|' + chr(92) + 'x00-' + chr(92) + 'x1f]')}, '_', 'g'), '^' || chr(92) || '.+', '')")}, ''), left(id, {fv.SHORT_ID}))"""


@query("unique_entry_names", with_(DONE) + f""",
b as (select id, created_at, {ENTRY_SQL('filename')} base from done),
n as (select id, base, row_number() over (partition by base order by created_at desc, id) n from b)
select id, base || case when n > 1 then ' (' || n || ')' else '' end || '.md' entry from n""")
def unique_entry_names(spark, folder):
    return library.unique_entry_names(done_jobs(spark, folder))


@query("stage_duplicates", with_(JOBS) + """,
done as (select * from lib_jobs where status = 'done'),
staged as (select id, filename, file_size from lib_jobs where status = 'queued'),
n as (select filename, max_by(id, row(created_at, id)) a from done group by 1),
s as (select filename, file_size, max_by(id, row(created_at, id)) a from done group by 1, 2)
select staged.id, staged.filename, staged.file_size,
  case when staged.filename like '%.pdf' and s.a is not null then s.a else n.a end match_id,
  staged.filename like '%.pdf' and s.a is not null exact
from staged left join s on s.filename = staged.filename and s.file_size = staged.file_size left join n on n.filename = staged.filename""")
def stage_duplicates(spark, folder):
    jobs = lib_jobs(spark, folder)
    staged = jobs.filter(F.col("status") == "queued").select("id", "filename", "file_size")
    return library.stage_duplicates(staged, jobs.filter(F.col("status") == "done"))


@query("batch_progress", with_(JOBS) + f"""
select batch_id,
  cast(floor(cast(sum(cast(case when status in ('done', 'failed', 'cancelled') then 100.0::double else coalesce(page / nullif(page_count, 0) * 100, 0) end as decimal(38,12))) as double) / count(*) + 0.5) as bigint) percent,
  cast(sum(case when status in ('done', 'failed', 'cancelled') then page_count else page end) as bigint) pages_done,
  cast(sum(page_count) as bigint) pages_total
from lib_jobs where batch_id is not null group by batch_id""")
def batch_progress(spark, folder):
    return library.batch_progress(lib_jobs(spark, folder))


@query("staged_estimate", with_(DONE) + f""",
r as (select *, row_number() over (partition by mode order by finished_at desc, id) rn from done where duration_ms > 0 and page_count > 0),
sp as (select mode, {ROUND('median(duration_ms / 1000 / page_count)', 2)} sec from r where rn <= 50 group by mode having count(*) >= 3),
st as (select mode, cast(sum(page_count) as bigint) pages, count(*) filter (where page_count is null) unknown from lib_jobs where status = 'queued' group by mode)
select st.mode as mode, pages, unknown, case when pages > 0 then {ROUND('pages * sec', 2)} end secs,
  case when pages > 0 then {ROUND('pages * 0.0125::double', 6)} end cost from st left join sp on sp.mode = st.mode""")
def staged_estimate(spark, folder):
    jobs = lib_jobs(spark, folder)
    speed = library.speed_table(jobs.filter(F.col("status") == "done"))
    return library.staged_estimate(jobs.filter(F.col("status") == "queued"), speed, 0.0125)


@query("job_eta", with_(DONE) + f""",
r as (select *, row_number() over (partition by mode order by finished_at desc, id) rn from done where duration_ms > 0 and page_count > 0),
sp as (select mode, {ROUND('median(duration_ms / 1000 / page_count)', 2)} sec from r where rn <= 50 group by mode having count(*) >= 3)
select id, case when page_count > 0 then cast(floor(greatest(0, page_count - page) *
    (case when duration_ms > 20000 and page >= 3 and page / page_count >= 0.1 then duration_ms / 1000 / nullif(page, 0) else sec end) + 0.5) as bigint) end eta
from lib_jobs j left join sp on sp.mode = j.mode where status = 'running'""")
def job_eta(spark, folder):
    jobs = lib_jobs(spark, folder)
    speed = library.speed_table(jobs.filter(F.col("status") == "done")).select("mode", "sec_per_page")
    running = jobs.filter(F.col("status") == "running").join(speed, "mode", "left")
    eta = labels.eta_seconds(F.col("page"), F.col("page_count"), F.col("duration_ms"), F.col("sec_per_page"))
    return running.select("id", eta.cast("long").alias("eta"))


@query("record_titles", with_(DONE) + f""",
t as (select id, created_at, coalesce({TRIM("coalesce(ai_title, '')")}, '') ti, filename_meaningful fm,
  regexp_replace(filename, {q(fv.SOURCE_EXTENSION)}, '') stem from done)
select id, case when fm = false and ti <> '' then ti else {TRIM(SQUASH("regexp_replace(stem, '_+', ' ', 'g')"))} end title,
  (case when fm = false and ti <> '' then left({TRIM(SQUASH("regexp_replace(ti, '[\\\\/:*?" + chr(34) + "<>|]', '', 'g')"))}, 80) else left({TRIM(SQUASH("regexp_replace(stem, '[\\\\/:*?" + chr(34) + "<>|]', '', 'g')"))}, 80) end) || ' ' || {DAY_SQL('created_at')} || '.md' download
from t""")
def record_titles(spark, folder):
    d = done_jobs(spark, folder)
    return d.select(
        "id",
        files.record_title(F.col("filename"), F.col("ai_title"), F.col("filename_meaningful")).alias("title"),
        files.download_name(F.col("filename"), F.col("ai_title"), F.col("filename_meaningful"), DAY("created_at"), "md").alias("download"),
    )


@query("index_actions", with_(DONE) + """,
old as (select cast(o_orderkey as varchar) id, case when o_custkey % 5 = 0 then timestamp '1990-01-01' else l.updated_at end stamp
  from orders left join lib_jobs l on l.id = cast(o_orderkey as varchar) where o_orderstatus <> 'P')
select coalesce(old.id, done.id) id, case when done.updated_at is null then 'drop' when old.stamp is null then 'load'
  when old.stamp = done.updated_at then 'keep' else 'reload' end "action"
from old full join done on done.id = old.id""")
def index_actions(spark, folder):
    orders = views.table(spark, folder, "orders").filter(F.col("o_orderstatus") != "P")
    jobs = lib_jobs(spark, folder)
    stamps = jobs.select("id", F.col("updated_at").alias("_u"))
    old = orders.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 5 == 0).alias("_old")).join(stamps, "id", "left")
    old = old.select("id", F.when(F.col("_old"), F.lit("1990-01-01").cast("timestamp_ntz")).otherwise(F.col("_u")).alias("stamp"))
    return library.reconcile_index(old, jobs.filter(F.col("status") == "done"))


@query("batch_members", with_(JOBS) + """,
recent as (select id, batch_id, page, 0 src from lib_jobs where status <> 'queued' and batch_id is not null),
lib as (select id, batch_id, page_count page, 1 src from lib_jobs where status = 'done' and batch_id is not null)
select id, batch_id, page from (select *, row_number() over (partition by id order by src) rn from (select * from recent union all select * from lib)) where rn = 1""")
def batch_members(spark, folder):
    jobs = lib_jobs(spark, folder).filter(F.col("batch_id").isNotNull())
    recent = jobs.filter(F.col("status") != "queued").select("id", "batch_id", "page")
    lib = jobs.filter(F.col("status") == "done").select("id", "batch_id", F.col("page_count").alias("page"))
    return library.members_from_two(recent, lib)


@query("job_transitions", with_(JOBS) + f"""
select id, case when status = 'running' then case when page_count > 3 then 'done' else 'cancelled' end else status end settled,
  {STAMP_SQL("case when status in ('done', 'failed') then " + NOW_SQL + " when status = 'queued' then null else finished_at end")} finished_at
from lib_jobs""")
def job_transitions(spark, folder):
    from quire.functions import page_state

    s = F.col("status")
    settled = F.when(s == "running", page_state.settle_cancelled(F.col("page_count") > 3)).otherwise(s)
    finish = page_state.patched_finish(s, F.col("finished_at").cast("timestamp"), F.lit(NOW).cast("timestamp"))
    return lib_jobs(spark, folder).select("id", settled.alias("settled"), STAMP(finish).alias("finished_at"))


@query("day_groups", with_(DONE) + f"""
select g as label, count(*) docs from (select case age when 0 then 'today' when 1 then 'yesterday' else
  case when age > 1 and age < 7 then dayname(d) else cast(d as varchar) end end g
  from (select cast(created_at as date) d, date_diff('day', cast(created_at as date), cast({NOW_SQL} as date)) age from done)) group by 1""")
def day_groups(spark, folder):
    label = labels.day_group(F.to_date("created_at"), F.lit(NOW).cast("date"))
    return done_jobs(spark, folder).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("docs"))


@query("file_order", """
select p_partkey, p_name, array_to_string(list_transform(regexp_extract_all(lower(p_name), '(\\d+|\\D+)'),
  lambda x: case when regexp_matches(x, '^\\d') then lpad(length(ltrim(x, '0'))::varchar, 10, '0') || ltrim(x, '0') else x end), '') sort_key from part""")
def file_order(spark, folder):
    p = views.table(spark, folder, "part")
    return p.select("p_partkey", "p_name", files.natural_key(F.col("p_name")).alias("sort_key"))


@query("file_kinds", with_(JOBS) + """
select case when filename like '%.pdf' then 'pdf' else 'office' end kind, count(*) files from lib_jobs group by 1""")
def file_kinds(spark, folder):
    return lib_jobs(spark, folder).groupBy(files.file_kind(F.col("filename")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@query("content_kinds", """
select k as kind, count(*) files from (select case
  when l % 7 = 0 then 'PNG' when l % 7 = 1 then 'JPEG' when l % 7 = 2 then 'WEBP' when l % 7 = 3 then 'ISO-BMFF' when l % 7 = 4 then 'OLE'
  when l % 7 = 5 then 'ZIP' else 'unknown' end k from (select page_id l from pages)) group by 1""")
def content_kinds(spark, folder):
    heads = ["89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "000000186674797068656963", "D0CF11E0A1B11AE1", "504B0304", ""]
    mark = F.get(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % 7).cast("int"))
    content = F.concat(F.unhex(mark), F.encode("html", "UTF-8"))
    p = views.table(spark, folder, "pages")
    return p.groupBy(files.magic_kind(content).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@query("page_sizes", f"""
select p_partkey, {ROUND('greatest(1.0::double, w * s)', 3)} width, {ROUND('greatest(1.0::double, h * s)', 3)} height
from (select *, least(842.0::double, greatest(w, h)) / greatest(w, h) s from (select p_partkey, p_size * 37 w, p_size * 53 + 10 h from part))""")
def page_sizes(spark, folder):
    fit = labels.page_fit(F.col("p_size") * 37, F.col("p_size") * 53 + 10)
    p = views.table(spark, folder, "part").select("p_partkey", fit.alias("f"))
    return p.select("p_partkey", js_round(F.col("f.width"), 3).alias("width"), js_round(F.col("f.height"), 3).alias("height"))


MONEY_SQL = lambda x, k: f"cast(cast({ROUND(x, k)} as decimal(30,{k})) as varchar)"


@query("display_labels", f"""
select o_orderkey,
  case when t < 1048576 then greatest(1, cast(floor(t / 1024 + 0.5) as bigint)) || ' KB' else {MONEY_SQL('t / 1024 / 1024', 1)} || ' MB' end size_label,
  case when k >= 1e6 then {MONEY_SQL('k / 1e6', 1)} || 'M' when k >= 1e3 then {MONEY_SQL('k / 1e3', 1)} || 'K' else cast(k as varchar) end big,
  case when u = 0 then '$0' when u < 0.01::double then '$' || {MONEY_SQL('u', 4)} when u < 1 then '$' || {MONEY_SQL('u', 3)} else '$' || {MONEY_SQL('u', 2)} end usd,
  case when p < 1 then {MONEY_SQL('p', 1)} || ' s/page' when p < 60 then cast(floor(p + 0.5) as bigint) || ' s/page' else {MONEY_SQL('p / 60', 1)} || ' min/page' end pace
from (select o_orderkey, cast(floor(o_totalprice * 25) as bigint) t, cast(floor(o_totalprice) as bigint) k,
  (o_orderkey % 2000) / 1000 u, (o_orderkey % 5000) / 50 p from orders)""")
def display_labels(spark, folder):
    k = F.col("o_orderkey")
    o = views.table(spark, folder, "orders")
    return o.select(
        "o_orderkey",
        labels.size_label(F.floor(F.col("o_totalprice") * 25)).alias("size_label"),
        labels.big_number(F.floor("o_totalprice")).alias("big"),
        labels.usd_label(k % 2000 / 1000).alias("usd"),
        labels.pace_label(k % 5000 / 50).alias("pace"),
    )


@query("axis_bounds", with_(DONE) + """,
d as (select strftime(created_at, '%Y-%m-%d') as day, cast(sum(page_count) as bigint) v from done group by 1)
select day, case when v <= 0 then 1.0::double else (select min(c) from unnest([1, 2, 3, 4, 5, 6, 8, 10]) u(k), (select k * pow(10.0, floor(log10(v))) c) where c >= v) end bound from d""")
def axis_bounds(spark, folder):
    days = library.daily(done_jobs(spark, folder))
    return days.select(F.col("day").cast("string").alias("day"), labels.nice_ceiling(F.col("pages")).alias("bound"))


@query("foreign_requests", """
select page_id, case when h <> 'localhost:8765' then 'Host「' || h || '」不是本机地址' when not regexp_matches(o, '^https?://(localhost|127\\.0\\.0\\.1|\\[::1\\])(:\\d+)?$') then '来源「' || o || '」不是本机页面' end reason
from (select page_id, case when page_id % 3 = 0 then regexp_extract(url, '^https?://([^/]+)', 1) else 'localhost:8765' end h,
  case when page_id % 2 = 0 then regexp_extract(url, '^(https?://[^/]+)', 1) else 'http://localhost:3000' end o from pages)""")
def foreign_requests(spark, folder):
    k, url = F.col("page_id"), F.col("url")
    host = F.when(k % 3 == 0, F.regexp_extract(url, "^https?://([^/]+)", 1)).otherwise("localhost:8765")
    origin = F.when(k % 2 == 0, F.regexp_extract(url, "^(https?://[^/]+)", 1)).otherwise("http://localhost:3000")
    return views.table(spark, folder, "pages").select("page_id", files.foreign_reason(host, origin, 8765).alias("reason"))


@query("page_links", f"""
select page_id, href, case when regexp_matches({TRIM('href')}, '^#') then {TRIM('href')} when regexp_matches(lower({TRIM('href')}), '^(https?|mailto):') then {TRIM('href')} end link
from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) href from pages union all select page_id, url from pages)""")
def page_links(spark, folder):
    p = views.table(spark, folder, "pages")
    hrefs = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    every = hrefs.unionByName(p.select("page_id", F.col("url").alias("href")))
    return every.select("page_id", "href", files.safe_link(F.col("href")).alias("link"))


@query("lane_weights", with_(JOBS) + """
select batch_id, cast(coalesce(nullif(sum(w), 0), 6) as bigint) lanes from (
  select batch_id, case mode when '1' then 6 * greatest(1, least(greatest(1, page), greatest(1, page_count))) when '2' then 24 when '3' then 8 when '4' then 1 else 6 end w
  from lib_jobs where batch_id is not null) group by batch_id""")
def lane_weights(spark, folder):
    names = F.create_map(*[F.lit(x) for x in ("1", "gemini", "2", "openrouter", "3", "kimi", "4", "ollama", "5", "other")])
    provider = F.try_element_at(names, F.col("mode"))
    w = labels.lane_weight(provider, F.col("page"), F.col("page_count"))
    jobs = lib_jobs(spark, folder).filter(F.col("batch_id").isNotNull())
    return jobs.groupBy("batch_id").agg(labels.total_weight(F.sum(w)).cast("long").alias("lanes"))


@query("backfill_targets", with_(DONE) + """
select id, tags is null or tags = '' or ai_title is null untagged, ai_one_line is null or contains(ai_one_line, '](') previewless from done
where tags is null or tags = '' or ai_title is null or ai_one_line is null""")
def backfill_targets(spark, folder):
    """Documents to be tagged or given a preview (the one-liner stands in for it)."""
    d = done_jobs(spark, folder).withColumn("preview", F.col("ai_one_line"))
    tagless = library.needs_tags(d).select("id", F.lit(True).alias("untagged"))
    bare = library.needs_preview(d).select("id", F.lit(True).alias("previewless"))
    both = tagless.join(bare, "id", "full_outer")
    return both.select("id", F.coalesce("untagged", F.lit(False)).alias("untagged"), F.coalesce("previewless", F.lit(False)).alias("previewless"))


@query("summarised_jobs", with_(DONE, FINALS) + """,
s as (select job_id, count(*) n, case when job_id % 4 = 0 then count(*) else sum(char_count) end c, count(*) filter (where job_id % 4 > 0 and status = 'review') review,
    count(*) filter (where job_id % 4 > 0 and method = 'ai') ai, count(*) filter (where job_id % 4 > 0 and outcome = 'fallback') fell from finals group by job_id)
select d.id, coalesce(n, d.page_count) page_count, cast(coalesce(c, d.char_count) as bigint) "char_count", coalesce(review, d.review_count) review_count, ai ai_pages,
  coalesce(fell, d.fallback_count) fallback_count, case when job_id % 6 = 0 then null when job_id % 3 = 0 then 5 else cast(job_id % 100 as bigint) end stored_ms
from done d left join s on cast(s.job_id as varchar) = d.id""")
def summarised_jobs(spark, folder):
    """Drafts of all documents are stored, then the finished ones of three in four; patches
    set the duration of some and clear it again of some of these. The job rows get
    the summaries of what is read back."""
    from quire.operators import pages
    from quire.session import settings, shared_dir
    from quire.sources import results

    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    finals, k = lib_finals(spark, folder, by=["job_id"]), F.col("job_id")
    drafts = finals.select("job_id", "page", "markdown", F.lit("text").alias("method"), F.lit("good").alias("status"), F.lit(1).cast("long").alias("char_count"))
    taken = lambda rows: results.as_documents(rows).withColumn("durationMs", (k % 100 + 0.25).cast("double"))
    # pages are joined where their documents lie, so their texts move once for each saving
    with settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        results.write_results(taken(drafts), path, buckets=8, dealt=False)
        results.write_results(taken(finals.filter(k % 4 > 0)), path, dealt=False)
    ids = lib_pages(spark, folder).select("job_id").distinct()
    patch = lambda seq, ms: F.struct(F.lit(seq).alias("seq"), F.lit(ms).cast("double").alias("durationMs"))
    patches = ids.filter(k % 3 == 0).select("job_id", F.inline(F.when(k % 6 == 0, F.array(patch(2, None), patch(1, 5.25))).otherwise(F.array(patch(1, 5.25)))))
    results.patch_results(patches.withColumn("fields", F.array(F.lit("durationMs"))), path)
    stored = results.read_results(spark, path)
    read = results.result_pages(stored)
    previews = read.filter(F.col("page") == 1).select("job_id", F.col("markdown").alias("preview"))
    made = library.with_summary(done_jobs(spark, folder), pages.summary(read), previews)
    ms = stored.select(F.col("job_id").alias("id"), F.round("durationMs").cast("long").alias("stored_ms"))
    return made.join(ms, "id", "left").select("id", "page_count", "char_count", "review_count", "ai_pages", "fallback_count", "stored_ms")


@query("usable_channels", """
select s_suppkey, s_suppkey % 4 <> 3 and (s_nationkey % 3 = 0 or s_nationkey % 3 = 1 and s_suppkey % 4 = 1) usable from supplier""")
def usable_channels(spark, folder):
    """Suppliers as channels: three of four have a credential, allow lists vary by nation."""
    s, k = views.table(spark, folder, "supplier"), F.col("s_suppkey") % 4
    name = F.concat(F.lit("p"), k.cast("string"))
    creds = F.create_map(F.lit("p0"), F.lit("k"), F.lit("p1"), F.lit("k"), F.lit("p2"), F.lit("k"), F.lit("p3"), F.lit(""))
    lists = F.when(F.col("s_nationkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("s_nationkey") % 3 == 1, F.array(F.lit("p1"))).otherwise(F.array(F.lit("none")))
    return s.select("s_suppkey", labels.usable_provider(name, creds, lists).alias("usable"))
