"""Period reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import answers
from quire.operators import reflect
from quire.plans.library_queries import DONE
from quire.plans.registry import ORACLE, query
from quire.plans.views_sql import TAGS, TRIM, q, with_
from quire.sources.tables import table
from quire.sources.views import NOW, done_jobs

AT = datetime.fromisoformat(NOW)
PERIOD = reflect.Period.of("6m", AT)
CUR = f"created_at between timestamp '{PERIOD.start}' and timestamp '{PERIOD.now}'"
PREV = f"created_at >= timestamp '{PERIOD.previous}' and created_at < timestamp '{PERIOD.start}'"


@query("reflect_totals", with_(DONE) + f"""
select count(*) filter (where {CUR}) docs, cast(coalesce(sum(case when {CUR} then page_count end), 0) as bigint) pages, cast(coalesce(sum(case when {CUR} then char_count end), 0) as bigint) chars,
  count(*) filter (where {PREV}) prev_docs, cast(coalesce(sum(case when {PREV} then page_count end), 0) as bigint) prev_pages from done""")
def reflect_totals(spark, folder):
    return reflect.totals(done_jobs(spark, folder), PERIOD)


def _histogram_sql(size: int, slot: str) -> str:
    return with_(DONE) + f""",
c as (select {slot} slot, count(*) n from done where {CUR} group by 1),
f as (select cast(s as int) slot, coalesce(n, 0) docs from range({size}) r(s) left join c on c.slot = s)
select slot, docs, docs > 0 and slot = (select min(slot) from f where docs = (select max(docs) from f)) peak from f"""


@query("reflect_weekdays", _histogram_sql(7, "isodow(created_at) - 1"))
def reflect_weekdays(spark, folder):
    return reflect.histogram(done_jobs(spark, folder), PERIOD, "weekday")


@query("reflect_hours", _histogram_sql(24, "hour(created_at)"))
def reflect_hours(spark, folder):
    return reflect.histogram(done_jobs(spark, folder), PERIOD, "hour")


def _series_sql(test: str, first: str, last: str) -> str:
    return with_(DONE) + f""",
d as (select cast(created_at as date) d, count(*) n, sum(page_count) p from done where {test} group by 1),
cal as (select cast(unnest(generate_series(date '{first}', date '{last}', interval 1 day)) as date) d)
select cast(cal.d as varchar) as day, coalesce(n, 0) docs, cast(coalesce(p, 0) as bigint) pages from cal left join d on d.d = cal.d"""


@query("reflect_series", _series_sql(CUR, str(PERIOD.start.date()), str(PERIOD.now.date())))
def reflect_series(spark, folder):
    return reflect.series(done_jobs(spark, folder), PERIOD).withColumn("day", F.col("day").cast("string"))


@query("reflect_previous_series", _series_sql(PREV, "2000-08-03", "2001-01-31"))
def reflect_previous_series(spark, folder):
    return reflect.previous_series(done_jobs(spark, folder), PERIOD).withColumn("day", F.col("day").cast("string"))


@query("reflect_topics", with_(DONE) + f""",
i0 as (select id, created_at, case when page_count > 0 then page_count else 1 end w, list_filter({TAGS('tags')}, lambda t: t <> '') tg from done where {CUR}),
items as (select id, created_at, w, case when len(tg) > 0 then tg else ['{fv.UNTAGGED}'] end tg from i0),
e as (select id, created_at, w, len(tg) k, unnest(tg) tag, unnest(range(len(tg))) pos from items),
fr as (select tag, sum(cast(w / k as decimal(38,12))) freq, min(row(created_at, id, pos)) seen from e group by tag),
rk as (select tag, row_number() over (order by freq desc, seen) rnk from fr),
ch as (select e.id, any_value(e.w) w, any_value(created_at) created_at, arg_min(e.tag, rnk) tag from e join rk on rk.tag = e.tag group by e.id),
pt as (select tag, sum(w) pages, count(*) docs, min(row(created_at, id)) seen from ch group by tag),
nr as (select *, row_number() over (order by pages desc, seen) rn from pt),
six as (select least(rn, 6) rank, case when rn <= 5 then tag else '__other__' end tag, sum(pages) pages, sum(docs) docs from nr group by 1, 2),
p as (select *, floor(pages / (select sum(pages) from six) * 100 + 0.5) pct from six)
select cast(rank as int) rank, tag, cast(pages as bigint) pages, cast(docs as bigint) docs,
  cast(greatest(0, case when rank = 1 then pct + 100 - (select sum(pct) from p) else pct end) as bigint) percent from p""")
def reflect_topics(spark, folder):
    return reflect.topics(done_jobs(spark, folder), PERIOD)


@query("reflect_fingerprint", with_(DONE) + f""",
i as (select sha1(id || chr(0) || {TRIM(f"coalesce(nullif(ai_title, ''), regexp_replace(filename, {q(fv.SOURCE_EXTENSION)}, ''))")} || chr(0) || array_to_string(list_filter({TAGS('tags')}, lambda t: t <> ''), chr(1))) h from done where {CUR}),
g as (select count(*) docs, cast(coalesce(sum(cast('0x' || substr(h, 1, 12) as bigint)), 0) as varchar) a, cast(coalesce(sum(cast('0x' || substr(h, 13, 12) as bigint)), 0) as varchar) b from i)
select docs, left(sha1(docs || ':' || a || ':' || b), 16) fingerprint from g""")
def reflect_fingerprint(spark, folder):
    return reflect.fingerprint(done_jobs(spark, folder), PERIOD)


@query("reflect_sample", with_(DONE) + f""",
n as (select id, row_number() over (order by created_at, id) n, count(*) over () t from done where {CUR})
select n, id from n where t <= {fv.SAMPLE_CAP} or n - 1 in (select cast(floor(i * (t / {float(fv.SAMPLE_CAP)}::double)) as bigint) from range({fv.SAMPLE_CAP}) r(i), (select max(t) t from n) x)""")
def reflect_sample(spark, folder):
    return reflect.sample(done_jobs(spark, folder), PERIOD)



@query("reflect_named_topics", ORACLE["reflect_topics"].replace("select cast(rank as int) rank, tag,", """select tag,
  case when tag = '__other__' then 'Everything else' when tag in (select c_mktsegment from customer) then 'About ' || tag else tag end as name,
  case when tag in (select c_mktsegment from customer) then 'from ' || lower(tag) else '' end as "desc",""")
    .replace("cast(pages as bigint) pages, cast(docs as bigint) docs,", ""))
def reflect_named_topics(spark, folder):
    """A recap that names the market segments; the other tags stand for themselves."""
    seg = F.col("c_mktsegment")
    raw = F.to_json(F.struct(F.struct(F.lit("x").alias("headline")).alias("en"), F.array(F.struct(
        seg.alias("tag"), F.concat(F.lit("About "), seg).alias("name_en"), F.concat(F.lit("from "), F.lower(seg)).alias("desc_en"))).alias("topics")))
    told = table(spark, folder, "customer").select(seg).distinct().select(raw.alias("raw"))
    recap = answers.narratives(told, F.col("raw"), "en").select("narrative.topics")
    named = reflect.named_topics(reflect.topics(done_jobs(spark, folder), PERIOD), recap)
    return named.select("tag", "percent", "name", "desc")


@query("reflect_headline", """
with t as (""" + ORACLE["reflect_topics"] + """)
select 'A stretch of ' || string_agg(tag, ' and ' order by rank) headline from t where rank <= 2 and tag <> '__other__'""")
def reflect_headline(spark, folder):
    return reflect.plain_headline(reflect.topics(done_jobs(spark, folder), PERIOD))
