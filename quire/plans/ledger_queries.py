"""Ledger, spend windows and outages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import prices
from quire.operators import ledger, outages
from quire.plans.registry import query
from quire.plans.views_sql import CALLS, JOBS, PRICED, with_
from quire.sources.views import lib_calls, lib_jobs, priced_calls

NOW = "2024-01-28 12:00:00"
NOW_COL = lambda: F.lit(NOW).cast("timestamp_ntz")
MONTH = "ts >= timestamp '2024-01-01'"
USD = lambda x: f"(floor(coalesce(cast(sum(cast({x} as decimal(38,12))) as double), 0) * 1e6 + 0.5) / 1e6)"


def _sums(p: str, test: str) -> str:
    return f"""count(*) filter (where {test}) {p}calls, cast(coalesce(sum(case when {test} then input_tokens end), 0) as bigint) {p}input_tokens,
  cast(coalesce(sum(case when {test} then output_tokens end), 0) as bigint) {p}output_tokens,
  {USD(f'case when {test} then cost_usd end')} {p}cost_usd, count(*) filter (where {test} and cost_usd is null) {p}unpriced"""


BOTH = _sums("month_", MONTH) + ", " + _sums("all_", "true")


@query("call_costs", with_(PRICED) + "select event_id, model, price_name, cost_usd, cost_source from calls")
def call_costs(spark, folder):
    calls = priced_calls(spark, folder)
    return calls.select("event_id", "model", prices.matched_price(F.col("model")).alias("price_name"), "cost_usd", "cost_source")


@query("usage_by_dimension", with_(PRICED) + f"""
select 'provider' dimension, provider as key, {BOTH} from calls group by provider
union all select 'purpose', purpose, {BOTH} from calls group by purpose
union all select 'model', model, {BOTH} from calls group by model""")
def usage_by_dimension(spark, folder):
    return ledger.usage_by_dimension(priced_calls(spark, folder), NOW_COL())


@query("usage_totals", with_(PRICED) + f"select strftime(min(ts), '%Y-%m-%d %H:%M:%S') since, {BOTH} from calls")
def usage_totals(spark, folder):
    t = ledger.usage_totals(priced_calls(spark, folder), NOW_COL())
    return t.withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss"))


@query("usage_daily", with_(PRICED) + f"""
select strftime(ts, '%Y-%m-%d') as day, {USD('cost_usd')} cost_usd, count(*) calls from calls where ts >= timestamp '2023-12-29' group by 1""")
def usage_daily(spark, folder):
    return ledger.usage_daily(priced_calls(spark, folder), NOW_COL()).withColumn("day", F.col("day").cast("string"))


@query("unpriced_models", with_(PRICED) + "select distinct model from calls where cost_usd is null")
def unpriced_models(spark, folder):
    return ledger.unpriced_models(priced_calls(spark, folder))


@query("cost_by_ref", with_(PRICED) + f"""select ref, {_sums('', 'true')} from calls group by ref""")
def cost_by_ref(spark, folder):
    return ledger.cost_by_ref(priced_calls(spark, folder))


@query("job_costs", with_(PRICED, JOBS) + f""",
c as (select ref, {_sums('', 'true')} from calls group by ref)
select id, cost_usd, calls cost_calls, unpriced cost_unpriced, input_tokens tokens_in, output_tokens tokens_out from lib_jobs left join c on c.ref = id""")
def job_costs(spark, folder):
    return ledger.with_costs(lib_jobs(spark, folder).select("id"), priced_calls(spark, folder))


@query("refine_cost_per_page", with_(PRICED) + f""",
g as (select {BOTH} from calls where purpose = 'refine')
select floor((case when month_calls - month_unpriced >= 20 then month_cost_usd / nullif(month_calls - month_unpriced, 0)
  when all_calls - all_unpriced >= 3 then all_cost_usd / nullif(all_calls - all_unpriced, 0) end) * 1e9 + 0.5) / 1e9 usd_per_page from g""")
def refine_cost_per_page(spark, folder):
    return ledger.refine_cost_per_page(priced_calls(spark, folder), NOW_COL())


@query("gate_status", with_(PRICED) + f"""
select provider app, model, count(*) calls, {USD('cost_usd')} usd from calls where ts > timestamp '{NOW}' - interval 5 hours group by 1, 2""")
def gate_status(spark, folder):
    return ledger.spend_since(priced_calls(spark, folder), NOW_COL())


@query("rolling_spend", with_(PRICED) + """,
w as (select ts, sum(cast(coalesce(cost_usd, 0) as decimal(38,12))) over (order by ts range between interval '4 hours 59 minutes 59.999999 seconds' preceding and current row) s from calls)
select strftime(ts, '%Y-%m-%d %H:%M:%S.%f') ts, usd, usd < 150 batch_allowed from (
  select ts, floor(cast(max(s) as double) * 1e6 + 0.5) / 1e6 usd from w group by ts)""")
def rolling_spend(spark, folder):
    spend = ledger.admission(ledger.rolling_spend(priced_calls(spark, folder)), limit=250.0, keep=100.0)
    return spend.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("family_costs", with_(CALLS) + """
select event_id, floor((input_tokens * pin + output_tokens * pout + cached_tokens * pin * 0.1::double + thinking_tokens * pin * 2.0::double + page * pin * 1.25::double) / 1e6 * 1e9 + 0.5) / 1e9 usd
from (select *, case event_id % 3 when 0 then 0.1::double when 1 then 2.0::double else 4.0::double end pin, case event_id % 3 when 0 then 0.5::double when 1 then 10.0::double else 20.0::double end pout from lib_calls)""")
def family_costs(spark, folder):
    from quire.functions.base import js_round

    names = F.array(F.lit("claude-haiku-x"), F.lit("claude-sonnet-y"), F.lit("something-else"))
    model = F.get(names, (F.col("event_id") % 3).cast("int"))
    usd = prices.family_cost(model, *[F.col(c) for c in ("input_tokens", "output_tokens", "cached_tokens", "thinking_tokens", "page")])
    return lib_calls(spark, folder).select("event_id", js_round(usd, 9).alias("usd"))


@query("prices_by_join", with_(PRICED) + """
select event_id, c.model, c.price_name, p.rin input_rate from calls c left join price_list p on p.name = c.price_name and c.input_tokens >= p.low and (p.high is null or c.input_tokens <= p.high)""")
def prices_by_join(spark, folder):
    """The same price list as a table, joined by exact name or longest prefix."""
    rows = [(n, lim, float(i), float(o), float(c)) for n, tiers, c in fv.PRICES for lim, i, o in tiers]
    listed = spark.createDataFrame(rows, "name string, limit long, input double, output double, cached double")
    priced = ledger.attach_prices(lib_calls(spark, folder), listed)
    return priced.select("event_id", "model", "price_name", F.col("tier.input").alias("input_rate"))


@query("payload_rows", with_(CALLS) + """
select event_id, p provider, model, input_tokens, output_tokens, ct cached_tokens, tt thinking_tokens,
  case p when 'ollama' then 0.0::double when 'gemini' then null else reported_cost end reported_cost
from (select * exclude (cached_tokens, thinking_tokens, provider), provider as type, case event_id % 3 when 0 then 'gemini' when 1 then 'openrouter' else 'ollama' end p,
   case when event_id % 3 = 2 then 0 else cached_tokens end ct, case when event_id % 3 = 2 then 0 else thinking_tokens end tt from lib_calls)
where type <> 'error'""")
def payload_rows(spark, folder):
    c, k = F.col, F.col("event_id")
    gemini = F.to_json(F.struct(F.struct(
        c("input_tokens").alias("promptTokenCount"), c("output_tokens").alias("candidatesTokenCount"),
        c("cached_tokens").alias("cachedContentTokenCount"), c("thinking_tokens").alias("thoughtsTokenCount")).alias("usageMetadata")))
    chat = F.to_json(F.struct(c("model"), F.struct(
        c("input_tokens").alias("prompt_tokens"), c("output_tokens").alias("completion_tokens"), c("reported_cost").alias("cost"),
        F.struct(c("cached_tokens")).alias("prompt_tokens_details"),
        F.struct(c("thinking_tokens").alias("reasoning_tokens")).alias("completion_tokens_details")).alias("usage")))
    local = F.to_json(F.struct(c("model"), c("input_tokens").alias("prompt_eval_count"), c("output_tokens").alias("eval_count")))
    payload = F.when(F.col("provider") == "error", '{"id":"x"}').when(k % 3 == 0, gemini).when(k % 3 == 1, chat).otherwise(local)
    provider = F.when(k % 3 == 0, "gemini").when(k % 3 == 1, "openrouter").otherwise("ollama")
    # failed calls carry no usage
    raw = lib_calls(spark, folder).select("event_id", provider.alias("provider"), "model", payload.alias("payload"))
    return ledger.normalise_payloads(raw)


@query("provider_pauses", with_(CALLS) + """
select provider, strftime(max(ts + to_seconds(page * 60)), '%Y-%m-%d %H:%M:%S') pause_until, count(*) calls from lib_calls group by provider""")
def provider_pauses(spark, folder):
    """Shared pause per provider: the latest of all ends named so far."""
    calls = lib_calls(spark, folder).withColumn("until", F.timestamp_add("SECOND", F.col("page") * 60, F.col("ts")))
    g = calls.groupBy("provider").agg(F.max("until").alias("pause_until"), F.count(F.lit(1)).alias("calls"))
    return g.withColumn("pause_until", F.date_format("pause_until", "yyyy-MM-dd HH:mm:ss"))


@query("breaker_trips", with_(CALLS) + """,
a as (select ref lane, ts, event_id, provider = 'error' or value_ms > 3000 failed from (select ref, ts, event_id, provider, input_tokens // 10 value_ms from lib_calls)),
s as (select *, sum(case when failed then 0 else 1 end) over (partition by lane order by ts, event_id rows unbounded preceding) island from a),
o as (select *, row_number() over (partition by lane, island order by ts, event_id) n from s where failed)
select lane, event_id, strftime(ts + interval 120 seconds, '%Y-%m-%d %H:%M:%S.%f') down_until from o where n % 6 = 0""")
def breaker_trips(spark, folder):
    """Six failures in a row take a model out for two minutes. The user is the
    lane here; an error or an answer slower than 3 s fails."""
    failed = (F.col("provider") == "error") | (F.floor(F.col("input_tokens") / 10) > 3000)
    attempts = lib_calls(spark, folder).select(F.col("ref").alias("lane"), "ts", "event_id", failed.alias("failed"))
    trips = outages.breaker_trips(attempts, threshold=fv.BREAKER_FAILURES)
    return trips.select("lane", "event_id", F.date_format("down_until", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("down_until"))
