"""State machines and streams over the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.operators import chains
from quire.plans.registry import query
from quire.plans.views_sql import CALLS, with_
from quire.session import shared_dir
from quire.sources.tables import table
from quire.streaming import ingest


def _events(spark, folder):
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query("usage_log_ingest", with_(CALLS) + """
select 'm' || event_id || '|r' || event_id as key, case event_id % 3 when 0 then 'claude-haiku-x' when 1 then 'claude-sonnet-y' else 'something-else' end model,
  floor((input_tokens * pin + output_tokens * pout + cached_tokens * pin * 0.1::double) / 1e6 * 1e9 + 0.5) / 1e9 usd
from (select *, case event_id % 3 when 0 then 0.1::double when 1 then 2.0::double else 4.0::double end pin, case event_id % 3 when 0 then 0.5::double when 1 then 10.0::double else 20.0::double end pout from lib_calls)""")
def usage_log_ingest(spark, folder):
    """Every event as a log line; a third are followed by another copy with other numbers, a third
    by a cut-off line. The logs are read, then grow by files that tell all keys again, and are read again."""
    from quire.functions.base import js_round
    from quire.sources.views import _calls

    base = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    c = _calls(table(spark, folder, "events"))
    k = F.col("event_id")
    ks = k.cast("string")
    model = F.get(F.array(F.lit("claude-haiku-x"), F.lit("claude-sonnet-y"), F.lit("something-else")), (k % 3).cast("int"))

    def line(more: int):
        return F.to_json(F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.concat(F.lit("r"), ks).alias("requestId"),
            F.struct(F.concat(F.lit("m"), ks).alias("id"), model.alias("model"), F.struct(
                (F.col("input_tokens") + more).alias("input_tokens"), "output_tokens", F.col("cached_tokens").alias("cache_read_input_tokens")).alias("usage")).alias("message")))

    def read() -> None:
        rows = ingest.parse_usage(ingest.read_usage_logs(spark, f"{base}/logs", suffix=".txt"))
        ingest.keep_first(rows, f"{base}/table", f"{base}/checkpoint")

    copies = F.when(k % 3 == 0, F.array(line(0), line(5))).when(k % 3 == 1, F.array(line(0), F.left(line(0), F.lit(60)))).otherwise(F.array(line(0)))
    c.select(F.explode(copies).alias("value")).write.mode("append").text(f"{base}/logs")
    read()
    c.select(line(9).alias("value")).write.mode("append").text(f"{base}/logs")
    read()
    return ingest.usage_rows(spark, f"{base}/table").select("key", "model", js_round(F.col("usd"), 9).alias("usd"))


@query("lane_limits", """
with recursive a as (
  select cast(user_id as varchar) lane, ts, event_id, event_type <> 'error' and value * 100 <= 9000 ok, epoch_ms(ts) ms,
    row_number() over (partition by user_id order by ts, event_id) rn from events),
r as (
  select distinct lane, cast(0 as bigint) rn, cast(0 as bigint) event_id, cast(null as timestamp) ts, 40 lim, 0 before, 0 wins, cast(0 as bigint) cut from a
  union all
  select a.lane, a.rn, a.event_id, a.ts,
    case when a.ok then case when r.wins + 1 >= 4 and r.lim < 40 then r.lim + 1 else r.lim end
      when a.ms - r.cut < 5000 then r.lim else greatest(2, cast(floor(r.lim * 0.7::double) as int)) end,
    r.lim, case when a.ok and not (r.wins + 1 >= 4 and r.lim < 40) then r.wins + 1 else 0 end,
    case when not a.ok and a.ms - r.cut >= 5000 then a.ms else r.cut end
  from r join a on a.lane = r.lane and a.rn = r.rn + 1)
select lane, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') ts, lim lane_limit from r where rn > 0 and lim <> before""")
def lane_limits(spark, folder):
    """The event log as attempts, each user a lane."""
    e = table(spark, folder, "events")
    attempts = e.select(
        F.col("user_id").cast("string").alias("lane"), "ts", "event_id",
        (F.col("event_type") != "error").alias("ok"), (F.col("value") * 100).alias("latency_ms"))
    limits = chains.lane_limits(attempts, top=40, slow_ms=9000)
    return limits.select("lane", "event_id", F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM-dd HH:mm:ss").alias("ts"), "lane_limit")


@query("progress_writes", """
with recursive p as (
  select user_id job_id, event_id * 2 + 1 at_ms, cast(floor(event_id / 700 + 1) as bigint) page, cast(1000000000 as bigint) total,
    row_number() over (partition by user_id order by event_id) rn from events),
r as (
  select distinct job_id, cast(0 as bigint) at_ms, cast(0 as bigint) page, cast(0 as bigint) total, cast(0 as bigint) rn, false kept, cast(0 as bigint) w, cast(-1 as bigint) wp from p
  union all
  select job_id, at_ms, page, total, rn, k, case when k then at_ms else w end, case when k then page else wp end from (
    select p.*, r.w, r.wp, p.page = 0 or p.page >= p.total or p.page < r.wp or p.page - r.wp > 1 or p.at_ms - r.w >= 300 k
    from r join p on p.job_id = r.job_id and p.rn = r.rn + 1))
select job_id, at_ms, page, total from r where kept""")
def progress_writes(spark, folder):
    """The event log as progress reports, each user a job."""
    p = table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), (F.col("event_id") * 2 + 1).alias("at_ms"),
        F.floor(F.col("event_id") / 700 + 1).alias("page"), F.lit(10**9).cast("long").alias("total"))
    return chains.progress_writes(p)
