"""Token and cost ledger.

Money is added as exact decimals: sums do not depend on partitioning or on the
order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.base import js_round
from quire.operators.ordered import running_total

MONEY = "decimal(38,12)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def _usd(total: Column) -> Column:
    return js_round(F.coalesce(total.cast("double"), F.lit(0.0)), 6)


def _measures(keep: Column, prefix: str = "") -> list[Column]:
    cost = F.col("cost_usd")
    return [
        F.count_if(keep).alias(f"{prefix}calls"),
        F.coalesce(F.sum(F.when(keep, F.col("input_tokens"))), F.lit(0)).alias(f"{prefix}input_tokens"),
        F.coalesce(F.sum(F.when(keep, F.col("output_tokens"))), F.lit(0)).alias(f"{prefix}output_tokens"),
        _usd(F.sum(F.when(keep, money(cost)))).alias(f"{prefix}cost_usd"),
        F.count_if(keep & cost.isNull()).alias(f"{prefix}unpriced"),
    ]


def since_month(now: Column) -> Column:
    return F.col("ts") >= F.date_trunc("month", now).cast("timestamp_ntz")


def usage_by_dimension(calls: DataFrame, now: Column) -> DataFrame:
    """Month and all-time usage by provider, purpose and model: one scan, one
    shuffle, by grouping sets."""
    month, always = since_month(now), F.lit(True)
    sets = calls.groupingSets(
        [[F.col("provider")], [F.col("purpose")], [F.col("model")]], F.col("provider"), F.col("purpose"), F.col("model")
    )
    g = sets.agg(F.grouping_id().alias("_g"), *_measures(month, "month_"), *_measures(always, "all_"))
    dim = F.when(F.col("_g") == 3, "provider").when(F.col("_g") == 5, "purpose").otherwise("model")
    measures = [c for c in g.columns if c.startswith(("month_", "all_"))]
    return g.select(dim.alias("dimension"), F.coalesce("provider", "purpose", "model").alias("key"), *measures)


def usage_totals(calls: DataFrame, now: Column) -> DataFrame:
    g = calls.agg(F.min("ts").alias("since"), *_measures(since_month(now), "month_"), *_measures(F.lit(True), "all_"))
    return g


def usage_daily(calls: DataFrame, now: Column, days: int = 30) -> DataFrame:
    start = F.date_sub(F.to_date(now), days)
    return (
        calls.filter(F.col("ts") >= start.cast("timestamp_ntz"))
        .groupBy(F.to_date("ts").alias("day"))
        .agg(_usd(F.sum(money(F.col("cost_usd")))).alias("cost_usd"), F.count(F.lit(1)).alias("calls"))
    )


def unpriced_models(calls: DataFrame) -> DataFrame:
    return calls.filter(F.col("cost_usd").isNull()).select("model").distinct()


def cost_by_ref(calls: DataFrame) -> DataFrame:
    return calls.filter(F.col("ref").isNotNull()).groupBy("ref").agg(*_measures(F.lit(True)))


def with_costs(jobs: DataFrame, calls: DataFrame) -> DataFrame:
    """Jobs with their ledger summary; NULLs where no call was made."""
    c = cost_by_ref(calls).select(
        F.col("ref").alias("id"),
        F.col("cost_usd"),
        F.col("calls").alias("cost_calls"),
        F.col("unpriced").alias("cost_unpriced"),
        F.col("input_tokens").alias("tokens_in"),
        F.col("output_tokens").alias("tokens_out"),
    )
    return jobs.join(c, "id", "left")


def refine_cost_per_page(calls: DataFrame, now: Column) -> DataFrame:
    """Cost of one page: this month's when it holds calls enough, else all-time's."""
    g = calls.filter(F.col("purpose") == "refine").agg(
        *_measures(since_month(now), "month_"), *_measures(F.lit(True), "all_")
    )
    priced = lambda p: F.col(f"{p}_calls") - F.col(f"{p}_unpriced")
    per = lambda p: F.col(f"{p}_cost_usd") / F.nullif(priced(p), F.lit(0))
    value = F.when(priced("month") >= fv.REFINE_MONTH_MINIMUM, per("month")).when(
        priced("all") >= fv.REFINE_ALL_MINIMUM, per("all")
    )
    return g.select(js_round(value, 9).alias("usd_per_page"))


def spend_since(calls: DataFrame, now: Column, hours: int = fv.SPEND_WINDOW_HOURS) -> DataFrame:
    """Calls and spend of the last hours by application and model."""
    start = F.timestamp_add("HOUR", F.lit(-hours), now)
    return (
        calls.filter(F.col("ts") > start)
        .groupBy(F.col("provider").alias("app"), "model")
        .agg(F.count(F.lit(1)).alias("calls"), _usd(F.sum(money(F.col("cost_usd")))).alias("usd"))
    )


def rolling_spend(calls: DataFrame, hours: int = fv.SPEND_WINDOW_HOURS) -> DataFrame:
    """Spend in the window that ends at each call instant, start excluded.

    The window is global, so it is not run as one sort: spend is first summed
    per instant, and ``total up to t`` less ``total up to t - window`` comes from
    one running total over both kinds of points.
    """
    spent = calls.groupBy("ts").agg(F.coalesce(F.sum(money(F.col("cost_usd"))), F.lit(0).cast(MONEY)).alias("v"))
    back = F.timestamp_add("HOUR", F.lit(-hours), F.col("ts"))
    # an instant's own spend comes before a window start that falls on it
    points = spent.select(
        F.inline(
            F.array(
                F.struct(F.col("ts").alias("at"), F.lit(0).alias("kind"), F.col("v").alias("v"), F.col("ts").alias("owner")),
                F.struct(back.alias("at"), F.lit(1).alias("kind"), F.lit(0).cast(MONEY).alias("v"), F.col("ts").alias("owner")),
            )
        )
    )
    order = [F.col("at").asc(), F.col("kind").asc(), F.col("owner").asc()]
    totals = running_total(points, F.col("v"), order, out="upto")
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("upto")))
    return totals.groupBy(F.col("owner").alias("ts")).agg(_usd(pick(0) - pick(1)).alias("usd"))


def admission(spend: DataFrame, limit: float, keep: float) -> DataFrame:
    """Would batch work have been let in at each instant?"""
    return spend.withColumn("batch_allowed", F.col("usd") < F.lit(limit - keep))


def pause_until(pauses: DataFrame) -> DataFrame:
    """Shared pause: the latest end and the reason given last. ``pauses``: seq, until, reason."""
    return pauses.agg(F.max("until").alias("until"), F.max_by("reason", "seq").alias("reason"))


def attach_prices(calls: DataFrame, price_table: DataFrame) -> DataFrame:
    """Price rows that are data, not configuration: exact name, else longest prefix.

    Each distinct model name is expanded to its own prefixes and equi-joined, so
    neither table is broadcast by force nor compared pair by pair.
    ``price_table``: name, limit (NULL for the last tier), input, output, cached.
    """
    models = calls.select("model").distinct()
    prefixes = models.select(
        "model", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("model"))), lambda n: F.left("model", n))).alias("name")
    )
    names = price_table.groupBy("name").agg(
        F.array_sort(
            F.collect_list(F.struct(F.coalesce("limit", F.lit(2**62)).alias("cap"), "input", "output", "cached"))
        ).alias("tiers")
    )
    best = (
        prefixes.join(names, "name")
        .groupBy("model")
        .agg(F.max_by(F.struct("name", "tiers"), F.char_length("name")).alias("_p"))
    )
    joined = calls.join(best, "model", "left")
    tier = F.get(F.filter(F.col("_p.tiers"), lambda t: F.col("input_tokens") <= t["cap"]), F.lit(0))
    return joined.withColumn("price_name", F.col("_p.name")).withColumn("tier", tier).drop("_p")


def normalise_payloads(replies: DataFrame) -> DataFrame:
    """Ledger rows from provider payloads (``provider``, ``model``, ``payload`` JSON).
    Payloads without usage give no row; a local model costs 0, not NULL."""
    schema = (
        "model string, eval_count bigint, prompt_eval_count bigint,"
        "usageMetadata struct<promptTokenCount:bigint,candidatesTokenCount:bigint,cachedContentTokenCount:bigint,thoughtsTokenCount:bigint>,"
        "usage struct<prompt_tokens:bigint,completion_tokens:bigint,cost:double,prompt_tokens_details:struct<cached_tokens:bigint>,"
        "completion_tokens_details:struct<reasoning_tokens:bigint>>"
    )
    p = replies.withColumn("_p", F.from_json("payload", schema))
    kind = F.col("provider")
    zero = lambda c: F.coalesce(c, F.lit(0))
    g, o = (lambda f: F.col(f"_p.usageMetadata.{f}")), (lambda f: F.col(f"_p.usage.{f}"))
    pick = lambda gem, oll, oth: F.when(kind == "gemini", zero(gem)).when(kind == "ollama", zero(oll)).otherwise(zero(oth))
    has = (
        F.when(kind == "gemini", F.col("_p.usageMetadata").isNotNull())
        .when(kind == "ollama", F.col("_p.eval_count").isNotNull())
        .otherwise(F.col("_p.usage").isNotNull())
    )
    none = F.lit(0).cast("bigint")
    return p.filter(has).select(
        *[c for c in replies.columns if c not in ("payload", "model")],
        F.when(kind == "gemini", F.col("model")).otherwise(F.coalesce(F.nullif(F.col("_p.model"), F.lit("")), "model")).alias("model"),
        pick(g("promptTokenCount"), F.col("_p.prompt_eval_count"), o("prompt_tokens")).alias("input_tokens"),
        pick(g("candidatesTokenCount"), F.col("_p.eval_count"), o("completion_tokens")).alias("output_tokens"),
        pick(g("cachedContentTokenCount"), none, o("prompt_tokens_details.cached_tokens")).alias("cached_tokens"),
        pick(g("thoughtsTokenCount"), none, o("completion_tokens_details.reasoning_tokens")).alias("thinking_tokens"),
        F.when(kind == "ollama", F.lit(0.0)).when(kind != "gemini", o("cost")).alias("reported_cost"),
    )
