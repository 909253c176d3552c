"""Dates, sizes, estimates and short labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.base import js_round


def months_before(ts: Column, months: int) -> Column:
    """Same time of day, the day clamped to the month's last one."""
    return ts - F.make_ym_interval(F.lit(0), F.lit(months))


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def page_fit(width: Column, height: Column, long_side: int = fv.PAGE_LONG_SIDE) -> Column:
    """Page size in points: ratio kept, long side bounded, never enlarged."""
    longest = F.greatest(width, height)
    longest = F.when(longest > 0, longest).otherwise(F.lit(1))
    scale = F.least(F.lit(float(long_side)), longest) / longest
    return F.struct(
        F.greatest(F.lit(1.0), width * scale).alias("width"), F.greatest(F.lit(1.0), height * scale).alias("height")
    )


def downscale(width: Column, height: Column, limit: int = fv.IMAGE_LONG_SIDE) -> Column:
    longest = F.greatest(width, height)
    ratio = F.when(longest > limit, F.lit(float(limit)) / longest).otherwise(F.lit(1.0))
    side = lambda x: F.greatest(F.lit(1), F.bround(x * ratio).cast("long"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def _fixed(x: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits."""
    return js_round(x, digits).cast(f"decimal(30,{digits})").cast("string")


def size_label(size: Column) -> Column:
    kb = F.greatest(F.lit(1), js_round(size / 1024).cast("long"))
    return F.when(size < 1024 * 1024, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(
        F.concat(_fixed(size / 1024 / 1024, 1), F.lit(" MB"))
    )


def big_number(n: Column) -> Column:
    return (
        F.when(n >= 1e6, F.concat(_fixed(n / 1e6, 1), F.lit("M")))
        .when(n >= 1e3, F.concat(_fixed(n / 1e3, 1), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def usd_label(n: Column) -> Column:
    d = F.lit("$")
    return (
        F.when(n == 0, "$0")
        .when(n < 0.01, F.concat(d, _fixed(n, 4)))
        .when(n < 1, F.concat(d, _fixed(n, 3)))
        .otherwise(F.concat(d, _fixed(n, 2)))
    )


def cost_label(cost: Column, calls: Column, unpriced: Column) -> Column:
    """NULL without calls; unpriced calls are named, not hidden."""
    usd = usd_label(F.coalesce(cost, F.lit(0.0)))
    part = F.concat(usd, F.lit("（"), unpriced.cast("string"), F.lit(" 次未计价）"))
    return F.when(F.coalesce(calls, F.lit(0)) == 0, F.lit(None).cast("string")).otherwise(
        F.when(F.coalesce(unpriced, F.lit(0)) == 0, usd).when(unpriced == calls, "未计价").otherwise(part)
    )


def elapsed_label(ms: Column) -> Column:
    total = F.greatest(F.lit(0), js_round(ms / 1000).cast("long"))
    minutes = F.floor(total / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(total < 60, F.concat(total.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), two(total % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), two(minutes % 60), F.lit("m")))
    )


def pace_label(sec: Column) -> Column:
    return (
        F.when(sec < 1, F.concat(_fixed(sec, 1), F.lit(" s/page")))
        .when(sec < 60, F.concat(js_round(sec).cast("long").cast("string"), F.lit(" s/page")))
        .otherwise(F.concat(_fixed(sec / 60, 1), F.lit(" min/page")))
    )


def nice_ceiling(v: Column) -> Column:
    """Smallest 1,2,3,4,5,6,8,10 times a power of ten that is not below v."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    chain = F.when(v <= 0, F.lit(1.0))
    for step in fv.NICE_STEPS:
        chain = chain.when(power * step >= v, power * step)
    return chain.otherwise(power * 10)


def day_group(day: Column, today: Column) -> Column:
    """today / yesterday / a weekday name within the week / the date."""
    age = F.datediff(today, day)
    return (
        F.when(age == 0, "today")
        .when(age == 1, "yesterday")
        .when((age > 1) & (age < 7), F.get(F.array(*[F.lit(d) for d in fv.WEEKDAYS_EN]), F.weekday(day)))
        .otherwise(day.cast("string"))
    )


def quality_badge(review: Column, fallback: Column) -> Column:
    return F.when(F.coalesce(fallback, F.lit(0)) > 0, "bad").when(review > 0, "soft").otherwise("good")


def eta_seconds(done: Column, total: Column, elapsed_ms: Column, table_seconds: Column) -> Column:
    """Own pace once it is telling (over 20 s, 3 pages and 10 %), else the
    table's; NULL when the total or both paces are unknown."""
    live = (elapsed_ms > 20000) & (done >= 3) & (total > 0) & (done / F.nullif(total, F.lit(0)) >= 0.1)
    pace = F.when(live, elapsed_ms / 1000 / F.nullif(done, F.lit(0))).otherwise(table_seconds)
    left = F.greatest(F.lit(0), total - done)
    return F.when(total > 0, js_round(left * pace))


def lane_weight(provider: Column, projects: Column, keys: Column) -> Column:
    """Parallel requests a provider is given."""
    chain = F.when(
        provider == "gemini",
        F.lit(fv.GEMINI_WEIGHT) * F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), projects), F.greatest(F.lit(1), keys))),
    )
    for name, weight in fv.DIRECT_WEIGHTS.items():
        chain = chain.when(provider == name, F.lit(weight))
    return chain.otherwise(F.lit(fv.DEFAULT_WEIGHT))


def total_weight(sum_of_weights: Column) -> Column:
    return F.coalesce(F.nullif(sum_of_weights, F.lit(0)), F.lit(fv.DEFAULT_WEIGHT))


def stand_in(providers: Column, configured: Column, paused: str = "claude") -> Column:
    """Providers with the paused one left out, or its first configured stand-in."""
    rest = F.array_remove(providers, paused)
    sub = F.get(F.array_intersect(F.array(*[F.lit(p) for p in fv.STAND_INS]), configured), F.lit(0))
    return (
        F.when(~F.array_contains(providers, paused), providers)
        .when(F.size(rest) > 0, rest)
        .when(sub.isNotNull(), F.array(sub))
        .otherwise(providers)
    )


def method_label() -> Column:
    """How a page came about, from its flat columns."""
    from quire.functions.page_state import outcome

    shown, method = outcome(), F.col("method")
    maker = F.concat(F.coalesce(F.col("provider"), F.lit("gemini")), F.lit(" · "), F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("视觉模型")))
    fallback = (
        F.when(method == "empty", "AI 未通过 · 这页没有文字层可回退，结果为空")
        .when(method == "text", "AI 未通过 · 已回退 PDF 文字层")
        .otherwise("AI 未通过 · 已回退本地初稿")
    )
    return (
        F.when(shown.isin("ai", "noText"), maker)
        .when(shown == "fallback", fallback)
        .when(method == "surya", "Surya 本地视觉识别")
        .when(method == "ocr", "本地 OCR")
        .when(method == "text", "PDF 文字层")
        .otherwise("未识别")
    )


def page_time_label(total_ms: Column, model_ms: Column) -> Column:
    """NULL without a time; the model's share is named when the rest is a second or more."""
    total = F.concat(F.lit("耗时 "), _fixed(total_ms / 1000, 1), F.lit(" 秒"))
    model = F.concat(total, F.lit(" · 模型 "), _fixed(model_ms / 1000, 1), F.lit(" 秒"))
    return F.when(model_ms.isNotNull() & (total_ms - model_ms >= 1000), model).otherwise(total)


def usable_provider(provider: Column, credentials: Column, allowed: Column) -> Column:
    """A provider with a credential, and on the allow list unless that is empty."""
    has = F.coalesce(F.try_element_at(credentials, provider), F.lit("")) != ""
    return has & ((F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.array_contains(allowed, provider))


def pages_per_minute(elapsed_ms: Column, pages: Column) -> Column:
    """Pace of a running batch; 0 in its first seconds."""
    return F.when((elapsed_ms > 3000) & (pages > 0), pages / (elapsed_ms / 60000)).otherwise(F.lit(0.0))
