"""Period reports: this period against the one before."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.base import js_round, parse_tags
from quire.functions.files import strip_source_extension
from quire.functions.base import js_trim, or_else
from quire.operators.library import dense_days
from quire.operators.ordered import row_numbers


def months_ago(now: datetime, months: int) -> datetime:
    """Same clock time; the day is clamped to the target month's last one."""
    index = now.year * 12 + now.month - 1 - months
    year, month = divmod(index, 12)
    first_of_next = datetime(year + (month == 11), month % 12 + 2 if month < 11 else 1, 1)
    last = (first_of_next - timedelta(days=1)).day
    return now.replace(year=year, month=month + 1, day=min(now.day, last))


@dataclass(frozen=True)
class Period:
    """``[start, now]`` and, before it, ``[previous, start)``."""

    previous: datetime
    start: datetime
    now: datetime

    @classmethod
    def of(cls, key: str, now: datetime) -> "Period":
        months = fv.REFLECT_MONTHS.get(key, 1)
        return cls(months_ago(now, months * 2), months_ago(now, months), now)

    def _lit(self, value: datetime) -> Column:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")

    def current(self) -> Column:
        return F.col("created_at").between(self._lit(self.start), self._lit(self.now))

    def before(self) -> Column:
        return (F.col("created_at") >= self._lit(self.previous)) & (F.col("created_at") < self._lit(self.start))


def localised(done: DataFrame, tz: str = "UTC") -> DataFrame:
    """Creation time on the wall clock of a zone."""
    if tz == "UTC":
        return done
    moved = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("created_at"))
    return done.withColumn("created_at", moved)


def totals(done: DataFrame, period: Period) -> DataFrame:
    cur, prev = period.current(), period.before()
    pages = F.coalesce("page_count", F.lit(0))
    both = done.filter(cur | prev)
    add = lambda test, c: F.coalesce(F.sum(F.when(test, c)), F.lit(0))
    return both.agg(
        F.count_if(cur).alias("docs"),
        add(cur, pages).alias("pages"),
        add(cur, F.coalesce("char_count", F.lit(0))).alias("chars"),
        F.count_if(prev).alias("prev_docs"),
        add(prev, pages).alias("prev_pages"),
    )


def histogram(done: DataFrame, period: Period, unit: str) -> DataFrame:
    """Documents by weekday (Monday 0) or hour, every slot present; ``peak`` marks
    the first largest one."""
    size = 7 if unit == "weekday" else 24
    slot = F.weekday("created_at") if unit == "weekday" else F.hour("created_at")
    counts = done.filter(period.current()).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("docs"))
    slots = done.sparkSession.range(size).select(F.col("id").cast("int").alias("slot"))
    filled = slots.join(counts, "slot", "left").select("slot", F.coalesce("docs", F.lit(0)).alias("docs"))
    # at most 24 rows
    best = F.max(F.struct("docs", (-F.col("slot")).alias("minus"))).over(Window.partitionBy(F.lit(1)))
    return filled.select("slot", "docs", ((F.col("docs") > 0) & (-best["minus"] == F.col("slot"))).alias("peak"))


def series(done: DataFrame, period: Period) -> DataFrame:
    """Dense daily documents and pages of the period."""
    return _series(done.filter(period.current()), period.start, period.now)


def previous_series(done: DataFrame, period: Period) -> DataFrame:
    """The period before, cut at its head to the length of the current one."""
    last = period.start - timedelta(days=1)
    dense = _series(done.filter(period.before()), period.previous, last)
    length = (period.now.date() - period.start.date()).days + 1
    first_kept = last.date() - timedelta(days=length - 1)
    return dense.filter(F.col("day") >= F.lit(first_kept.isoformat()).cast("date"))


def _series(items: DataFrame, start: datetime, end: datetime) -> DataFrame:
    days = items.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages")
    )
    at = lambda d: F.max(F.lit(d.date().isoformat()).cast("date"))
    return dense_days(days, at(start), at(end), ["docs", "pages"])


def topics(done: DataFrame, period: Period) -> DataFrame:
    """Topic shares by pages.

    A document's weight is split over its tags to weigh the tags, then the whole
    document goes to its heaviest tag. "Heaviest" is a maximum over the document's
    own tags, so no global ranking of tags is made; only the last six rows meet in
    one task. Weights are exact decimals, ties fall to the tag seen first.
    """
    tags = F.filter(parse_tags(F.col("tags")), lambda t: F.coalesce(t, F.lit("")) != "")
    items = done.filter(period.current()).select(
        "id",
        "created_at",
        F.when(F.coalesce("page_count", F.lit(0)) > 0, F.col("page_count")).otherwise(F.lit(1)).alias("w"),
        F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(fv.UNTAGGED))).alias("tags"),
    )
    seen = F.struct(F.col("created_at"), F.col("id"), F.col("pos"))
    each = items.select(
        "id", "created_at", "w", (F.col("w") / F.size("tags")).cast("decimal(38,12)").alias("part"), F.posexplode("tags").alias("pos", "tag")
    )
    weights = each.groupBy("tag").agg(F.sum("part").alias("freq"), F.min(seen).alias("seen"))
    # earlier first appearance wins: min over (-freq, seen)
    ranked = each.join(weights, "tag").withColumn("_rank", F.struct((-F.col("freq")).alias("f"), "seen", "pos"))
    chosen = ranked.groupBy("id").agg(
        F.min_by("tag", "_rank").alias("tag"), F.max("w").alias("w"), F.max("created_at").alias("created_at")
    )
    per_tag = chosen.groupBy("tag").agg(
        F.sum("w").alias("pages"), F.count(F.lit(1)).alias("docs"), F.min(F.struct("created_at", "id")).alias("seen")
    )
    order = [F.col("pages").desc(), F.col("seen").asc()]
    top = per_tag.orderBy(*order).limit(fv.TOP_TOPICS)
    # every document is in one topic: the rest is all documents less the top five
    size = items.select(F.struct(F.sum("w").alias("pages"), F.count(F.lit(1)).alias("docs"))).scalar()
    head = top.groupBy().agg(
        F.collect_list(F.struct("pages", "docs", "seen", "tag")).alias("five"), F.sum("pages").alias("p"), F.sum("docs").alias("d")
    )
    no_date = F.lit(None).cast("struct<created_at:timestamp_ntz,id:string>")
    other = F.struct(
        (size["pages"] - F.col("p")).alias("pages"), (size["docs"] - F.col("d")).alias("docs"), no_date.alias("seen"), F.lit(fv.OTHER_TOPIC).alias("tag")
    )
    all_six = F.when(size["docs"] > F.col("d"), F.concat("five", F.array(other))).otherwise(F.col("five"))
    six = head.select(F.inline(all_six)).withColumn("last", (F.col("tag") == fv.OTHER_TOPIC).cast("int"))
    # at most six rows from here on
    w = Window.orderBy("last", F.col("pages").desc(), "seen")
    whole = Window.partitionBy(F.lit(1))
    share = js_round(F.col("pages") / F.sum("pages").over(whole) * 100)
    numbered = six.select("tag", "pages", "docs", F.row_number().over(w).alias("rank"), share.cast("long").alias("pct"))
    fixed = F.when(F.col("rank") == 1, F.col("pct") + 100 - F.sum("pct").over(whole)).otherwise(F.col("pct"))
    return numbered.select("rank", "tag", "pages", "docs", F.greatest(fixed, F.lit(0)).alias("percent"))


def item_title() -> Column:
    return js_trim(or_else(F.col("ai_title"), strip_source_extension(F.col("filename"))))


def fingerprint(done: DataFrame, period: Period) -> DataFrame:
    """Changes whenever a document, its title or its tags change.

    A digest per document, added up as integers: partial sums meet instead of a
    sorted list of everything passing through one hash.
    """
    tags = F.array_join(F.filter(parse_tags(F.col("tags")), lambda t: F.coalesce(t, F.lit("")) != ""), "\x01")
    digest = F.sha1(F.concat(F.col("id"), F.lit("\0"), item_title(), F.lit("\0"), tags))
    part = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")
    g = done.filter(period.current()).agg(
        F.count(F.lit(1)).alias("docs"),
        F.coalesce(F.sum(part(1)), F.lit(0)).cast("string").alias("_a"),
        F.coalesce(F.sum(part(13)), F.lit(0)).cast("string").alias("_b"),
    )
    return g.select("docs", F.left(F.sha1(F.concat_ws(":", F.col("docs").cast("string"), "_a", "_b")), F.lit(16)).alias("fingerprint"))


def sample(done: DataFrame, period: Period, cap: int = fv.SAMPLE_CAP) -> DataFrame:
    """Evenly spaced documents for a prompt: all of them up to ``cap``."""
    items = done.filter(period.current()).select("id", "created_at")
    numbered = row_numbers(items, [F.col("created_at").asc(), F.col("id")])
    total = items.select(F.count(F.lit(1))).scalar()
    slot = F.ceil((F.col("n") - 1) * F.lit(cap) / total)
    spaced = (slot < cap) & (F.floor(slot * (total / F.lit(float(cap)))) == F.col("n") - 1)
    return numbered.filter((total <= cap) | spaced).select("n", "id")


def report(done: DataFrame, key: str, now: datetime, tz: str = "UTC") -> dict[str, DataFrame]:
    """All parts of a period report; each is small and lazily computed."""
    rows, period = localised(done, tz), Period.of(key, now)
    return {
        "totals": totals(rows, period),
        "weekdays": histogram(rows, period, "weekday"),
        "hours": histogram(rows, period, "hour"),
        "series": series(rows, period),
        "previous_series": previous_series(rows, period),
        "topics": topics(rows, period),
        "fingerprint": fingerprint(rows, period),
        "sample": sample(rows, period),
    }


def stale(cache: DataFrame, prints: DataFrame) -> DataFrame:
    """Cached texts (``key``, ``fp``) whose fingerprint no longer fits (``key``, ``fingerprint``)."""
    return prints.join(cache, "key", "left").select("key", (~F.col("fp").eqNullSafe(F.col("fingerprint"))).alias("stale"))


def named_topics(topics_df: DataFrame, narrative: DataFrame, lang: str = "en") -> DataFrame:
    """Topics with the names and notes of a recap (``topics``: tag, name, desc as
    ``answers.narratives`` gives them); a topic without one keeps its tag."""
    told = narrative.filter(F.col("topics").isNotNull()).select(F.inline("topics")).groupBy("tag").agg(
        F.max(F.struct("name", "desc")).alias("_t")
    )
    other = "其它" if lang == "zh" else "Everything else"
    plain = F.when(F.col("tag") == fv.OTHER_TOPIC, other).otherwise(F.col("tag"))
    return topics_df.join(told, "tag", "left").select(
        *topics_df.columns,
        F.coalesce(F.nullif(F.col("_t.name"), F.lit("")), plain).alias("name"),
        F.coalesce(F.col("_t.desc"), F.lit("")).alias("desc"),
    )


def plain_headline(topics_df: DataFrame, lang: str = "en") -> DataFrame:
    """A headline from the two largest topics, for periods without a recap."""
    zh = lang == "zh"
    # at most six rows
    lead = topics_df.filter((F.col("tag") != fv.OTHER_TOPIC) & (F.col("rank") <= 2)).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), "和" if zh else " and ").alias("_l")
    )
    some = F.concat(F.lit("这段时间主要在弄" if zh else "A stretch of "), F.col("_l"))
    return lead.select(F.when(F.col("_l") != "", some).otherwise("这段时间还没有转换记录" if zh else "Nothing converted yet").alias("headline"))
