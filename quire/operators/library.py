"""Library statistics and listings over the job table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import files, labels
from quire.functions.base import js_round, or_else, parse_tags
from quire.operators.ordered import row_numbers, running_total


def newest_first() -> list[Column]:
    return [F.col("created_at").desc(), F.col("id")]


def listing(jobs: DataFrame, limit: int | None = fv.TIMELINE_LIMIT) -> DataFrame:
    ordered = jobs.orderBy(*newest_first())
    return ordered.limit(limit) if limit is not None else ordered


def in_day_range(jobs: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Creation day between the two, both included."""
    if since:
        jobs = jobs.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        jobs = jobs.filter(F.col("created_at") < F.timestamp_add("DAY", F.lit(1), F.lit(until).cast("timestamp_ntz")))
    return jobs


def unfinished(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin("queued", "running")).orderBy("created_at", "id")


def recovered(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """After a restart: unfinished jobs requeue when their source is there, else fail."""
    there = sources.select(F.col("id").alias("_sid")).distinct()
    j = jobs.filter(F.col("status").isin("queued", "running")).join(there, F.col("id") == F.col("_sid"), "left")
    ok = F.col("_sid").isNotNull()
    return j.select(
        "id",
        F.when(ok, "queued").otherwise("failed").alias("status"),
        F.when(ok, "服务重启，已重新排队").alias("detail"),
        F.when(~ok, "服务重启时源文件已丢失。").alias("error"),
    )


def batch_summary(jobs: DataFrame, limit: int | None = fv.BATCH_LIMIT) -> DataFrame:
    s = F.col("status")
    grouped = (
        jobs.filter(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(
            F.max("batch_label").alias("label"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(s == "done").alias("done"),
            F.count_if(s.isin("queued", "running")).alias("active"),
            F.count_if(s.isin("failed", "cancelled")).alias("failed"),
            F.sum("page_count").alias("pages"),
            F.min("created_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
        )
    )
    return grouped if limit is None else grouped.orderBy(F.col("created_at").desc(), "batch_id").limit(limit)


def totals(done: DataFrame) -> DataFrame:
    return done.agg(
        F.count(F.lit(1)).alias("docs"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"),
        F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"),
    )


def daily(done: DataFrame) -> DataFrame:
    return done.groupBy(F.to_date("created_at").alias("day")).agg(
        F.sum("page_count").alias("pages"), F.count(F.lit(1)).alias("docs")
    )


def dense_days(days: DataFrame, first: Column, last: Column, measures: list[str]) -> DataFrame:
    """One row per calendar day between two one-row bounds; missing days are 0.

    ``days`` holds one row per day, so its size is bounded by the calendar.
    """
    span = days.agg(first.alias("_a"), last.alias("_b"))
    calendar = span.filter(F.col("_a").isNotNull()).select(F.explode(F.sequence("_a", "_b")).alias("day"))
    zero = [F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures]
    return calendar.join(days, "day", "left").select("day", *zero)


def cumulative_pages(done: DataFrame) -> DataFrame:
    dense = dense_days(daily(done), F.min("day"), F.max("day"), ["pages"])
    # one row per calendar day: the single-task window is bounded by the calendar
    running = F.sum("pages").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return dense.select("day", running.alias("pages"))


def top_tags(done: DataFrame, limit: int = fv.TOP_TAGS) -> DataFrame:
    return (
        done.filter(F.coalesce(F.col("tags"), F.lit("")) != "")
        .select(F.explode(parse_tags(F.col("tags"))).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("docs"))
        .orderBy(F.col("docs").desc(), "tag")
        .limit(limit)
    )


def by_mode(done: DataFrame) -> DataFrame:
    return done.groupBy("mode").agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages")
    )


def speed_table(done: DataFrame) -> DataFrame:
    """Median seconds per page of each mode's newest documents.

    The rank filter is pushed below the shuffle (window group limit), so each
    task sends at most the window size per mode.
    """
    w = Window.partitionBy("mode").orderBy(F.col("finished_at").desc(), "id")
    recent = (
        done.filter((F.col("duration_ms") > 0) & (F.col("page_count") > 0))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= fv.SPEED_WINDOW)
    )
    pace = F.col("duration_ms") / 1000 / F.col("page_count")
    g = recent.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.median(pace).alias("_m"))
    return g.select("mode", "n", F.when(F.col("n") >= fv.SPEED_MINIMUM, js_round(F.col("_m"), 2)).alias("sec_per_page"))


def months(done: DataFrame) -> DataFrame:
    return done.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("page_count").alias("pages")
    )


def quality_counts(done: DataFrame) -> DataFrame:
    fell = F.coalesce(F.col("fallback_count"), F.lit(0)) > 0
    return done.agg(
        F.count_if(fell).alias("fallback"), F.count_if((F.col("review_count") > 0) & ~fell).alias("review")
    )


def badges(done: DataFrame) -> DataFrame:
    badge = labels.quality_badge(F.col("review_count"), F.col("fallback_count"))
    return done.groupBy(badge.alias("tone")).agg(F.count(F.lit(1)).alias("docs"))


def library_filter(done: DataFrame, term: str, text_hits: DataFrame, quality: str = "all") -> DataFrame:
    """Documents whose name, title, one-liner or tag holds the term, or whose
    text does; most text hits first. ``text_hits``: job_id, hits."""
    if quality == "fallback":
        done = done.filter(F.coalesce(F.col("fallback_count"), F.lit(0)) > 0)
    elif quality == "review":
        done = done.filter((F.col("review_count") > 0) & (F.coalesce(F.col("fallback_count"), F.lit(0)) == 0))
    needle = F.lit(term.strip().lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)
    named = has(F.col("filename")) | has(F.col("ai_title")) | has(F.col("ai_one_line")) | F.exists(parse_tags(F.col("tags")), has)
    hits = text_hits.select(F.col("job_id").cast("string").alias("id"), "hits")
    joined = done.join(hits, "id", "left")
    return joined.filter(named | F.col("hits").isNotNull()).withColumn("hits", F.coalesce("hits", F.lit(0)))


def timeline(done: DataFrame, batches: DataFrame) -> DataFrame:
    """Library rows by last change: a batch is its own row, neighbouring single
    documents of one day share one.

    A run of singles ends at a day's edge or at a batch, so its number is the
    count of the batches that come before it that day: a running total over
    ranges of rows, not a sort of the whole library.
    """
    singles = done.filter(F.col("batch_id").isNull()).select(
        F.col("id").alias("entry"), "updated_at", F.lit(0).alias("is_batch"), F.lit(1).cast("long").alias("docs")
    )
    members = done.filter(F.col("batch_id").isNotNull()).groupBy("batch_id").agg(F.count(F.lit(1)).alias("docs"))
    grouped = batches.join(members, "batch_id").select(
        F.col("batch_id").alias("entry"), "updated_at", F.lit(1).alias("is_batch"), "docs"
    )
    entries = singles.unionByName(grouped).withColumn("day", F.to_date("updated_at"))
    order = [F.col("updated_at").desc(), F.col("is_batch").asc(), F.col("entry")]
    counted = running_total(
        entries, F.col("is_batch").cast("long"), order, ["day"], "run"
    )
    key = F.when(F.col("is_batch") == 1, F.concat(F.lit("batch:"), "entry")).otherwise(
        F.concat(F.lit("run:"), F.col("run").cast("string"))
    )
    return (
        counted.groupBy("day", key.alias("row_key"))
        .agg(
            F.max("updated_at").alias("updated_at"),
            F.sum("docs").alias("docs"),
            F.max("is_batch").alias("is_batch"),
        )
    )


def unique_entry_names(done: DataFrame) -> DataFrame:
    """Archive entry names; a repeated base gets `` (2)``, `` (3)`` by arrival."""
    base = files.safe_entry_name(F.col("filename"), F.left("id", F.lit(fv.SHORT_ID)))
    rows = done.select("id", "created_at", base.alias("base"))
    numbered = row_numbers(rows, newest_first(), ["base"])
    suffix = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return numbered.select("id", F.concat("base", suffix, F.lit(".md")).alias("entry"))


def stage_duplicates(staged: DataFrame, done: DataFrame) -> DataFrame:
    """Was a staged file converted before? PDFs match on name and size, the
    rest (and PDFs of another size) on the name, newest first.

    The library is reduced to one row per name and per (name, size) before the
    joins, so a name shared by many documents does not multiply rows.
    """
    newest = F.max_by("id", F.struct("created_at", "id"))
    by_name = done.groupBy("filename").agg(newest.alias("_any"))
    by_size = done.groupBy("filename", "file_size").agg(newest.alias("_same"))
    pdf = files.file_kind(F.col("filename")) == "pdf"
    joined = staged.join(by_size, ["filename", "file_size"], "left").join(by_name, "filename", "left")
    exact = pdf & F.col("_same").isNotNull()
    return joined.select(
        *staged.columns, F.when(exact, F.col("_same")).otherwise(F.col("_any")).alias("match_id"), exact.alias("exact")
    )


def batch_progress(jobs: DataFrame) -> DataFrame:
    """Percent done of each batch; unfinished members count by their pages."""
    finished = F.col("status").isin("done", "failed", "cancelled")
    part = F.when(finished, F.lit(100.0)).otherwise(
        F.coalesce(F.col("page") / F.nullif(F.col("page_count"), F.lit(0)) * 100, F.lit(0.0))
    )
    # exact decimals: the mean does not depend on the order of addition
    mean = F.sum(part.cast("decimal(38,12)")) / F.count(F.lit(1))
    return (
        jobs.filter(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(
            js_round(mean.cast("double")).cast("long").alias("percent"),
            F.sum(F.when(finished, F.col("page_count")).otherwise(F.col("page"))).alias("pages_done"),
            F.sum("page_count").alias("pages_total"),
        )
    )


def staged_estimate(staged: DataFrame, speed: DataFrame, cost_per_page: float | None = None) -> DataFrame:
    """Pages, unknown counts, seconds and cost ahead, by mode."""
    g = staged.groupBy("mode").agg(
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.count_if(F.col("page_count").isNull()).alias("unknown")
    )
    pages = F.col("pages")
    cost = F.lit(cost_per_page).cast("double") if cost_per_page is not None else F.lit(None).cast("double")
    return g.join(speed.select("mode", "sec_per_page"), "mode", "left").select(
        "mode",
        "pages",
        "unknown",
        F.when(pages > 0, js_round(pages * F.col("sec_per_page"), 2)).alias("secs"),
        F.when(pages > 0, js_round(pages * cost, 6)).alias("cost"),
    )


def title_of() -> Column:
    return or_else(F.col("ai_title"), F.col("filename"))


def reconcile_index(index: DataFrame, done: DataFrame) -> DataFrame:
    """What a search index must do: ``index`` (id, stamp) against the library.
    Actions: keep, reload (stamp changed), load (new), drop (gone)."""
    lib = done.select("id", F.col("updated_at").alias("new_stamp"))
    both = index.join(lib, "id", "full_outer")
    action = (
        F.when(F.col("new_stamp").isNull(), "drop")
        .when(F.col("stamp").isNull(), "load")
        .when(F.col("stamp") == F.col("new_stamp"), "keep")
        .otherwise("reload")
    )
    return both.select("id", action.alias("action"))


def refresh_index(index_pages: DataFrame, actions: DataFrame, fresh_pages: DataFrame) -> DataFrame:
    """The next index: kept documents' pages and the changed ones' new pages."""
    kept = index_pages.join(actions.filter(F.col("action") == "keep").select("id"), index_pages.job_id == F.col("id"), "left_semi")
    todo = actions.filter(F.col("action").isin("load", "reload")).select("id")
    return kept.unionByName(fresh_pages.join(todo, fresh_pages.job_id == F.col("id"), "left_semi"))


def members_from_two(recent: DataFrame, library: DataFrame) -> DataFrame:
    """Union of two overlapping scans by id; the first one's row wins."""
    both = recent.withColumn("_src", F.lit(0)).unionByName(library.withColumn("_src", F.lit(1)))
    cols = [c for c in both.columns if c not in ("_src", "id")]
    picked = both.groupBy("id").agg(F.min_by(F.struct(*cols), "_src").alias("_r"))
    return picked.select("id", "_r.*")


def with_summary(jobs: DataFrame, summary: DataFrame, previews: DataFrame) -> DataFrame:
    """Job rows with the summary columns of their pages written anew. ``summary``
    is that of ``pages.summary``; jobs without pages keep what they had."""
    fresh = ["page_count", "review_count", "ai_pages", "char_count", "fallback_count"]
    s = summary.select(F.col("job_id").cast("string").alias("id"), F.struct(*fresh).alias("_s"))
    p = previews.select(F.col("job_id").cast("string").alias("id"), F.col("preview").alias("_preview"))
    joined = jobs.join(s, "id", "left").join(p, "id", "left")
    new = {c: F.coalesce(F.col(f"_s.{c}"), F.col(c)) if c in jobs.columns else F.col(f"_s.{c}") for c in fresh}
    new["preview"] = F.coalesce("_preview", "preview") if "preview" in jobs.columns else F.col("_preview")
    return joined.withColumns(new).drop("_s", "_preview")


def needs_preview(done: DataFrame) -> DataFrame:
    """Documents whose stored preview is missing or of the old kind."""
    p = F.col("preview")
    return done.filter(p.isNull() | p.rlike("由[^，]*转换，共") | p.contains("]("))


def needs_tags(done: DataFrame) -> DataFrame:
    """Documents without tags or without a title."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return done.filter(blank("tags") | blank("ai_title"))


def without(jobs: DataFrame, removed: DataFrame) -> DataFrame:
    """The library less the removed ids."""
    return jobs.join(removed.select("id"), "id", "left_anti")
