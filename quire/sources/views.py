"""The library's data model over the given tables.

``lib_jobs``   orders as conversion jobs
``lib_pages``  documents as paged documents, one line a page
``lib_calls``  events as the token ledger
``lib_replies`` and ``lib_finals`` model replies for the pages, and final pages

Every view is a declarative plan: filters and column pruning of a query reach
the Parquet scans below it. ``SQL`` holds the same views for the comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import page_state, prices
from quire.sources.tables import table

NOW = "2001-08-01 12:00:00"


def lib_pages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select(
        F.col("doc_id").alias("job_id"), F.posexplode(F.split("text", "\n", -1)).alias("_p", "markdown")
    ).select("job_id", (F.col("_p") + 1).cast("int").alias("page"), "markdown")


def lib_jobs(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))
    )
    k = F.col("o_orderkey")
    pages = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    status = (
        F.when(k % 10 < 7, "done").when(k % 10 == 7, "failed").when(k % 10 == 8, "running").otherwise("queued")
    )
    tags = F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 13 == 0, "[bad").otherwise(
        F.concat(F.lit('["'), F.col("c_mktsegment"), F.lit('","'), F.substr("o_orderpriority", F.lit(3)), F.lit('"]'))
    )
    ms = F.floor("o_totalprice").cast("long")
    created = F.timestamp_add("SECOND", k * 37 % 86400, F.col("o_orderdate"))
    review = F.when(pages == 0, F.lit(0)).otherwise(k % (pages + 1)).cast("long")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        lines, lines.l_orderkey == orders.o_orderkey, "left"
    )
    return joined.select(
        k.cast("string").alias("id"),
        F.concat(F.lit("Doc_"), (k % 400).cast("string"), F.when(k % 5 == 0, ".docx").otherwise(".pdf")).alias("filename"),
        (ms % 4096).alias("file_size"),
        F.left("o_orderpriority", F.lit(1)).alias("mode"),
        status.alias("status"),
        created.alias("created_at"),
        F.timestamp_add("SECOND", F.floor(ms / 1000), created).alias("finished_at"),
        F.timestamp_add("SECOND", F.floor(ms / 1000), created).alias("updated_at"),
        pages.alias("page_count"),
        F.coalesce(F.col("q"), F.lit(0)).cast("long").alias("char_count"),
        review.alias("review_count"),
        F.floor(review / 2).cast("long").alias("fallback_count"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("string")).alias("batch_id"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("c_name")).alias("batch_label"),
        ms.alias("duration_ms"),
        tags.alias("tags"),
        F.when(k % 4 == 0, F.concat(F.lit("Report "), F.col("c_name"))).alias("ai_title"),
        F.when(k % 6 == 0, F.concat(F.col("c_mktsegment"), F.lit(" | order of "), F.substr("o_orderpriority", F.lit(3)))).alias("ai_one_line"),
        F.when(k % 7 == 0, F.lit(None).cast("boolean")).otherwise(k % 2 == 0).alias("filename_meaningful"),
        F.least((k % 9).cast("long"), pages).alias("page"),
    )


def done_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return lib_jobs(spark, folder).filter(F.col("status") == "done")


def lib_calls(spark: SparkSession, folder: str) -> DataFrame:
    return _calls(table(spark, folder, "events"))


def _calls(events: DataFrame) -> DataFrame:
    u, e, v = F.col("user_id"), F.col("event_id"), F.col("value")
    model = (
        F.when(u % 6 == 0, "gemini-2.5-flash").when(u % 6 == 1, "gemini-2.5-pro")
        .when(u % 6 == 2, "gemini-2.5-flash-lite-001").when(u % 6 == 3, "kimi-k2.6")
        .when(u % 6 == 4, "gemini-3.5-flash").otherwise("unlisted-model")
    )
    purpose = F.when(e % 4 == 0, "refine").when(e % 4 == 1, "card").when(e % 4 == 2, "reflect").otherwise("find")
    return events.select(
        "event_id",
        "ts",
        F.col("event_type").alias("provider"),
        model.alias("model"),
        purpose.alias("purpose"),
        u.cast("string").alias("ref"),
        (e % 50).cast("int").alias("page"),
        F.floor(v * 1000).cast("long").alias("input_tokens"),
        (e % 4000).alias("output_tokens"),
        F.floor(v * 250).cast("long").alias("cached_tokens"),
        (e % 7 * 10).alias("thinking_tokens"),
        F.when(e % 9 == 0, v / 100).alias("reported_cost"),
    )


def priced_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger with its cost: the reported one, else the price list's."""
    return price(lib_calls(spark, folder))


def price(calls: DataFrame) -> DataFrame:
    table_cost = prices.estimate_cost(
        F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), F.col("thinking_tokens")
    )
    reported = F.col("reported_cost")
    usable = reported.isNotNull() & ~F.isnan(reported)
    cost = F.when(usable, reported).otherwise(table_cost)
    return calls.withColumn("cost_usd", cost).withColumn(
        "cost_source", F.when(usable, "reported").when(F.col("cost_usd").isNotNull(), "table")
    )


def _reply_choice() -> Column:
    return (F.col("job_id") + F.col("page")) % 6


def lib_replies(spark: SparkSession, folder: str) -> DataFrame:
    """One model reply per page: an error, an empty page, a short, a lossy, a
    doubtful and a good transcription in turn."""
    md, pick = F.col("markdown"), _reply_choice()
    which = (F.col("job_id") + F.col("page")) % 5
    error = (
        F.when(which == 0, "请求超时（90s 未返回）。").when(which == 1, "fetch failed")
        .when(which == 2, "模型请求失败（429）：Your prepayment credits are depleted.")
        .when(which == 3, "模型没有返回有效 JSON。").otherwise("Something odd happened upstream")
    )
    text = (
        F.when(pick == 2, F.left(md, F.floor(F.char_length(md) / 5).cast("int"))).when(pick == 3, F.replace(md, F.lit("$"), F.lit("")))
        .when(pick == 4, F.concat(md, F.lit(" [unclear]"))).when(pick == 5, md)
    )
    return lib_pages(spark, folder).select(
        "job_id",
        "page",
        F.lit(True).alias("r_sent"),
        text.alias("r_markdown"),
        (pick == 1).alias("r_no_text"),
        F.when(pick == 1, "photo").alias("r_note"),
        F.when(pick == 4, F.array(F.lit("symbol"))).alias("r_uncertain"),
        F.when(pick == 0, error).alias("r_error"),
        F.lit("gemini-2.5-flash").alias("r_model"),
        F.lit("gemini").alias("r_provider"),
        F.char_length(md).cast("long").alias("r_input_tokens"),
        F.col("page").cast("long").alias("r_output_tokens"),
        F.lit(None).cast("double").alias("r_cost_usd"),
    )


def lib_drafts(spark: SparkSession, folder: str) -> DataFrame:
    return page_state.draft_from_text(lib_pages(spark, folder))


def lib_finals(spark: SparkSession, folder: str, by: Sequence[str] = ()) -> DataFrame:
    return page_state.answered(lib_drafts(spark, folder), lib_replies(spark, folder), by=by)


def register(spark: SparkSession, folder: str) -> list[str]:
    """Temporary views for read-only ad-hoc SQL."""
    made = {"lib_jobs": lib_jobs, "lib_pages": lib_pages, "lib_calls": priced_calls, "lib_finals": lib_finals}
    for name, view in made.items():
        view(spark, folder).createOrReplaceTempView(name)
    return list(made)
