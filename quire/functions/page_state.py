"""What a page finally is.

A draft page plus a model reply gives one of four outcomes (adopted, no text,
rejected, failed); an untouched draft stays local. Everything here is a Column
expression over flat columns, so a whole library is one narrow projection after
the join of drafts and replies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.base import js_trim, line_count
from quire.functions.text import count_formulas, count_options, visible_length

PAGE_COLUMNS = [
    "job_id", "page", "markdown", "raw_markdown", "char_count", "line_count", "method", "status", "reasons",
    "formula_count", "option_count", "uncertain", "ai_attempted", "no_text", "note", "ai_failed", "model",
    "provider", "input_tokens", "output_tokens", "cost_usd",
]


def _none() -> Column:
    return F.array().cast("array<string>")


def outcome(method: str = "method", no_text: str = "no_text", attempted: str = "ai_attempted") -> Column:
    return (
        F.when(F.col(method) == "ai", F.when(F.coalesce(F.col(no_text), F.lit(False)), "noText").otherwise("ai"))
        .when(F.coalesce(F.col(attempted), F.lit(False)), "fallback")
        .otherwise("local")
    )


def is_fallback() -> Column:
    return outcome() == "fallback"


def draft_from_text(pages: DataFrame) -> DataFrame:
    """Fast-mode page: the text layer as found; a nearly empty one asks for review."""
    md = F.col("markdown")
    thin = F.char_length(js_trim(md)) < fv.THIN_TEXT
    return pages.select(
        "job_id",
        "page",
        "markdown",
        visible_length(md).cast("long").alias("char_count"),
        line_count(md).cast("long").alias("line_count"),
        F.when(md != "", "text").otherwise("empty").alias("method"),
        F.when(thin, "review").otherwise("good").alias("status"),
        F.when(thin, F.array(F.lit(fv.REASON_THIN_TEXT))).otherwise(_none()).alias("reasons"),
        count_formulas(md).cast("long").alias("formula_count"),
        count_options(md).cast("long").alias("option_count"),
    )


def validation_failures(draft: tuple[Column, Column, Column], reply: tuple[Column, Column, Column], blank: Column, no_text: Column) -> Column:
    """Reasons why a reply must not replace the draft; empty when it may.
    ``draft`` and ``reply`` are (visible length, formulas, options)."""
    (before, formulas, options), (after, new_formulas, new_options) = draft, reply
    floor = F.greatest(F.lit(float(fv.SHORT_FLOOR)), before * F.lit(fv.SHORT_RATIO))
    checks = F.array(
        F.when(blank, F.lit(fv.FAIL_BLANK)),
        F.when((before >= fv.SHORT_DRAFT) & (after < floor), F.lit(fv.FAIL_SHORT)),
        F.when((formulas > 0) & (new_formulas < formulas), F.lit(fv.FAIL_FORMULA)),
        F.when((options >= 2) & (new_options < options), F.lit(fv.FAIL_OPTION)),
    )
    return F.when(F.coalesce(no_text, F.lit(False)), _none()).otherwise(F.array_compact(checks))


MEASURES = ("_visible", "_formulas", "_options", "_lines", "_blank", "_unclear")


def measured(replies: DataFrame) -> DataFrame:
    """Replies with what is known of their texts. Taken before replies meet drafts, so that a
    text goes through the join only where it is wanted."""
    reply = F.coalesce(F.col("r_markdown"), F.lit(""))
    trimmed = js_trim(reply)
    made = (
        visible_length(reply).cast("long"), count_formulas(reply).cast("long"), count_options(reply).cast("long"), line_count(trimmed).cast("long"),
        trimmed == "", F.contains(reply, F.lit(fv.UNCLEAR)))
    return replies.withColumns(dict(zip(MEASURES, made, strict=True)))


def answered(drafts: DataFrame, replies: DataFrame, keys: Sequence[str] = ("job_id", "page"), by: Sequence[str] = ()) -> DataFrame:
    """Final pages of drafts and their replies, one at most for each. ``by``: the keys to deal both
    out by, where all pages of a document are wanted together afterwards."""
    left, right = drafts.withColumn("_written", F.col("markdown") != ""), measured(replies)
    if by:
        left, right = left.repartition(*by), right.repartition(*by)
    return apply_reply(left.join(right, list(keys), "left"))


def checked(joined: DataFrame) -> DataFrame:
    """Drafts joined with replies, plus the reply's metrics, where ``answered`` has not taken
    them already, and the failed checks."""
    metrics = joined if set(MEASURES) <= set(joined.columns) else measured(joined)
    if "_written" not in joined.columns:
        metrics = metrics.withColumn("_written", F.col("markdown") != "")
    failures = validation_failures(
        (F.col("char_count"), F.col("formula_count"), F.col("option_count")),
        (F.col("_visible"), F.col("_formulas"), F.col("_options")),
        F.col("_blank"), F.col("r_no_text"))
    return metrics.withColumn("_failures", failures)


def apply_reply(joined: DataFrame) -> DataFrame:
    """Final pages from drafts left-joined with replies.

    Reply columns carry the prefix ``r_``: markdown, no_text, note, uncertain,
    error, model, provider, input_tokens, output_tokens, cost_usd. ``r_sent``
    is NULL where the page was not given to the model.
    """
    md, reasons = F.col("markdown"), F.col("reasons")
    final = js_trim(F.coalesce(F.col("r_markdown"), F.lit("")))
    step = (
        F.when(F.col("r_sent").isNull(), "local")
        .when(F.col("r_error").isNotNull(), "failed")
        .when(F.size("_failures") > 0, "rejected")
        .when(F.coalesce(F.col("r_no_text"), F.lit(False)), "noText")
        .otherwise("ok")
    )
    staged = checked(joined).withColumn("_step", step)
    step = F.col("_step")
    used, adopted = step.isin("ok", "noText"), step == "ok"
    note = F.coalesce(F.col("r_note"), F.lit(""))
    uncertain = F.coalesce(F.col("r_uncertain"), _none())
    doubts = F.concat(
        F.transform(uncertain, lambda x: F.concat(F.lit(fv.REASON_UNCERTAIN), x)),
        F.when(F.col("_unclear"), F.array(F.lit(fv.REASON_UNREADABLE))).otherwise(_none()),
    )
    nothing = F.concat(
        F.lit(fv.REASON_NO_TEXT), F.when(note != "", F.concat(F.lit("（"), note, F.lit("）"))).otherwise(F.lit(""))
    )
    rejected = F.concat(F.lit(fv.REASON_REJECTED), F.array_join(F.col("_failures"), fv.FAILURE_JOINER))
    failed = F.concat(
        F.when(F.col("_written"), F.lit(fv.REASON_FAILED_TEXT)).otherwise(F.lit(fv.REASON_FAILED_EMPTY)), F.col("r_error")
    )
    new_reasons = (
        F.when(adopted, doubts)
        .when(step == "noText", F.array(nothing))
        .when(step == "rejected", F.concat(reasons, F.array(rejected)))
        .when(step == "failed", F.concat(reasons, F.array(failed)))
        .otherwise(reasons)
    )
    answered = step.isin("ok", "noText", "rejected")
    pick = lambda ok, empty, keep: F.when(adopted, ok).when(step == "noText", empty).otherwise(keep)
    out = staged.withColumn("_reasons", new_reasons)
    return out.select(
        "job_id",
        "page",
        pick(final, F.lit(""), md).alias("markdown"),
        F.when(step != "local", md).alias("raw_markdown"),
        pick(F.col("_visible"), F.lit(0).cast("long"), F.col("char_count")).alias("char_count"),
        pick(F.col("_lines"), F.lit(0).cast("long"), F.col("line_count")).alias("line_count"),
        F.when(used, "ai").otherwise(F.col("method")).alias("method"),
        F.when(step == "local", F.col("status"))
        .when(adopted & (F.size("_reasons") == 0), "good")
        .otherwise("review")
        .alias("status"),
        F.col("_reasons").alias("reasons"),
        pick(F.col("_formulas"), F.lit(0).cast("long"), F.col("formula_count")).alias("formula_count"),
        pick(F.col("_options"), F.lit(0).cast("long"), F.col("option_count")).alias("option_count"),
        F.when(adopted, uncertain).when(step == "noText", _none()).alias("uncertain"),
        (step != "local").alias("ai_attempted"),
        F.when(step == "noText", F.lit(True)).alias("no_text"),
        F.when(step == "noText", note).alias("note"),
        F.when(step == "failed", F.lit(True)).alias("ai_failed"),
        F.when(answered, F.col("r_model")).alias("model"),
        F.when(answered, F.col("r_provider")).alias("provider"),
        F.when(answered, F.col("r_input_tokens")).alias("input_tokens"),
        F.when(answered, F.col("r_output_tokens")).alias("output_tokens"),
        F.when(answered, F.col("r_cost_usd")).alias("cost_usd"),
    )


def to_draft(pages: DataFrame) -> DataFrame:
    """Last round's result as this round's draft: only draft fields survive,
    the model's reasons go, metrics are taken again, the status stays."""
    md = F.coalesce(F.col("raw_markdown"), F.col("markdown"), F.lit(""))
    reasons = F.filter(F.coalesce(F.col("reasons"), _none()), lambda r: ~r.rlike(fv.AI_REASON))
    known = F.when((F.coalesce(F.col("method"), F.lit("")) != "") & (F.col("method") != "ai"), F.col("method"))
    return pages.select(
        "job_id",
        "page",
        md.alias("markdown"),
        visible_length(md).cast("long").alias("char_count"),
        line_count(md).cast("long").alias("line_count"),
        F.coalesce(known, F.when(md != "", "surya").otherwise("empty")).alias("method"),
        "status",
        reasons.alias("reasons"),
        count_formulas(md).cast("long").alias("formula_count"),
        count_options(md).cast("long").alias("option_count"),
    )


def parse_reason(reason: Column) -> Column:
    """One reason line as (stage, message, page_empty); NULL when it is not
    about a failed or rejected model step."""
    after = lambda prefix: F.substr(reason, F.lit(len(prefix) + 1))
    make = lambda stage, message, empty: F.struct(
        F.lit(stage).alias("stage"), message.alias("message"), F.lit(empty).alias("page_empty")
    )
    return (
        F.when(F.startswith(reason, F.lit(fv.REASON_FAILED_TEXT)), make("call", after(fv.REASON_FAILED_TEXT), False))
        .when(F.startswith(reason, F.lit(fv.REASON_FAILED_EMPTY)), make("call", after(fv.REASON_FAILED_EMPTY), True))
        .when(F.startswith(reason, F.lit(fv.REASON_REJECTED)), make("check", after(fv.REASON_REJECTED), False))
    )


def fallback_cause(reasons: Column) -> Column:
    """The last reason that names a failed or rejected model step."""
    parsed = F.filter(F.transform(reasons, parse_reason), lambda c: c.isNotNull())
    return F.try_element_at(parsed, F.lit(-1))


def error_kind(message: Column, stage: Column | None = None) -> Column:
    detail = js_trim(F.coalesce(message, F.lit("")))
    chain = F.when(stage == "check", "rejected") if stage is not None else None
    for kind, pattern in fv.ERROR_RULES:
        hit = detail.rlike(pattern)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("unknown")


def retry_helps(kind: Column) -> Column:
    yes = [k for k, v in fv.RETRY_HELPS.items() if v is True]
    no = [k for k, v in fv.RETRY_HELPS.items() if v is False]
    return F.when(kind.isin(yes), F.lit(True)).when(kind.isin(no), F.lit(False))


def refine_targets(drafts: DataFrame, finished: DataFrame, scope: str = "all") -> DataFrame:
    """Pages still to be given to the model: not finished yet and in scope."""
    todo = drafts.join(finished.select("job_id", "page"), ["job_id", "page"], "left_anti")
    if scope == "all":
        return todo
    return todo.filter((F.col("status") == "review") | (F.col("formula_count") > 0) | (F.col("option_count") > 0))


def settle_cancelled(has_result: Column) -> Column:
    """A cancelled rerun goes back to done; a cancelled first run is cancelled."""
    return F.when(has_result, "done").otherwise("cancelled")


def patched_finish(status: Column, finished_at: Column, now: Column) -> Column:
    """Terminal states stamp the finish, a requeue clears it, others keep it."""
    return (
        F.when(status.isin("done", "failed", "cancelled"), now)
        .when(status == "queued", F.lit(None).cast("timestamp"))
        .otherwise(finished_at)
    )
