"""Model answers: from raw text to typed, bounded columns.

An answer that cannot be read gives NULL (or an ``error`` text), never an
exception, so one bad answer does not end a job over millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.base import js_trim

REFINE_SCHEMA = (
    "markdown string, formulaCount double, questionNumbers array<string>, optionLabels array<string>, "
    "uncertain array<string>, noText boolean, note string"
)
CARD_SCHEMA = "tags array<string>, title string, one_line string, filename_meaningful boolean"
FIND_SCHEMA = "results array<struct<n:string,why:string>>"
DEEP_SCHEMA = "results array<struct<d:string,page:string,why:string>>, note string"
NARRATIVE_SCHEMA = (
    "zh struct<headline:string,narrative:string>, en struct<headline:string,narrative:string>, "
    "topics array<struct<tag:string,name_zh:string,desc_zh:string,name_en:string,desc_en:string>>"
)


def _braces(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is no such span."""
    first = F.instr(text, F.lit("{"))
    last = F.char_length(text) - F.instr(F.reverse(text), F.lit("}")) + 1
    has = (first > 0) & F.contains(text, F.lit("}")) & (last > first)
    return F.when(has, F.substring(text, first, last - first + 1))


def strip_fence(clean: Column) -> Column:
    opened = F.regexp_replace(clean, rf"(?i)^```(?:json)?{fv.WS}*", "")
    return F.regexp_replace(opened, rf"{fv.WS}*```\z", "")


def json_text(clean: Column) -> Column:
    """The JSON object of an unfenced answer that may be wrapped in prose."""
    return F.when(F.startswith(clean, F.lit("{")) & F.endswith(clean, F.lit("}")), clean).otherwise(_braces(clean))


def fenced_json_text(clean: Column) -> Column:
    """As above for reports: a ```json fence wins, else from the first ``{``."""
    fenced = F.regexp_extract(clean, rf"```json{fv.WS}*([\s\S]*?){fv.WS}*```", 1)
    text = F.when(fenced != "", fenced).otherwise(clean)
    first = F.instr(text, F.lit("{"))
    return F.when(first > 0, F.substr(text, first))


def _text(c: Column) -> Column:
    return js_trim(F.coalesce(c, F.lit("")))


def _strings(c: Column, limit: int, drop_empty: bool = False) -> Column:
    items = F.coalesce(c, F.array().cast("array<string>"))
    if drop_empty:
        items = F.filter(items, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.slice(items, 1, limit)


def parsed(df: DataFrame, raw: Column, schema: str, fenced: bool = False) -> DataFrame:
    """Adds ``_a``, the answer as a struct. The text is cut and parsed in steps of
    their own, so no step is evaluated once per field that reads it."""
    clean = js_trim(F.coalesce(raw, F.lit("")))
    if fenced:
        step = df.withColumn("_clean", clean).withColumn("_json", fenced_json_text(F.col("_clean")))
    else:
        step = df.withColumn("_clean", strip_fence(clean)).withColumn("_json", json_text(F.col("_clean")))
    return step.withColumn("_a", F.from_json("_json", schema)).drop("_clean", "_json")


def page_answers(df: DataFrame, raw: Column, out: str = "answer") -> DataFrame:
    """A page transcription; ``error`` is set when it holds neither text nor a note."""
    a = F.col("_a")
    staged = parsed(df, raw, REFINE_SCHEMA).withColumn("_md", _text(a["markdown"])).withColumn("_note", F.left(_text(a["note"]), F.lit(200)))
    markdown, note = F.col("_md"), F.col("_note")
    no_text = F.coalesce(a["noText"], F.lit(False)) | ((markdown == "") & (note != ""))
    readable = F.coalesce(a["markdown"], a["note"], a["noText"].cast("string")).isNotNull()
    error = F.when(~readable, F.lit("模型没有返回有效 JSON。")).when((markdown == "") & ~no_text, F.lit("模型返回了空白 Markdown。"))
    answer = F.struct(
        markdown.alias("markdown"),
        no_text.alias("no_text"),
        note.alias("note"),
        F.greatest(F.lit(0), F.floor(F.coalesce(a["formulaCount"], F.lit(0.0)) + 0.5)).cast("long").alias("formula_count"),
        _strings(a["questionNumbers"], 200).alias("question_numbers"),
        _strings(a["optionLabels"], 400).alias("option_labels"),
        _strings(a["uncertain"], 30, drop_empty=True).alias("uncertain"),
        error.alias("error"),
    )
    return staged.withColumn(out, answer).drop("_a", "_md", "_note")


def card_answers(df: DataFrame, raw: Column, out: str = "card") -> DataFrame:
    """Title cards; answers without a single tag give no row. The card is made by
    a generator, so dropping rows does not evaluate the parsing twice."""
    a = F.col("_a")
    cut = F.transform(F.coalesce(a["tags"], F.array().cast("array<string>")), lambda t: F.left(js_trim(t), F.lit(24)))
    tags = F.slice(F.filter(cut, lambda t: F.coalesce(t, F.lit("")) != ""), 1, 4)
    card = F.struct(
        F.col("_tags").alias("tags"),
        F.nullif(F.left(_text(a["title"]), F.lit(30)), F.lit("")).alias("title"),
        F.nullif(F.left(_text(a["one_line"]), F.lit(60)), F.lit("")).alias("one_line"),
        a["filename_meaningful"].alias("filename_meaningful"),
    )
    staged = parsed(df, raw, CARD_SCHEMA).withColumn("_tags", tags)
    return staged.select(*df.columns, F.explode(F.when(F.size("_tags") > 0, F.array(card))).alias(out))


def narratives(df: DataFrame, raw: Column, lang: str, out: str = "narrative") -> DataFrame:
    """One language's recap; NULL when its headline is missing."""
    a = F.col("_a")
    part = a[lang]
    head = F.regexp_replace(_text(part["headline"]), r"[。.]+\z", "")
    tagged = F.filter(a["topics"], lambda t: F.coalesce(t["tag"], F.lit("")) != "")
    topics = F.transform(tagged, lambda t: F.struct(
        t["tag"].alias("tag"),
        F.left(js_trim(F.coalesce(F.nullif(t[f"name_{lang}"], F.lit("")), t["tag"])), F.lit(40)).alias("name"),
        F.left(_text(t[f"desc_{lang}"]), F.lit(120)).alias("desc"),
    ))
    text = F.struct(
        F.left(head, F.lit(60 if lang == "zh" else 120)).alias("headline"),
        F.left(_text(part["narrative"]), F.lit(800)).alias("narrative"),
        topics.alias("topics"),
    )
    has = F.coalesce(part["headline"], F.lit("")) != ""
    return parsed(df, raw, NARRATIVE_SCHEMA, fenced=True).withColumn(out, F.when(has, text)).drop("_a")


def find_picks(df: DataFrame, raw: Column, schema: str = FIND_SCHEMA) -> DataFrame:
    """A search answer's picks, one row each with their position; ``error`` rows
    for answers that hold no readable JSON."""
    staged = df.withColumn("_raw", F.coalesce(raw, F.lit(""))).withColumn("_span", _braces(F.col("_raw")))
    a = staged.withColumn("_a", F.from_json("_span", schema))
    error = F.when(F.col("_span").isNull(), F.concat(F.lit("模型没有返回 JSON："), F.left("_raw", F.lit(120)))).when(
        F.col("_a.results").isNull(), F.lit("模型返回的 JSON 解析不了"))
    picks = a.withColumn("error", error).select(*df.columns, "error", F.posexplode_outer("_a.results").alias("position", "_r"))
    return picks.select(*df.columns, "error", "position", "_r.*")


def command_steps(df: DataFrame, command: Column, tool: str = "look", out: str = "step") -> DataFrame:
    """(verb, args) of tool command lines; NULL for anything else. Words, tool
    position and arguments are columns of their own, so each is taken once."""
    words = F.transform(
        F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(r"\"[^\"]*\"|'[^']*'|\S+"), F.lit(0)),
        lambda w: F.regexp_replace(w, r"^[\"']|[\"']\z", ""),
    )
    is_tool = lambda w: F.regexp_replace(w, r"\.\w+\z", "").rlike(rf"(^|/){tool}\z")
    staged = df.withColumn("_words", words).withColumn("_at", F.array_position(F.transform("_words", is_tool), F.lit(True)).cast("int"))
    after = F.slice("_words", F.col("_at") + 1, F.greatest(F.size("_words") - F.col("_at"), F.lit(0)))
    staged = staged.withColumn("_after", after)
    start = F.struct(F.array().cast("array<string>").alias("args"), F.lit("").alias("option"))
    rest = F.slice("_after", 2, F.greatest(F.size("_after") - 1, F.lit(0)))

    def step(acc: Column, w: Column) -> Column:
        is_value = acc["option"] != ""
        is_option = F.startswith(w, F.lit("--"))
        page = F.array(F.concat(F.lit("p"), w))
        args = (
            F.when(is_value, F.when(acc["option"] == "--page", F.concat(acc["args"], page)).otherwise(acc["args"]))
            .when(is_option, acc["args"])
            .otherwise(F.concat(acc["args"], F.array(w)))
        )
        option = F.when(is_value, F.lit("")).when(is_option & (w != "--any"), w).otherwise(F.lit(""))
        return F.struct(args.alias("args"), option.alias("option"))

    verb = F.get("_after", F.lit(0))
    known = verb.isin("search", "hits", "read", "info", "list", "stats")
    args = F.aggregate(rest, start, step, lambda acc: acc["args"])
    value = F.when((F.col("_at") > 0) & known, F.struct(verb.alias("verb"), args.alias("args")))
    return staged.withColumn(out, value).drop("_words", "_at", "_after")
