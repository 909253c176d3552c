"""Stored results: documents in a versioned table, or one JSON file per document, and the
tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import settings
from quire.sources.versions import Part, Versions

PAGE = (
    "struct<page:int,markdown:string,rawMarkdown:string,charCount:bigint,lineCount:bigint,method:string,status:string,"
    "reasons:array<string>,formulaCount:bigint,optionCount:bigint,uncertain:array<string>,aiAttempted:boolean,noText:boolean,"
    "note:string,model:string,provider:string,durationMs:bigint,modelMs:bigint,"
    "usage:struct<inputTokens:bigint,outputTokens:bigint,costUsd:double>>"
)
FIELDS = {"title": "string", "mode": "string", "pageCount": "bigint", "markdown": "string", "durationMs": "double", "pages": f"array<{PAGE}>"}
RESULT = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
STORED = f"job_id string, {RESULT}"
PATCH = "job_id string, " + ", ".join(f"{name} struct<v:{kind}>" for name, kind in FIELDS.items())
#: Patches that lie beside the documents of a bucket at most.
LAYERS = 8
#: What a write has shuffled is deleted when it has ended, not at some later collection of garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
OCR_PAGE = "struct<blocks:array<struct<label:string,html:string,reading_order:int,error:boolean>>>"

_NAMES = {
    "page": "page", "markdown": "markdown", "rawMarkdown": "raw_markdown", "charCount": "char_count", "lineCount": "line_count",
    "method": "method", "status": "status", "reasons": "reasons", "formulaCount": "formula_count", "optionCount": "option_count",
    "uncertain": "uncertain", "aiAttempted": "ai_attempted", "noText": "no_text", "note": "note", "model": "model",
    "provider": "provider", "durationMs": "duration_ms", "modelMs": "model_ms", "usage": "usage",
}


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``<path>/<job_id>/result.json`` files and the rows of ``write_results``, one row each;
    ``readable`` is false where the JSON cannot be parsed."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "result.json").option("wholetext", "true").text(path)
    )
    job = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\z", 1).alias("job_id")
    parsed = raw.select(job, F.from_json("value", RESULT).alias("r"))
    readable = F.coalesce("r.pageCount", "r.markdown", "r.title", F.size("r.pages").cast("string")).isNotNull().alias("readable")
    table = Versions(spark, path)
    own = _documents(table, table.latest()[1])
    return parsed.select("job_id", readable, "r.*").unionByName(own.withColumn("readable", F.lit(True)))


def result_pages(results: DataFrame) -> DataFrame:
    """Page rows of stored results."""
    pages = results.select("job_id", F.inline("pages"))
    return pages.select("job_id", *[F.col(k).alias(v) for k, v in _NAMES.items()])


def page_struct() -> Column:
    """Page row as the stored object; absent fields stay absent."""
    return F.struct(*[F.col(v).alias(k) for k, v in _NAMES.items()])


def as_documents(pages: DataFrame) -> DataFrame:
    """Page rows as documents: job_id, pageCount and pages in order. A stored result is one
    document, so its pages come together in one row; columns that are missing are null."""
    have = set(pages.columns)
    full = pages.withColumns({v: F.lit(None) for v in _NAMES.values() if v not in have})
    return full.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("pageCount"), F.transform(F.array_sort(F.collect_list(F.struct("page", page_struct().alias("p")))), lambda x: x["p"]).alias("pages"))


def _stored(documents: DataFrame) -> DataFrame:
    """Documents with all columns of a stored result; those that are missing are null."""
    body = F.from_json(F.to_json(F.struct(*[c for c in documents.columns if c != "job_id"])), RESULT)
    return documents.select(F.col("job_id").cast("string").alias("job_id"), body.alias("_r"), F.monotonically_increasing_id().alias("_row")).select("job_id", "_r.*", "_row")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def _write(table: Versions, rows: DataFrame, buckets: int, dealt: bool = True) -> str:
    """Writes rows (job_id and more) by bucket; the folder. What was shuffled for it goes once it is written."""
    rows = rows.withColumn("bucket", _bucket(buckets))
    with settings(table.spark, FREED):
        # a bucket that is more than a task should write is dealt over several tasks and files
        return table.write(rows.hint("rebalance", "bucket") if dealt else rows, "bucket", compression="zstd")


def _parts(table: Versions, folder: str, at: int, fields: str = "") -> list[Part]:
    """The buckets of a written folder."""
    with settings(table.spark, FREED):
        live = table.spark.read.schema("bucket int").parquet(f"{table.path}/{folder}").distinct().collect()  # as many as there are buckets at most
    return [Part(f"{folder}/bucket={b}", at, b, fields) for b in sorted(r[0] for r in live)]


def _documents(table: Versions, parts: list[Part]) -> DataFrame:
    """The documents of some parts, with the patches beside them. A bucket's patches are younger than its documents."""
    layers = [p for p in parts if p.fields]
    docs = table.read([p for p in parts if not p.fields], STORED)
    if not layers:
        return docs
    names = [c for c in FIELDS if any(c in p.fields.split(",") for p in layers)]
    folders = {p.folder.split("/")[0]: p.at for p in layers}
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/bucket=[^/]+/[^/]+\z", 1)
    at = F.element_at(F.create_map(*(F.lit(x) for pair in folders.items() for x in pair)), folder)
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in names]
    # structs of nulls are equal too; as the key is unique, the join falls away where no patched field is read
    p = table.read(layers, PATCH).withColumn("_at", at).groupBy(F.struct("job_id").alias("_id")).agg(*newest)
    joined = docs.join(p.select("_id", F.struct(*names).alias("_p")), F.struct(docs["job_id"]) == F.col("_id"), "left")
    patched = {c: F.when(F.col(f"_p.{c}").isNotNull(), F.col(f"_p.{c}.v")).otherwise(F.col(c)).alias(c) for c in names}
    return joined.select("job_id", *(patched.get(c, c) for c in FIELDS))


def _saved(table: Versions, rows: DataFrame, buckets: int, dealt: bool) -> str:
    """Writes documents by bucket, the last of several rows (``_row``) of one; the folder."""
    folder = _write(table, rows, buckets, dealt)
    back = table.read([Part(folder, 0)], f"{STORED}, _row long")
    with settings(table.spark, FREED):
        once = back.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    if once:
        return folder
    last = back.groupBy("job_id").agg(F.max_by(F.struct(*FIELDS), "_row").alias("_r"), F.max("_row").alias("_row"))
    again = _write(table, last.select("job_id", "_r.*", "_row"), buckets)
    table.drop(folder)
    return again


def write_results(documents: DataFrame, path: str, buckets: int = 64, dealt: bool = True) -> None:
    """Saves documents (job_id and columns of a stored result): each takes the place of what
    was stored of it, all other documents stay. Of several rows of one document the last
    counts. ``buckets`` holds for a new table; a change writes the buckets anew that it falls in.
    Without ``dealt`` each task writes its own files of each bucket and no text moves: for
    documents that come in few large tasks."""
    table = Versions(documents.sparkSession, path)
    saved = {}  # the written folder by its number of buckets; a lost race does not write it again

    def changed(at: int, parts: list[Part], kept: dict):
        count = kept.get("buckets", buckets)
        if count not in saved:
            before = saved.popitem()[1] if saved else None
            saved[count] = _saved(table, table.read([Part(before, 0)], f"{STORED}, _row long") if before else _stored(documents), count, dealt)
            if before:
                table.drop(before)
        new = _parts(table, saved[count], at)
        if not new:
            return None
        touched = {p.bucket for p in new}
        old = [p for p in parts if p.bucket in touched]
        stay = []
        if old:
            ids = table.read(new, "job_id string").select(F.struct("job_id").alias("_id"))
            rest = _documents(table, old).join(ids, F.struct("job_id") == F.col("_id"), "left_anti")
            stay = _parts(table, _write(table, rest, count), at)
        return [*(p for p in parts if p.bucket not in touched), *stay, *new], {"buckets": count}

    table.change(changed)


def patch_results(patches: DataFrame, path: str) -> None:
    """Changes fields of stored documents. ``patches``: job_id, seq, fields (names that the
    patch sets) and columns of a stored result. Patches of one document are applied in the
    order of seq; a field that is not named keeps its value, a named one is set, to null too. A
    patch of a document that is not stored changes nothing. The patches lie beside the documents
    of their buckets, whose texts are not written again for them, until the bucket is written anew:
    when documents of it are saved, or when it has ``LAYERS`` of them."""
    spark = patches.sparkSession
    table = Versions(spark, path)
    columns = list(FIELDS)
    given = patches.select(
        F.col("job_id").cast("string").alias("job_id"), "seq", "fields",
        F.from_json(F.to_json(F.struct(*[c for c in patches.columns if c in columns])), RESULT).alias("_r"))
    # a struct is null where no patch names the field
    newest = [F.max_by(F.struct(F.col(f"_r.{c}").alias("v")), F.when(F.array_contains("fields", c), F.col("seq"))).alias(c) for c in columns]
    merged = given.groupBy("job_id").agg(*newest)
    saved = []  # the written folder; a lost race does not write it again

    def changed(at: int, parts: list[Part], kept: dict):
        if not parts:
            return None
        count = kept["buckets"]  # does not change while there are documents
        if not saved:
            saved.append(_write(table, merged, count))
        named = table.read([Part(saved[0], 0)], PATCH).agg(*(F.count(c).alias(c) for c in columns)).first()
        fields = ",".join(c for c in columns if named[c])
        stored = {p.bucket for p in parts}
        layer = [p for p in _parts(table, saved[0], at, fields) if fields and p.bucket in stored]
        if not layer:
            return None
        after = [*parts, *layer]
        full = {p.bucket for p in layer if sum(q.bucket == p.bucket and q.fields != "" for q in after) >= LAYERS}
        if full:
            folded = _write(table, _documents(table, [p for p in after if p.bucket in full]), count)
            after = [*(p for p in after if p.bucket not in full), *_parts(table, folded, at)]
        return after, {"buckets": count}

    table.change(changed)


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """OCR output ``<job_id>/…/results.json``: the first value of the object is the
    list of pages. One row per page; a file of another shape gives ``pages`` NULL."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "results.json").option("wholetext", "true").text(path)
    )
    job = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/results\.json\z", 1).alias("job_id")
    first = F.get(F.map_values(F.from_json("value", f"map<string,array<{OCR_PAGE}>>")), F.lit(0))
    return raw.select(job, first.alias("pages")).select("job_id", F.posexplode_outer("pages").alias("_p", "_page")).select(
        "job_id", (F.col("_p") + 1).alias("page"), F.col("_page.blocks").alias("blocks"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a folder: name and text."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown}").option("wholetext", "true").text(path)
    return raw.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("markdown"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Source files with their name, size and leading bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.regexp_extract("path", r"([^/]+)\z", 1).alias("filename"), F.col("length").alias("file_size"), F.substring("content", 1, 12).alias("head"))
