"""Per-page checkpoint log: lines ``{"page", "result"}``, last write wins.

``append_log`` adds a part to a versioned table: the order of appends is that of their
commits, and there are as many files as tasks wrote, not as documents. Once there are ``compact_after`` parts
they become one, with the last line of each page only. ``read_log`` takes these and files
``<id>/pages.jsonl``, which are ordered by their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.versions import Part, Versions

#: ``_at`` is the instant of the commit in a compacted part, else null
ROWS = "job_id string, page int, line string, _at long, _row long"


def _seq(at: Column, file: Column, block: Column, row: Column) -> Column:
    return F.struct(at.alias("append"), file.alias("file"), block.alias("block"), row.alias("row")).alias("seq")


def _rows(table: Versions, parts: list[Part]) -> DataFrame:
    """Rows of parts, each with the instant of its commit."""
    out = table.read([], ROWS)
    whole = [p for p in parts if p.bucket == -1]
    for p in whole:  # as many as appends since the last compaction
        out = out.unionByName(table.read([p], ROWS).withColumn("_at", F.coalesce("_at", F.lit(p.at))))
    return out


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``append_log`` and of ``<path>/<job_id>/pages.jsonl`` with their position."""
    table = Versions(spark, path)
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "pages.jsonl").text(path)
    meta = F.col("_metadata")
    files = raw.select(
        F.regexp_extract(meta["file_path"], r"([^/]+)/[^/]+\z", 1).alias("job_id"),
        # rows of one file are read in order inside a split; splits are ordered by their start
        _seq(F.unix_micros(meta["file_modification_time"]), meta["file_name"], meta["file_block_start"], F.monotonically_increasing_id()),
        F.col("value").alias("line"),
    )
    own = _rows(table, table.latest()[1])
    return files.unionByName(own.select("job_id", _seq(F.col("_at"), F.lit(""), F.lit(0).cast("long"), F.col("_row")), "line"))


def latest_pages(log: DataFrame, result_schema: str) -> DataFrame:
    """The newest readable result of each page. ``log``: job_id, seq, line.
    Blank and half-written lines, and entries without a page or result, drop out."""
    parsed = F.from_json("line", f"page double, result struct<{result_schema}>")
    rows = log.filter(F.trim("line") != "").select("job_id", "seq", parsed.alias("_e"))
    whole = rows.filter(F.col("_e.page").isNotNull() & F.col("_e.result").isNotNull())
    return whole.groupBy("job_id", F.col("_e.page").cast("int").alias("page")).agg(F.max_by("_e.result", "seq").alias("result"))


def append_log(pages: DataFrame, path: str, compact_after: int = 32) -> None:
    """Adds ``page``/``result`` rows of any documents in one commit. Of a page that stands
    in ``pages`` several times the last row wins."""
    table = Versions(pages.sparkSession, path)
    lines = pages.select(
        F.col("job_id").cast("string").alias("job_id"), F.col("page").cast("int").alias("page"), F.to_json(F.struct("page", "result")).alias("line"),
        F.lit(None).cast("long").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    folder = table.write(lines)
    table.change(lambda at, parts, settings: ([*parts, Part(folder, at)], settings))
    if len(table.latest()[1]) > compact_after:
        compact_log(pages.sparkSession, path)


def compact_log(spark: SparkSession, path: str) -> None:
    """Makes one part of all: the last line of each page, with the instant of its commit.
    Parts that others add meanwhile stay beside it."""
    table = Versions(spark, path)
    old = table.latest()[1]
    place = F.struct("_at", "_row")
    last = _rows(table, old).groupBy("job_id", "page").agg(F.max_by(F.struct("line", "_at", "_row"), place).alias("_l"))
    folder = table.write(last.select("job_id", "page", "_l.*"))

    def merged(at: int, parts: list[Part], settings: dict):
        if not set(old) <= set(parts):
            return None  # another writer has compacted them
        return [Part(folder, max(p.at for p in old)), *(p for p in parts if p not in old)], settings

    if old:
        table.change(merged)


def clear_log(spark: SparkSession, path: str, jobs: DataFrame) -> None:
    """Drops the lines of finished documents (``job_id``)."""
    table = Versions(spark, path)
    done = jobs.select(F.col("job_id").cast("string").alias("job_id")).distinct()

    def without(at: int, parts: list[Part], settings: dict):
        rows = _rows(table, parts)
        left = rows.join(done, rows["job_id"].eqNullSafe(done["job_id"]), "left_anti")
        return [Part(table.write(left), max([p.at for p in parts], default=at))], settings

    table.change(without)
