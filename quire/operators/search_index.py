"""A kept search index: which pages hold which three characters in a row.

``sync`` brings the index up to the finished documents: new ones and those whose stamp has
changed are read and added as a delta, all others are left as they are; documents that are gone or
have another stamp stay in the postings until ``compact``, but no longer count, as every search is
held against the list of documents and stamps of the last sync. A search takes the postings of the
needle's trigrams, keeps the pages that have them all, and counts in the text of these pages alone.

Layout (a versioned table): texts stand by bucket of the document, sorted by it. The pages of a stretch
of them are a block; one row lists them, and postings name a page by its place in that list: one row for
each gram of a block. Postings stand by bucket of the gram's first two characters, sorted by gram, so a search
reads the needle's buckets and, in these, the row groups of its grams; a needle of two characters is the front
of a trigram (texts are padded at their end). Frequent grams are dealt over several tasks and files of their
bucket, by block. Places are intersected inside a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import text
from quire.operators.search import needle_of
from quire.sources.versions import Part, Versions

#: ``stamp`` is the instant of the sync that read the document
POSTINGS = "gram string, at long, block long, places array<smallint>"
BLOCKS = "at long, block long, pages array<struct<job_id: string, page: int, stamp: long>>"
TEXTS = "job_id string, page int, stamp long, markdown string"
DOCUMENTS = "job_id string, updated_at string, stamp long"
#: buckets of postings; those of texts follow, and one of blocks
BUCKETS = 64
_LIST = -1
_BLOCKS = 2 * BUCKETS
#: a block ends at so many pages or bytes (one page at least); places are 16-bit numbers
BLOCK_PAGES, BLOCK_BYTES = 10_000, 4_000_000
#: so many documents go into the plan of a search by name, which prunes the scan of texts; more are joined
NAMED = 500


def _grams(texts: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """Stretches of texts (first, end) with their distinct trigrams, lower-cased in ASCII and padded at a text's end
    with two zeros, and the places, in the stretch, of the texts that have them: those of gram i are
    places[ends[i]:ends[i + 1]]. A stretch whose texts have too many different characters for one number is halved."""
    texts = pa.compute.fill_null(texts, "")
    sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first, waiting = 0, []
    while first < len(texts):
        most = (sizes[first - 1] if first else 0) + BLOCK_BYTES
        waiting.append((first, min(max(int(np.searchsorted(sizes, most, "right")), first + 1), first + BLOCK_PAGES)))
        first = waiting[-1][1]
    waiting.reverse()
    while waiting:
        first, end = waiting.pop()
        some, n = texts[first:end], end - first
        lengths = pa.compute.utf8_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = np.frombuffer("".join(some.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        chars += 32 * ((chars >= 65) & (chars <= 90))
        seen = np.zeros(0x110000, bool)
        seen[chars] = True
        seen[0] = True
        alphabet = np.flatnonzero(seen)
        size = len(alphabet)
        if size**3 * n >= 1 << 63:
            waiting += [(first + n // 2, end), (first, first + n // 2)]
            continue
        chars = (np.cumsum(seen) - 1)[chars]
        last = np.cumsum(lengths)[lengths > 0] - 1
        second = np.append(chars[1:], 0)[: len(chars)]
        second[last] = 0
        third = np.append(second[1:], 0)[: len(chars)]
        third[last] = 0
        key = np.sort(((chars * size + second) * size + third) * n + np.repeat(np.arange(n), lengths))
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
        code = key // n
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        own = code[starts]
        letters = np.stack([own // size**2, own // size % size, own % size], 1)
        named = alphabet[letters].astype(np.uint32).tobytes().decode("utf-32-le")
        yield first, end, [named[i : i + 3] for i in range(0, len(named), 3)], np.append(starts, len(key)), key - code * n


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages (markdown, job_id, page, stamp): a row of each block and one of each of its grams."""
    names = ["gram", "block", "places", "pages"]
    held = pa.list_(pa.struct([("job_id", pa.string()), ("page", pa.int32()), ("stamp", pa.int64())]))
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for first, end, grams, ends, places in _grams(batch.column(0)):
            listed = pa.StructArray.from_arrays([batch.column(i)[first:end] for i in (1, 2, 3)], fields=list(held.value_type))
            pages = pa.ListArray.from_arrays(pa.array([0, end - first], pa.int32()), listed)
            none = pa.nulls(1, pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number], pa.int64()), none, pages], names=names)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int16()))
            block = pa.array(np.full(len(grams), number))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), block, lists, pa.nulls(len(grams), held)], names=names)
            number += 1


def bucket(front: str) -> int:
    """Of the grams that start with these two characters."""
    return zlib.crc32(front.encode()) % BUCKETS


def _of(parts: list[Part], wanted) -> list[Part]:
    return [p for p in parts if wanted(p.bucket)]


def _texts(b: int) -> bool:
    return BUCKETS <= b < 2 * BUCKETS


def _write(table: Versions, rows: DataFrame, at: int, by: str, order: list[str]) -> list[Part]:
    """Parts by the column bucket; a bucket is dealt over some tasks by the column ``by``."""
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(by), F.lit(4))).sortWithinPartitions("bucket", *order)
    folder = table.write(dealt, "bucket")
    # as many as there are buckets
    live = table.spark.read.schema("bucket int").parquet(f"{table.path}/{folder}").distinct().collect()
    return [Part(f"{folder}/bucket={r[0]}", at, r[0]) for r in live]


def _post(table: Versions, texts: list[Part], at: int) -> list[Part]:
    """Blocks and postings of texts that are written (their stretches must be the same when a task is run again)."""
    read = table.read(texts, TEXTS).select("markdown", "job_id", "page", "stamp")
    rows = read.mapInArrow(_posted, f"gram string, block long, places array<smallint>, {BLOCKS.split(', ', 2)[2]}")
    front = F.pmod(F.crc32(F.substring("gram", 1, 2).cast("binary")), F.lit(BUCKETS)).cast("int")
    return _write(table, rows.select("*", F.lit(at).alias("at"), F.coalesce(front, F.lit(_BLOCKS)).alias("bucket")), at, "block", ["gram", "block"])


def sync(jobs: DataFrame, pages: DataFrame, path: str, compact_after: int = 16) -> None:
    """``jobs``: the finished documents (id, updated_at); ``pages``: job_id, page, markdown."""
    table = Versions(jobs.sparkSession, path)
    changed = F.coalesce(F.col("updated_at").cast("string"), F.lit(""))
    alive = jobs.groupBy(F.col("id").cast("string").alias("job_id")).agg(F.max(changed).alias("updated_at"))

    def step(at: int, parts: list[Part], settings: dict):
        known = table.read(_of(parts, lambda b: b == _LIST), DOCUMENTS)
        listed = Part(table.write(alive.join(known, ["job_id", "updated_at"], "left").withColumn("stamp", F.coalesce("stamp", F.lit(at)))), at, _LIST)
        now = table.read([listed], DOCUMENTS)
        stale = now.filter(F.col("stamp") == at).select("job_id", "stamp")
        fresh = pages.select(F.col("job_id").cast("string").alias("job_id"), F.col("page").cast("int").alias("page"), "markdown").join(stale, "job_id")
        texts = fresh.select(*(c.split()[0] for c in TEXTS.split(", ")), (F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)) + BUCKETS).cast("int").alias("bucket"))
        text_parts = _write(table, texts, at, "job_id", ["job_id", "page"])
        if not text_parts and known.count() == now.count():
            return None
        gram_parts = _post(table, text_parts, at)
        return [*_of(parts, lambda b: b != _LIST), *text_parts, *gram_parts, listed], settings

    table.change(step)
    if len({p.at for p in table.latest()[1]}) > compact_after:
        compact(jobs.sparkSession, path)


def compact(spark: SparkSession, path: str) -> None:
    """Makes one delta of all, without what no longer counts. Gives way to a sync that commits meanwhile."""
    table = Versions(spark, path)
    base, parts, settings = table.latest()
    alive = table.read(_of(parts, lambda b: b == _LIST), DOCUMENTS)
    at = max((p.at for p in parts), default=0)
    texts = table.read(_of(parts, _texts), TEXTS).join(alive, ["job_id", "stamp"], "left_semi")
    number = (F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)) + BUCKETS).cast("int")
    made = _write(table, texts.withColumn("bucket", number), at, "job_id", ["job_id", "page"])
    made += _post(table, made, at)
    table.commit(base, [*made, *_of(parts, lambda b: b == _LIST)], settings)


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """The pages (job_id, page, stamp) whose text has all trigrams of a needle."""
    table = Versions(spark, path)
    _, parts, _ = table.latest()
    wanted = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    fronts = {bucket(g[:2]) for g in wanted or [needle]}
    rows = table.read(_of(parts, lambda b: b in fronts), POSTINGS)
    blocks = table.read(_of(parts, lambda b: b == _BLOCKS), BLOCKS)
    alive = table.read(_of(parts, lambda b: b == _LIST), DOCUMENTS)
    # a row of each gram and block: at most BLOCK_PAGES places
    if wanted:
        of = lambda g: F.first(F.when(F.col("gram") == g, F.col("places")), ignorenulls=True)
        places = rows.filter(F.col("gram").isin(wanted)).groupBy("at", "block").agg(reduce(F.array_intersect, map(of, wanted)).alias("places"))
    else:
        each = rows.filter(F.col("gram").startswith(needle)).select("at", "block", F.explode("places").alias("place"))
        places = each.groupBy("at", "block").agg(F.collect_set("place").alias("places"))
    held = places.filter(F.size("places") > 0).join(blocks, ["at", "block"])
    whole = held.select(F.inline(F.transform("places", lambda p: F.get("pages", p.cast("int")))))
    return whole.join(alive, ["job_id", "stamp"], "left_semi").select("job_id", "page", "stamp").distinct()


def pages_with(spark: SparkSession, path: str, query: str) -> DataFrame:
    """job_id, page, markdown and _n (occurrences) of the pages that hold the query."""
    needle = needle_of(query)
    table = Versions(spark, path)
    texts = table.read(_of(table.latest()[1], _texts), TEXTS)
    if not needle:
        return texts.filter(F.lit(False)).select("job_id", "page", "markdown", F.lit(0).cast("long").alias("_n"))
    found = candidates(spark, path, needle)
    named = [r[0] for r in found.select("job_id").distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        texts = texts.filter(F.col("job_id").isin(named))
    counted = texts.withColumn("_n", F.regexp_count("markdown", F.lit(text.literal(needle, ignore_case=True))).cast("long")).filter(F.col("_n") > 0)
    # counted where they are read (an inner join stays above the count): only pages with hits move, without text where none is asked for
    return counted.join(found, ["job_id", "page", "stamp"]).select("job_id", "page", "markdown", "_n")


def hit_counts(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Occurrences per document; no ranking, no limit."""
    return pages_with(spark, path, query).groupBy("job_id").agg(F.sum("_n").alias("hits"))
