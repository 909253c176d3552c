"""Usage logs as a stream: parse, price, drop repeats, append."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions.prices import family_cost
from quire.session import shared_dir
from quire.sources.versions import Part, Versions
from quire.streaming.growing import GrowingLines

LOG_SCHEMA = (
    "timestamp string, requestId string, message struct<id:string,model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,"
    "cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,"
    "cache_creation:struct<ephemeral_1h_input_tokens:bigint,ephemeral_5m_input_tokens:bigint>>>"
)

USAGE = "key string, ts timestamp, model string, usd double"


def read_usage_logs(
    spark: SparkSession, path: str, suffix: str = ".jsonl", exclude_dirs: Sequence[str] = (), max_age_days: float | None = None, split_bytes: int = 64 << 20
) -> DataFrame:
    """Lines of the logs below a folder as a stream: path, position, value. What a file gains later
    is read later. ``max_age_days`` passes over files that nobody writes to any more."""
    spark.dataSource.register(GrowingLines)
    options = {"suffix": suffix, "exclude": "\n".join(exclude_dirs), "maxAgeDays": "" if max_age_days is None else str(max_age_days), "splitBytes": str(split_bytes)}
    return spark.readStream.format("growing_lines").options(**options).load(path)


def parse_usage(lines: DataFrame) -> DataFrame:
    """Usage rows of log lines (``value``), with their path and position where these are known. Cheap
    text tests come before parsing; lines that are cut off, synthetic, undated or with a
    date that is none drop out."""
    rows = lines.filter(F.contains("value", F.lit('"usage"')))
    place = [c for c in ("path", "position") if c in lines.columns]
    m = rows.select(*place, F.from_json("value", LOG_SCHEMA).alias("o")).select(*place, "o.timestamp", "o.requestId", "o.message.*")
    kept = m.filter(
        F.col("usage").isNotNull() & ~F.col("model").eqNullSafe(F.lit(fv.SYNTHETIC_MODEL)) & (F.coalesce("timestamp", F.lit("")) != ""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    made = F.col("usage.cache_creation").isNotNull()
    w5 = F.when(made, zero("usage.cache_creation.ephemeral_5m_input_tokens")).otherwise(zero("usage.cache_creation_input_tokens"))
    usd = family_cost(
        F.coalesce("model", F.lit("")), zero("usage.input_tokens"), zero("usage.output_tokens"),
        zero("usage.cache_read_input_tokens"), zero("usage.cache_creation.ephemeral_1h_input_tokens"), w5)
    return kept.select(
        F.concat_ws("|", F.coalesce("id", F.lit("undefined")), F.coalesce("requestId", F.lit("undefined"))).alias("key"),
        F.try_to_timestamp(F.col("timestamp")).alias("ts"), F.coalesce("model", F.lit("")).alias("model"), usd.alias("usd"), *place,
    ).filter(F.col("ts").isNotNull())


def keep_first(rows: DataFrame, path: str, checkpoint: str, keep_days: float | None = None, compact_after: int = 32) -> None:
    """Runs a stream of usage rows over all that is available into the versioned table at
    ``path``: of each key the first row ever, by trigger, then by file and position. A trigger that
    runs again after a failure adds nothing. ``keep_days`` drops older rows when parts are merged."""

    def add(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, path)
        if table.latest()[2].get("trigger", -1) >= number:
            return
        first = batch.groupBy("key").agg(F.min_by(F.struct("ts", "model", "usd"), F.struct("path", "position")).alias("_f")).select("key", "_f.*")
        # only the keys of the table are read
        fresh = first.join(table.read(table.latest()[1], USAGE).select("key"), "key", "left_anti")
        folder = table.write(fresh)
        table.change(lambda at, parts, settings: ([*parts, Part(folder, at)], {**settings, "trigger": number}))
        if len(table.latest()[1]) > compact_after:
            merge_usage(batch.sparkSession, path, keep_days)

    query = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_usage(spark: SparkSession, path: str, keep_days: float | None = None) -> None:
    """Makes one part of all, without rows older than ``keep_days``."""
    table = Versions(spark, path)
    old = table.latest()[1]
    rows = table.read(old, USAGE)
    if keep_days is not None:
        rows = rows.filter(F.col("ts") >= F.current_timestamp() - F.make_dt_interval(secs=F.lit(keep_days * 86400.0)))
    folder = table.write(rows)
    table.change(lambda at, parts, settings: ([Part(folder, max([p.at for p in old], default=at)), *(p for p in parts if p not in old)], settings))


def usage_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``keep_first``."""
    table = Versions(spark, path)
    return table.read(table.latest()[1], USAGE)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is available and reads back what it wrote.
    Checkpoint and table lie in the shared folder, so lost executors are no loss."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/table")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")
