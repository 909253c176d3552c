"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash.
Pass two takes one bucket at a time, shuffles it with Fisher-Yates and writes it.
The buckets one after the other are the shuffled order; shards are cut from it as
equal runs, so their row counts differ by one at most (the law ``rows``).

The hash covers the record's position in its input split besides its key, so
repeated rows are scattered like any others and no bucket grows with a hot key.
Before Fisher-Yates a bucket is put in a fixed order (that position), so a task
that runs again makes the same bucket. Bucket counts are taken from the
written table, so positions and rows always agree.

Defined cases: a null text has no bytes; null keys and repeated rows are placed
like others; a single record larger than a bucket makes a larger bucket; an empty
table gives no rows and empty shards are not written. Other columns are kept; an
input column named like an output column is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.arrow_ops import col, keeping
from quire.session import written

#: so many buckets' starting places (24 bytes each) are sent to every executor at most
SENT_BUCKETS = 500_000
#: tasks of pass two at most; beyond it each takes several buckets, one after the other
MOST_TASKS = 200_000
OUT = ("size", "bucket", "place", "shard", "slot")


def record_size(text: str) -> F.Column:
    """UTF-8 bytes of the text plus 8 for the key."""
    return F.coalesce(F.octet_length(col(text).cast("string")), F.lit(0)).cast("long") + 8


def bucket_count(df: DataFrame, text: str, shards: int, bucket_bytes: int) -> int:
    total = df.agg(F.sum(record_size(text))).first()[0] or 0
    return max(shards, math.ceil(total / bucket_bytes))


def shuffle_shards(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, seed: int = 17, bucket_bytes: int = 32 << 20
) -> DataFrame:
    """``df`` in shuffled order with size, bucket, place (in its bucket), shard and slot
    (in its shard), read from the bucket files that pass two wrote."""
    kept = keeping(df, OUT)
    buckets = bucket_count(df, text, shards, bucket_bytes)
    where = F.monotonically_increasing_id()
    scattered = df.select(
        F.pmod(F.xxhash64(F.lit(seed), col(key), where), F.lit(buckets)).cast("int").alias("bucket"),
        where.alias("_where"), record_size(text).alias("size"), *(col(c) for c in kept),
    )
    schema = T.StructType([f for f in scattered.schema.fields if f.name != "_where"]).add("place", T.LongType())

    def fisher_yates(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_where", "ascending")])
        bucket = group.column("bucket")[0].as_py()
        order = np.arange(group.num_rows)
        np.random.default_rng([seed, bucket]).shuffle(order)  # numpy's shuffle is Fisher-Yates
        mixed = group.take(pa.array(order)).drop_columns(["_where"])
        return mixed.append_column("place", pa.array(np.arange(group.num_rows)))

    # more tasks than buckets, so that few hash to one task, whatever the session's number of shuffle partitions
    dealt = scattered.repartition(min(4 * buckets, MOST_TASKS), "bucket")
    filed = written(dealt.groupBy("bucket").applyInArrow(fisher_yates, schema), "shard-buckets")
    counts = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row per bucket, so this single-task window is over bytes / bucket_bytes rows
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = counts.select(
        "bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_total")
    )
    rank, least, extra = F.col("_rank"), F.floor(F.col("_total") / shards), F.col("_total") % shards
    # the first `extra` shards take one row more than the others
    wide = extra * (least + 1)
    shard = F.when(rank < wide, F.floor(rank / (least + 1))).otherwise(extra + F.floor((rank - wide) / F.greatest(least, F.lit(1))))
    first = F.when(F.col("shard") < extra, F.col("shard") * (least + 1)).otherwise(wide + (F.col("shard") - extra) * least)
    if buckets <= SENT_BUCKETS:  # else the planner chooses
        starts = F.broadcast(starts)
    return (
        filed.join(starts, "bucket").withColumn("_rank", F.col("_start") + F.col("place"))
        .withColumn("shard", shard.cast("int")).withColumn("slot", (rank - first).cast("long"))
        .select(*(col(c) for c in kept), *OUT)
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard. A bucket touches few shards, so there are about as many
    files as buckets and shards together."""
    placed.write.partitionBy("shard").parquet(path)
