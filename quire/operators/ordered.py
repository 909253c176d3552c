"""Running values over a total order without a single-task window.

A window over all rows, or over one hot key, sorts them in one task. Here rows
are first cut into ranges of (keys, order) by sampled bounds, so the ranges are
of like size however skewed keys or times are: one key, one day or one instant
with a third of all rows is cut like any other stretch. A window then runs inside
each range, and the totals of the ranges before it, one row per key and range,
are added by an equi-join. The results are those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

RANGE = "_range"


def cut(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Rows with the number of their range, as a written table: the range of a row
    must be the same for every later use, also after a lost executor."""
    columns = [*keys, *order]
    # without a number the adaptive planner joins small neighbouring ranges, which keeps their order
    ranged = df.repartitionByRange(ranges, *columns) if ranges else df.repartitionByRange(*columns)
    return written(ranged.withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(rows: DataFrame, value: Column, order: Sequence[Column], keys: Sequence[str] = (), out: str = "running", how: str = "sum") -> DataFrame:
    """``value`` totalled (``how``: sum or max) up to and including each row of a
    ``cut`` table. ``order`` must be total within ``keys``; keys must not be NULL."""
    fold = F.sum if how == "sum" else F.max
    valued = rows.withColumn("_value", value)
    totals = valued.groupBy(*keys, RANGE).agg(fold("_value").alias("_total"))
    # at most one row per key and range; without keys, one row per range
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    prior = totals.select(*keys, RANGE, fold("_total").over(before).alias("_prior"))
    within = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = fold("_value").over(within)
    joined = valued.join(prior, [*keys, RANGE])
    total = F.coalesce(F.col("_prior"), F.lit(0)) + local if how == "sum" else F.greatest(F.col("_prior"), local)
    return joined.withColumn(out, total).drop("_value", "_prior")


def running_total(df: DataFrame, value: Column, order: Sequence[Column], keys: Sequence[str] = (), out: str = "running", how: str = "sum") -> DataFrame:
    return running(cut(df, order, keys), value, order, keys, out, how).drop(RANGE)


def row_numbers(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), out: str = "n") -> DataFrame:
    return running_total(df, F.lit(1).cast("long"), order, keys, out)
