"""Outages read off an attempts log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators.ordered import cut, running


def breaker_trips(attempts: DataFrame, threshold: int = fv.BREAKER_FAILURES, seconds: int = fv.BREAKER_SECONDS) -> DataFrame:
    """Instants at which a lane's failures in a row reach the threshold.

    ``attempts``: lane, ts, event_id, failed. The count starts again after a trip
    and after a success. Failures in a row are the running failure count less its
    value at the last success: two running values over one cut of the rows.
    """
    order = [F.col("ts").asc(), F.col("event_id").asc()]
    one = F.when(F.col("failed"), F.lit(1)).otherwise(F.lit(0)).cast("long")
    counted = running(cut(attempts, order, ["lane"]), one, order, ["lane"], "fails")
    at_success = F.when(~F.col("failed"), F.col("fails")).otherwise(F.lit(0).cast("long"))
    based = running(counted, at_success, order, ["lane"], "base", how="max")
    row = F.col("fails") - F.coalesce("base", F.lit(0))
    return based.filter(F.col("failed") & (row % threshold == 0)).select(
        "lane", "ts", "event_id", F.timestamp_add("SECOND", F.lit(seconds), F.col("ts")).alias("down_until")
    )
