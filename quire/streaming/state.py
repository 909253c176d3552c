"""The state machines of ``operators.chains`` kept up to date on streams.

State per key is a few numbers. Rows of one trigger are put in order per key
inside the task, so bound a trigger (``maxFilesPerTrigger``, ``maxBytesPerTrigger``)
by what a task should hold; whole tables belong to the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire import fixed_values as fv
from quire.operators.chains import lane_walk, prepared, progress_walk


def _keyed(stream: DataFrame, key: str, order: list[str], start: dict[str, int], walk, output: str) -> DataFrame:
    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        after, out = walk(state.get if state.exists else tuple(start.values()), rows)
        state.update(tuple(int(x) for x in after))
        out.insert(0, key, group[0])
        yield out

    kind = dict(stream.dtypes)[key]
    fields = ", ".join(f"{f} long" for f in start)
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {output}", fields, "append", GroupStateTimeout.NoTimeout)


def lane_limits(attempts: DataFrame, top: int, slow_ms: int = fv.LANE_SLOW_MS, floor: int = fv.LANE_FLOOR) -> DataFrame:
    low = max(1, min(floor, top))
    walk = lambda state, rows: lane_walk(state, rows, top, low)
    start = {"lane_top": top, "wins": 0, "last_cut": 0}
    return _keyed(prepared(attempts, slow_ms), "lane", ["at_ms", "event_id"], start, walk, "event_id long, at_ms long, lane_limit int")


def progress_writes(progress: DataFrame) -> DataFrame:
    return _keyed(progress, "job_id", ["at_ms", "page"], {"written_at": 0, "page_at": -1}, progress_walk, "at_ms long, page long, total long")


def most_free(lanes: DataFrame) -> DataFrame:
    """The lane with the most free slots (name breaks ties). ``lanes``: lane, lane_limit, in_flight."""
    free = F.col("lane_limit") - F.col("in_flight")
    return lanes.filter(free > 0).select("lane", free.alias("free")).orderBy(F.col("free").desc(), "lane").limit(1)
