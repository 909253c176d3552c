"""Exact state machines over long ordered runs, in parallel.

A state machine walks its key's rows in order. The rows are cut into ranges of (key,
order), so most keys lie whole in one range: these are dealt out by key, sorted, and
walked once, many keys to a task, batch by batch. A key with a third of all rows would be
one long task; such a key is torn by the cut, and so is one at the edge of a range. Of the
torn keys, two a range at most, every range is walked at once from an assumed start. Where the end of the range before differs
from what was assumed, the range is walked again from the true start, until
nothing changes. Machines that forget their past (limits that hit a floor or a
ceiling, counters that reset) settle after a pass or two; the result is that of
the plain walk in any case, as the first unsettled range of a key is final after
each pass. What is gathered per step is one range of one torn key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.operators.ordered import RANGE, cut
from quire.session import written

Walk = Callable[[tuple, pd.DataFrame], tuple[tuple, pd.DataFrame]]


def walk_in_order(
    df: DataFrame, key: str, order: Sequence[str], start: dict[str, int], walk: Walk, output: str, ranges: int | None = None
) -> DataFrame:
    """Rows put out by ``walk(state, rows) -> (state, output rows)``, called per key
    with its rows in ``order``. ``start`` names the state's (whole-number) fields
    and their first values; ``output`` is the schema of the rows after the key."""
    kind = dict(df.dtypes)[key]
    rows = cut(df.filter(F.col(key).isNotNull()), [F.col(c) for c in order], [key], ranges)
    # a key in several ranges is the first or the last one of each of them
    edges = rows.groupBy(RANGE).agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("_keys")).select(F.explode("_keys").alias(key))
    torn = written(edges.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select(key), "torn")
    whole = rows.join(F.broadcast(torn), key, "left_anti").repartition(key).sortWithinPartitions(key, *(F.col(c).asc_nulls_last() for c in order))

    def walk_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = state = None
        for pdf in batches:
            keys, found = pdf[key].to_numpy(), []
            places = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(places, places[1:]):
                if b > a:
                    if held is None or keys[a] != held:  # else the batch before ended inside this key
                        held, state = keys[a], tuple(start.values())
                    state, out = walk(state, pdf.iloc[a:b])
                    if len(out):
                        out.insert(0, key, held)
                        found.append(out)
            if found:
                yield pd.concat(found)

    done = whole.mapInPandas(walk_keys, f"{key} {kind}, {output}")
    if torn.isEmpty():
        return done
    pieces = written(rows.join(F.broadcast(torn), key, "left_semi"), "pieces")
    return done.unionByName(_walk_pieces(pieces, key, order, start, walk, output))


def _walk_pieces(rows: DataFrame, key: str, order: Sequence[str], start: dict[str, int], walk: Walk, output: str) -> DataFrame:
    """``walk_in_order`` for keys in several ranges."""
    fields, kind = list(start), dict(rows.dtypes)[key]
    state_schema = f"{key} {kind}, {RANGE} int, " + ", ".join(f"{f} long" for f in fields)

    def parts(starts: DataFrame):
        return rows.join(starts, [key, RANGE]).groupBy(key, RANGE)

    def run(pdf: pd.DataFrame):
        state = tuple(int(pdf[f].iloc[0]) for f in fields)
        return walk(state, pdf.sort_values(list(order)))

    def end(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*group, *run(pdf)[0])], columns=[key, RANGE, *fields])

    def emit(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)[1]
        out.insert(0, key, group[0])
        return out

    same = [key, RANGE]
    before = Window.partitionBy(key).orderBy(RANGE)  # one row per range of a key
    starts = written(rows.select(*same).distinct().withColumns({f: F.lit(v).cast("long") for f, v in start.items()}), "starts")
    changed, ends = starts, None
    while True:
        fresh = parts(changed).applyInPandas(end, state_schema)
        ends = written(fresh if ends is None else ends.join(changed, same, "left_anti").unionByName(fresh), "ends")
        follow = {f: F.coalesce(F.lag(f).over(before), F.lit(v).cast("long")).alias(f) for f, v in start.items()}
        true = written(ends.select(*same, *follow.values()), "starts")
        changed = true.join(starts, [*same, *fields], "left_anti")
        starts = true
        if changed.isEmpty():
            return parts(starts).applyInPandas(emit, f"{key} {kind}, {output}")


def lane_walk(state: tuple, rows: pd.DataFrame, top: int, low: int) -> tuple[tuple, pd.DataFrame]:
    """Limits from the runs of successes between failures. A run of n adds n / LANE_WINS whole
    steps, as far as ``top``; a failure ends the run and takes a share of the limit unless one
    did so within the cool-down. So only failures are gone through one by one, and the rows at which a
    run adds a step follow from their number in it."""
    limit, carried, last_cut = state
    good, at, event = rows["good"].to_numpy(bool), rows["at_ms"].to_numpy(np.int64), rows["event_id"].to_numpy()
    failures = np.flatnonzero(~good)
    lengths = np.diff(np.concatenate([[-1], failures, [len(good)]])) - 1
    lengths[0] += carried
    base, after = np.empty(len(lengths), np.int64), np.full(len(good), -1, np.int64)
    for run, n in enumerate(lengths.tolist()):
        base[run] = limit
        limit = min(top, limit + n // fv.LANE_WINS)
        if run < len(failures):
            here = failures[run]
            if at[here] - last_cut >= fv.LANE_COOLDOWN_MS:
                reduced, last_cut = max(low, int(limit * fv.LANE_CUT)), int(at[here])
                if reduced != limit:
                    after[here] = limit = reduced
    run = np.cumsum(~good)
    first = np.concatenate([[-carried], failures + 1])[run]  # where the run would begin without what was carried
    place = np.arange(len(good)) - first + 1
    reached = base[run] + place // fv.LANE_WINS
    steps = good & (place % fv.LANE_WINS == 0) & (reached <= top)
    after[steps] = reached[steps]
    told = np.flatnonzero(after >= 0)
    # a run that is not over: at the top nothing more is asked for
    left = int(lengths[-1] % fv.LANE_WINS) if limit < top else 0
    return (int(limit), left, last_cut), pd.DataFrame({"event_id": event[told], "at_ms": at[told], "lane_limit": after[told].astype(np.int32)})


def progress_walk(state: tuple, rows: pd.DataFrame, gap_ms: int = fv.PROGRESS_GAP_MS) -> tuple[tuple, pd.DataFrame]:
    """From one written report to the next: the first that is an end by itself, or whose page does not
    follow on that written, and else the first after the gap, which is looked up."""
    at, page, total = (rows[c].to_numpy(np.int64) for c in ("at_ms", "page", "total"))
    ends = (page == 0) | (page >= total)
    (written_at, page_at), kept, start = state, [], 0
    while start < len(at):
        late = max(start, int(np.searchsorted(at, written_at + gap_ms)))
        moved = page[start:late] - page_at
        found = np.flatnonzero(ends[start:late] | (moved < 0) | (moved > 1))
        here = start + int(found[0]) if len(found) else late
        if here == len(at):
            break
        kept.append(here)
        written_at, page_at, start = int(at[here]), int(page[here]), here + 1
    return (written_at, page_at), pd.DataFrame({"at_ms": at[kept], "page": page[kept], "total": total[kept]})


def prepared(attempts: DataFrame, slow_ms: int) -> DataFrame:
    """A success slower than ``slow_ms`` counts as congestion."""
    good: Column = F.col("ok") & (F.col("latency_ms") <= slow_ms)
    return attempts.select("lane", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_id", good.alias("good"))


def lane_limits(attempts: DataFrame, top: int, slow_ms: int = fv.LANE_SLOW_MS, floor: int = fv.LANE_FLOOR, ranges: int | None = None) -> DataFrame:
    """Parallel-request limit of each lane, a row whenever it changes.
    ``attempts``: lane, ts, event_id, ok, latency_ms."""
    low = max(1, min(floor, top))
    walk = lambda state, rows: lane_walk(state, rows, top, low)
    start = {"lane_top": top, "wins": 0, "last_cut": 0}
    return walk_in_order(prepared(attempts, slow_ms), "lane", ["at_ms", "event_id"], start, walk, "event_id long, at_ms long, lane_limit int", ranges)


def progress_writes(progress: DataFrame, ranges: int | None = None) -> DataFrame:
    """Progress reports worth writing: edges, jumps and steps back at once, plain
    steps at most every so often. ``progress``: job_id, at_ms, page, total."""
    return walk_in_order(progress, "job_id", ["at_ms", "page"], {"written_at": 0, "page_at": -1}, progress_walk, "at_ms long, page long, total long", ranges)
