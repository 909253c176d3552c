"""Whole keys share a task; torn ones are walked range by range."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import chains

PROGRESS = "job_id long, at_ms long, page long, total long"


def progress_rows(seed, sizes):
    rng, rows = random.Random(seed), []
    for job, n in enumerate(sizes):
        at = page = 0
        for _ in range(n):
            at += rng.choice([10, 120, 500])
            page = rng.choice([page, page + 1, page + 1, page + 4, max(0, page - 2)])
            rows.append((job, at, page, 10**6))
    return rows


def progress_loop(rows):
    want, last = [], {}
    for job, at, page, total in rows:
        w, p = last.get(job, (0, -1))
        if page == 0 or page >= total or page < p or page > p + 1 or at >= w + 300:
            want.append((job, at, page))
            last[job] = (at, page)
    return sorted(want)


@pytest.mark.parametrize("ranges", [1, 5])
def test_many_small_jobs_and_a_long_one(spark, ranges):
    rows = progress_rows(ranges, [*[7] * 60, 900, *[1] * 40])
    df = spark.createDataFrame(rows, PROGRESS).repartition(3)
    got = chains.progress_writes(df, ranges=ranges)
    assert sorted((r["job_id"], r["at_ms"], r["page"]) for r in got.collect()) == progress_loop(rows)


def test_a_key_goes_on_in_the_next_batch(spark):
    rows = progress_rows(9, [40, 3, 25])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = chains.progress_writes(spark.createDataFrame(rows, PROGRESS), ranges=1)
        assert sorted((r["job_id"], r["at_ms"], r["page"]) for r in got.collect()) == progress_loop(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_keys_are_walked_without_a_python_group_each(spark):
    df = spark.range(3000).select(
        (F.col("id") % 500).alias("job_id"), F.col("id").alias("at_ms"), F.col("id").alias("page"), F.lit(10**6).cast("long").alias("total"))
    plan = chains.progress_writes(df, ranges=1)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_a_key_is_null(spark):
    def walk(state, pdf):
        return (state[0] + len(pdf),), pd.DataFrame({"n": np.arange(len(pdf)) + state[0]})

    df = spark.createDataFrame([(None, 1), ("a", 1), ("a", 2)], "k string, i long")
    out = chains.walk_in_order(df, "k", ["i"], {"n": 0}, walk, "n long")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0), ("a", 1)]
