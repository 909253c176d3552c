"""The library object and the commands."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.api import Library
from quire.operators import library
from quire.sources import views

T0 = datetime(2024, 1, 10, 9)


@pytest.fixture(scope="module")
def lib(spark):
    jobs = spark.createDataFrame(
        [(f"abcd{i}", "doc.pdf", "ai", "done" if i < 3 else "failed", T0 - timedelta(days=20 * i), T0, 2, 40, 0, 0, "B" if i else None, "L", 8000, '["t"]', None, "one")
         for i in range(4)],
        "id string, filename string, mode string, status string, created_at timestamp_ntz, updated_at timestamp_ntz, page_count long, char_count long, review_count long,"
        "fallback_count long, batch_id string, batch_label string, duration_ms long, tags string, ai_title string, ai_one_line string").withColumn("finished_at", F.col("updated_at"))
    pages = spark.createDataFrame([(f"abcd{i}", p, f"# Heading {p}\nlatent heat {i}") for i in range(4) for p in (1, 2)], "job_id string, page int, markdown string")
    calls = spark.createDataFrame([(T0, "p", "m", "refine", "abcd0", 5, 6, 0.25)], "ts timestamp_ntz, provider string, model string, purpose string, ref string, input_tokens long, output_tokens long, cost_usd double")
    return Library(jobs, pages, calls)


def test_reads(lib):
    assert [r["id"] for r in lib.listing(since="2023-12-01").collect()] == ["abcd0", "abcd1", "abcd2"]
    assert lib.list_jobs().count() == 4 and lib.batches().first()["total"] == 3 and lib.batch("B").count() == 3
    job, rows = lib.document("abcd1")
    assert job.count() == 1 and [r["page"] for r in rows.collect()] == [1, 2]
    ranked, hits = lib.search("heat")
    assert ranked.count() == 3 and hits.count() == 6
    assert lib.word_search(["latent", "one"], since="2024-01-01").first()["score"] == 2 + 2 * 0 + 50
    assert lib.outline("abcd0").first()["heading"] == "Heading 1"
    assert lib.read("abcd0", at="heat").first()["page"] == 1
    assert lib.delete(lib.jobs.filter("id = 'abcd3'")).count() == 3


def test_statistics(lib):
    assert {k: v.count() for k, v in lib.stats().items()} == {"totals": 1, "timeline": 3, "top_tags": 1, "by_mode": 1}
    assert lib.usage(T0)["totals"].first()["month_cost_usd"] == 0.25
    parts = lib.reflect("1m", T0)
    assert parts["totals"].first()["docs"] == 2 and parts["series"].count() == 32 and parts["hours"].count() == 24
    assert [r["slot"] for r in parts["weekdays"].filter("peak").collect()] == [2]
    assert lib.months().count() == 2 and lib.quality().first()["fallback"] == 0 and lib.speed().first()["sec_per_page"] == 4.0


def test_export(lib, tmp_path):
    import zipfile

    lib.export_zip(str(tmp_path / "z"), lib.pages.filter("page = 1").select("job_id", "markdown"), archives=1)
    names = sorted(n for f in (tmp_path / "z").glob("*.zip") for n in zipfile.ZipFile(f).namelist())
    assert names == ["doc (2).md", "doc (3).md", "doc.md"]


@pytest.mark.parametrize("argv, rows", [
    (["search", "latent", "--any"], 3), (["hits", "abcd0", "heat"], 2), (["read", "abcd0", "--page", "2"], 1), (["info", "abcd0"], 2), (["list", "--n", "1"], 1), (["stats"], 2)])
def test_commands(lib, argv, rows):
    args = cli.parser().parse_args(["--jobs", "j", "--pages", "p", *argv])
    assert cli.answer(lib, args).count() == rows


def test_ambiguous_id_gives_nothing(lib):
    assert cli.answer(lib, cli.parser().parse_args(["--jobs", "j", "--pages", "p", "info", "abcd"])) is None


def test_recovery(spark):
    jobs = spark.createDataFrame([("a", "running"), ("b", "queued"), ("c", "done")], "id string, status string")
    got = {r["id"]: r["status"] for r in library.recovered(jobs, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"a": "queued", "b": "failed"}


def test_sql_over_views(spark, folder):
    views.register(spark, folder)
    assert spark.sql("select count(*) from lib_jobs where status = 'done'").first()[0] > 0
