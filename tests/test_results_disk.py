"""What stored results leave on disk: documents are written once for each saving, patches lie beside them."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import page_state
from quire.session import settings
from quire.sources import results
from quire.sources.versions import Versions
from tests.test_plans import moved

SHAPE = "job_id string, title string, markdown string"


def saved(spark, path, rows, **kw):
    results.write_results(spark.createDataFrame(rows, SHAPE), path, **kw)


def patched(spark, path, rows):
    results.patch_results(spark.createDataFrame([(j, s, ["title"], t) for j, s, t in rows], "job_id string, seq int, fields array<string>, title string"), path)


def stored(spark, path):
    got = results.read_results(spark, path).collect()
    assert len(got) == len({r["job_id"] for r in got})
    return {r["job_id"]: (r["title"], r["markdown"]) for r in got}


def shuffled(spark):
    """Bytes of shuffle files that the session has on disk."""
    top = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    return sum(os.path.getsize(f"{d}/{f}") for t in top for d, _, names in os.walk(t) for f in names if f.startswith("shuffle_"))


def texts(n=400):
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sha2((F.col("id") * 1000 + i).cast("string"), 256)), " ")


def test_a_saving_leaves_only_what_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.range(60).select(F.col("id").cast("string").alias("job_id"), texts().alias("markdown"))
    results.write_results(docs, path, buckets=4)
    results.write_results(docs.filter("job_id % 4 > 0"), path)
    listed = {p["folder"].split("/")[0] for v in (tmp_path / "t" / "_log").glob("0*.json") for p in json.loads(v.read_text())["parts"]}
    assert {f.name for f in (tmp_path / "t").glob("data-*")} == listed  # nothing that was only staged
    assert results.read_results(spark, path).count() == 60


def test_a_patch_does_not_write_the_texts_again(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.range(60).select(F.col("id").cast("string").alias("job_id"), F.lit("old").alias("title"), texts().alias("markdown"))
    results.write_results(docs, path, buckets=4)
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    before, parts = size(), Versions(spark, path).latest()[1]
    patched(spark, path, [(str(i), 1, "new") for i in range(30)])
    assert size() < before * 1.2  # 2 times before
    assert set(parts) < set(Versions(spark, path).latest()[1])
    assert sorted(r["title"] for r in results.read_results(spark, path).collect()) == ["new"] * 30 + ["old"] * 30
    # who reads no patched field joins nothing
    assert "Join" not in results.read_results(spark, path).select("job_id", "markdown")._jdf.queryExecution().optimizedPlan().toString()


def test_patches_of_several_times_and_savings_between(spark, tmp_path):
    path = str(tmp_path / "t")
    saved(spark, path, [("a", "0", "m"), ("b", "0", "m"), (None, "0", "m")], buckets=1)
    patched(spark, path, [("a", 5, "1"), ("b", 1, "1"), (None, 1, None), ("later", 1, "no")])
    patched(spark, path, [("a", 1, "2")])  # younger than seq 5 of the patch before
    assert stored(spark, path) == {"a": ("2", "m"), "b": ("1", "m"), None: (None, "m")}
    saved(spark, path, [("a", "3", "n"), ("later", "3", "n")])  # what was patched before is replaced, the others keep their patches
    assert stored(spark, path) == {"a": ("3", "n"), "later": ("3", "n"), "b": ("1", "m"), None: (None, "m")}
    patched(spark, path, [("a", 1, None)])
    assert stored(spark, path)["a"] == (None, "n")


def test_many_patches_are_folded(spark, tmp_path):
    path = str(tmp_path / "t")
    saved(spark, path, [("a", "0", "m"), ("b", "0", "m")], buckets=1)
    most = 0
    for i in range(results.LAYERS + 1):
        patched(spark, path, [("a", 1, str(i))])
        most = max(most, sum(p.fields != "" for p in Versions(spark, path).latest()[1]))
        assert stored(spark, path) == {"a": (str(i), "m"), "b": ("0", "m")}
    assert most == results.LAYERS - 1 and len(Versions(spark, path).latest()[1]) == 2


def test_patches_of_nothing_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    patched(spark, path, [("a", 1, "x")])
    saved(spark, path, [("a", "0", "m")], buckets=2)
    version = Versions(spark, path).latest()
    results.patch_results(spark.createDataFrame([("a", 1, [], "x")], "job_id string, seq int, fields array<string>, title string"), path)
    assert Versions(spark, path).latest() == version and stored(spark, path) == {"a": ("0", "m")}


@pytest.mark.parametrize("dealt", [True, False])
def test_the_last_row_of_a_document_counts(spark, tmp_path, dealt):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(j, str(i), "m") for i in range(6) for j in ("a", "b", None)], SHAPE).coalesce(1)
    results.write_results(rows, path, buckets=2, dealt=dealt)
    assert stored(spark, path) == {j: ("5", "m") for j in ("a", "b", None)}
    assert len([*(tmp_path / "t").glob("data-*")]) == 1


def test_another_first_writer_with_other_buckets(spark, tmp_path, monkeypatch):
    path, commit, between = str(tmp_path / "t"), Versions.commit, []

    def late(self, base, parts, settings):
        if not between:
            between.append(1)
            saved(spark, path, [("y", "other", "m"), ("z", "other", "m")], buckets=3)
        return commit(self, base, parts, settings)

    monkeypatch.setattr(Versions, "commit", late)
    saved(spark, path, [("x", "mine", "m"), ("y", "mine", "m"), ("y", "mine again", "m")], buckets=1)
    assert {j: t for j, (t, _) in stored(spark, path).items()} == {"x": "mine", "y": "mine again", "z": "other"}
    assert Versions(spark, path).latest()[2] == {"buckets": 3}


def test_what_a_saving_shuffled_is_gone(spark, tmp_path):
    docs = spark.range(200).select((F.col("id") % 50).alias("job_id"), texts(100).alias("markdown")).groupBy("job_id").agg(F.max("markdown").alias("markdown"))
    before = shuffled(spark)
    results.write_results(docs, str(tmp_path / "t"), buckets=4)
    until = time.time() + 5  # executors are told to delete them, none is waited for
    while shuffled(spark) > before + 10_000 and time.time() < until:
        time.sleep(0.2)
    assert shuffled(spark) <= before + 10_000  # 1.2 MB before, until some collection of garbage
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_final_pages_lie_by_document(spark):
    """Texts move with their drafts and with their replies, and not again for the documents."""
    pages = spark.createDataFrame([(1, 1, "a text"), (1, 2, ""), (2, 1, "b"), (None, 1, "c")], "job_id long, page int, markdown string")
    replies = spark.createDataFrame(
        [(1, 1, True, "a text", False, None, None, None, "m", "p", 1, 1, None), (2, 1, True, None, False, None, None, "fetch failed", "m", "p", 1, 1, None)],
        "job_id long, page int, r_sent boolean, r_markdown string, r_no_text boolean, r_note string, r_uncertain array<string>, r_error string, r_model string, r_provider string, r_input_tokens long, r_output_tokens long, r_cost_usd double")
    drafts = page_state.draft_from_text(pages)
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    with settings(spark, small):
        plain = page_state.answered(drafts, replies)
        assert len(moved(results.as_documents(plain))) == 3
    with settings(spark, small | {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        by = page_state.answered(drafts, replies, by=["job_id"])
        assert len(moved(results.as_documents(by))) == 2
        assert sorted(map(str, by.collect())) == sorted(map(str, plain.collect()))
