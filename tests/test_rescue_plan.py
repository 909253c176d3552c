"""The second round over failed pages makes the final pages once."""

from quire.operators import pages
from quire.plans import QUERIES


def test_rescue_round_reads_documents_less_often(spark, folder):
    plan = QUERIES["rescue_round"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 6  # final pages, failed pages with replies, drafts: 11 before


def test_rescue_takes_only_failed_pages(spark):
    schema = "job_id long, page int, markdown string, ai_failed boolean"
    finals = spark.createDataFrame([(1, 1, "kept", None), (1, 2, "old", True), (1, 3, "still", True), (None, 4, "no id", True)], schema)
    second = spark.createDataFrame([(1, 1, "a", None), (1, 1, "b", None), (1, 2, None, None), (1, 3, "c", True), (None, 4, "d", None)], schema)
    rows = pages.rescue(finals, second).collect()
    assert sorted((r["page"], r["markdown"]) for r in rows) == [(1, "kept"), (2, None), (3, "still"), (4, "no id")]
    assert rows[0].asDict().keys() == {"job_id", "page", "markdown"}
