"""Plans: page texts stay where they are read, in every query that does not return them."""

import re

import pytest

from quire.operators import search
from quire.plans import QUERIES
from quire.sources.views import lib_pages

TEXTLESS = [
    "search_counts", "search_hits", "word_snippets", "word_hits", "read_window", "document_summary", "failure_causes", "score_strip", "validate_pages",
    "outcome_counts",
]


def moved(df):
    """The columns that each exchange of a plan moves."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [set(re.findall(r"([\w@]+)#\d+", columns)) for columns in re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[([^\n]*)\]", plan)]


@pytest.mark.parametrize("name", TEXTLESS)
def test_no_exchange_moves_page_texts(spark, folder, name):
    exchanges = moved(QUERIES[name](spark, folder))
    assert exchanges
    texts = {"markdown", "r_markdown", "raw_markdown", "text"} - ({"text"} if name == "read_window" else set())
    assert not any(columns & texts for columns in exchanges), exchanges


def test_the_check_sees_texts_that_move(spark, folder):
    df = lib_pages(spark, folder).repartition(3, "job_id")
    assert any("markdown" in columns or "text" in columns for columns in moved(df))
    assert search.needle_of(" The ") == "the"
