"""A corpus pipeline: quality classifier, quality rules, near duplicates, benchmark
passages, token ids.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads
again for the next stage. All stages but the last return the columns of documents.

Defined cases, for every stage: null and empty texts score like a text nothing is known
of, and go there or with the rules (fewer than 50 words); repeated rows pass or go together; an
empty table stays empty; extra columns are passed on, also those that are named like an
operator's own outputs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import compression_score, decontamination, near_dedup, piece_bpe, quality_rules
from quire.llm.arrow_ops import col
from quire.session import written
from quire.sources.tables import table

VERDICT = "_stage_verdict"


def _decided(docs: DataFrame, judge, kept) -> DataFrame:
    """The rows of ``docs`` that ``kept`` holds for, with the columns of ``docs``. Columns
    named like an output of the operator are set aside while it runs."""
    aside = {c: f"_stage_{i}" for i, c in enumerate(docs.columns) if c.lower() not in ("doc_id", "text")}
    judged = judge(docs.withColumnsRenamed(aside)).filter(kept)
    return judged.select(*(col(aside.get(c, c)).alias(c) for c in docs.columns))


def classify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier does not reject (``predicted``: a score of 0.7 or more)."""
    model = compression_score.fit(docs, table(spark, folder, "labels"))
    return _decided(docs, lambda d: compression_score.score(d, model), F.col("predicted") == 1)


def rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return _decided(docs, quality_rules.apply_rules, F.col("kept"))


def distinct(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates (five-word
    shingles, similarity 0.8)."""
    return _decided(docs, lambda d: near_dedup.near_duplicates(d, shingle=5, percent=80), F.col("kept"))


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return _decided(docs, lambda d: decontamination.decontaminate(d, table(spark, folder, "benchmark")), ~F.col("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id with its token ids, their number, and the SHA-256 of the text they decode to."""
    encoded = piece_bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("near_duplicates", distinct),
    ("benchmark_decontamination", clean),
    ("piece_encoding", encode),
]

#: the classifier and the encoder have no form in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
