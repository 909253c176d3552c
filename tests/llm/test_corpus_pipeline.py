"""The pipeline against plain Python, stage by stage, and on odd tables."""

import collections
import math
import random

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from quire.llm import compression_score, quality_rules
from test_operators_llm import brute_components, brute_hits

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_decides_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    first = corpus_pipeline.classify(spark, docs, folder)
    assert first.columns == DOCUMENTS
    sizes = compression_score.Sizes(model := compression_score.fit(docs, labels))
    want = {i for i, t in texts.items() if model.slope * sizes.difference(t) + model.shift >= math.log(0.7 / 0.3)}
    assert {r["doc_id"] for r in first.collect()} == want

    second = corpus_pipeline.rules(spark, docs, folder)
    assert second.columns == DOCUMENTS
    want = {i for i, t in texts.items() if not any(r.rejects(quality_rules.Text(t)) for r in quality_rules.RULES)}
    assert {r["doc_id"] for r in second.collect()} == want

    third = corpus_pipeline.distinct(spark, docs, folder)
    assert third.columns == DOCUMENTS
    assert {r["doc_id"] for r in third.collect()} == {i for i, (_, c) in brute_components(texts.items(), 5, 80).items() if i == c}

    fourth = corpus_pipeline.clean(spark, docs, folder)
    assert fourth.columns == DOCUMENTS
    from quire.llm.decontamination import _WORDS, lowered

    items = [(str(r["item_id"]), _WORDS.findall(lowered(r["text"]))) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in fourth.collect()}
    for i in random.Random(0).sample(sorted(texts), 25) + sorted(set(texts) - left):
        words = _WORDS.findall(lowered(texts[i]))
        hit, _ = brute_hits(words, items, 13)
        assert (i in left) == (not (hit and 20 * len(hit) >= len(words)))

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.encode(spark, fourth, folder).collect():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]])


def test_run_and_odd_documents(spark, folder):
    done = corpus_pipeline.run(spark, folder)
    assert done.count() and done.select("doc_id").distinct().count() == done.count()
    rows = [(None, None, "k"), (1, "", "k"), (2, "a b " * 40, "k"), (2, "a b " * 40, "k")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("score", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns, name
        assert stage(spark, odd.limit(0), folder).count() == 0, name
    kept = collections.Counter(r["kept"] for r in corpus_pipeline.clean(spark, odd, folder).collect())
    assert kept == {"k": 4}
