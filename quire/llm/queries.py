"""The queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    alignment,
    chat,
    compression_score,
    decontamination,
    html_crf,
    language_model,
    license_scan,
    merkle,
    near_dedup,
    piece_bpe,
    quality_rules,
    sharding,
    tree_bpe,
)
from quire.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def key_remainder(id: str, n: int):
    """crc32 of the id as text, modulo n (a null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query("op1_chat_windows")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"),
    )
    return chat.read_back(chat.format_windows(rows.unionByName(extra)))


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return quality_rules.apply_rules(docs, counts=counts).select("doc_id", *counts, failed.alias("base_failed"), "kept")


@query("op3_external_shuffle")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.shuffle_shards(docs, shards=24).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_suffix_automaton")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query("op5_piece_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op6_html_crf")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_crf.extract(pages, html_crf.fit(pages)).select("page_id", "url", "text", "n_chars")


@query("op7_compression_score")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = key_remainder("doc_id", 4) == 2
    model = compression_score.fit(docs, table(spark, folder, "labels").filter(~held_out))
    return compression_score.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op8_license_bands")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select("doc_id", "n_words", "licenses", "matches")


@query("op9_backoff_automaton")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = key_remainder("doc_id", 5) == 1
    model = language_model.fit(docs.filter(~held_out))
    return language_model.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query("op10_coordinate_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = near_dedup.judged(docs, shingle=2, percent=80)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op11_path_copying_tree")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    more = merkle.leaf(docs, changed={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    made = merkle.manifest(docs, changed=F.when(tampered, more))
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
        F.col("version_root").alias("folded_root"), (F.col("version_root") == F.col("root")).alias("verified"),
    )


@query("op12_tree_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tree_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op13_pair_hash")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return made.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op2_quality_rules"] = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM base),
grams AS (
  SELECT rid, i, word, lead(word) OVER s AS w2, lead(word, 2) OVER s AS w3 FROM words WINDOW s AS (PARTITION BY rid ORDER BY i)),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w2, w3) AS n FROM grams WHERE w3 IS NOT NULL) WHERE n >= 2),
hit AS (
  SELECT rid, count(DISTINCT i + s) AS n FROM again, (SELECT unnest([0, 1, 2]) AS s) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM base),
dup AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counted AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
    coalesce(h.n, 0)::BIGINT AS n_repeat_words, coalesce(d.n_lines, 0) AS n_lines,
    len(t) - len(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, len(t) - len(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters,
    (len(t) - len(replace(t, '!!', ''))) / 2 AS n_bangs
  FROM base b LEFT JOIN hit h USING (rid) LEFT JOIN dup d USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > n_letters OR 10 * n_bangs > n_words) AS kept
FROM counted"""

ORACLE["op4_suffix_automaton"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
found AS (SELECT rid, i, k, item_id FROM places JOIN windows USING (k, gram)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM found)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""

_PARTS = ["CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END".format(c) for c in ("doc_id", "source", "lang", "{n}", "text")]
_LEAF = "sha256(" + " || ".join(_PARTS) + ")"

ORACLE["op11_path_copying_tree"] = f"""
WITH RECURSIVE rows AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
      4294967295::BIGINT) % 7 = 0 AS tampered FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF.format(n='n_chars')} AS leaf,
    CASE WHEN tampered THEN {_LEAF.format(n='(n_chars + 1)')} ELSE {_LEAF.format(n='n_chars')} END AS changed FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS m FROM leaves),
lower AS (
  SELECT 0 AS level, tree, idx, leaf AS node, m FROM placed
  UNION ALL
  SELECT any_value(level) + 1, tree, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(m) + 1) // 2 FROM lower WHERE m > 1 GROUP BY tree, idx // 2),
subroots AS (SELECT tree, node AS subroot, level AS levels, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM lower WHERE m = 1),
upper AS (
  SELECT 0 AS level, place AS idx, subroot AS node, trees AS m FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(m) + 1) // 2 FROM upper WHERE m > 1 GROUP BY idx // 2),
root AS (SELECT node AS root, level AS levels FROM upper WHERE m = 1),
steps AS (
  SELECT p.tree, p.idx, l.level, l.node AS sibling, l.idx & 1 = 0 AS on_left FROM placed p JOIN lower l ON l.tree = p.tree AND l.idx = xor(p.idx >> l.level, 1) AND l.m > 1
  UNION ALL
  SELECT p.tree, p.idx, s.levels + u.level, u.node, u.idx & 1 = 0
  FROM placed p JOIN subroots s USING (tree) JOIN upper u ON u.idx = xor(s.place >> u.level, 1) AND u.m > 1),
proofs AS (SELECT tree, idx, string_agg(sibling, '' ORDER BY level) AS proof FROM steps GROUP BY tree, idx),
folds AS (
  SELECT p.tree, p.idx, 0 AS level, p.changed AS node, s.levels + root.levels AS top FROM placed p JOIN subroots s USING (tree), root
  UNION ALL
  SELECT f.tree, f.idx, f.level + 1,
    sha256(CASE WHEN s.sibling IS NULL THEN f.node WHEN s.on_left THEN s.sibling || f.node ELSE f.node || s.sibling END), f.top
  FROM folds f LEFT JOIN steps s ON s.tree = f.tree AND s.idx = f.idx AND s.level = f.level WHERE f.level < f.top)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(coalesce(proof, '')) AS proof_sha256, f.node AS folded_root, f.node = root.root AS verified
FROM placed p JOIN subroots s USING (tree) JOIN folds f ON f.tree = p.tree AND f.idx = p.idx AND f.level = f.top
  LEFT JOIN proofs ON proofs.tree = p.tree AND proofs.idx = p.idx, root"""

ORACLE["op10_coordinate_join"] = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)"""
