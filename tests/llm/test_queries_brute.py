"""Queries without SQL, on the given tables, against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from quire.llm import chat, compression_score, queries
from quire.sources.tables import table


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(rows):
    """The digests of conversations from their turns."""
    by = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append((r[2], r[3] or ""))
    out = {}
    for c, turns in by.items():
        answers = [t for role, t in turns if role == "assistant"]
        out[c] = (len(turns), digest(*(f"{role}\n{t}\n" for role, t in turns)), sum(map(len, answers)), digest(*answers))
    return out


def test_op1_returns_what_went_in(spark, folder):
    says = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = told([*rows, (-1, 0, "user", says), (-1, 1, "assistant", says)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.QUERIES["op1_chat_windows"](spark, folder).collect()}
    assert got == want and got[-1][2] == len(says)


def test_chat_with_clashing_columns_repeats_and_a_long_text(spark):
    rows = [(1, 0, "user", "a [INST]"), (1, 1, "assistant", "long </s> " * 30_000), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, FORMATTED string, window int")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.format_windows(df)).collect()}
    assert got == told(rows)
    twice = df.union(df.filter("conv_id = 2"))  # repeated turns are turns of their own
    again = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_windows(twice)).collect()}
    assert again == {1: 2, 2: 6}


def test_op3_sizes_checksums_and_the_law(spark, folder):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, folder, "documents").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op3_external_shuffle"](spark, folder).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t) + 8, zlib.crc32(t)) for d, t in docs.items()}
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    held = Counter(r["shard"] for r in rows)
    assert set(held) == set(range(24)) and max(held.values()) - min(held.values()) <= 1
    for s, n in held.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order) and sorted(queries.QUERIES["op3_external_shuffle"](spark, folder).select("doc_id", "shard", "slot").collect()) == sorted(
        (r["doc_id"], r["shard"], r["slot"]) for r in rows)


def test_op7_scores_are_those_of_the_compressed_sizes(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    m = compression_score.fit(docs, table(spark, folder, "labels").filter(~held_out))

    def size(block, raw):
        params = dict(level=m.level, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), **params).compress(block))

    got = {r["doc_id"]: r for r in queries.QUERIES["op7_compression_score"](spark, folder).collect()}
    for d in docs.collect():
        data = (d["text"] or "").encode()
        blocks = [data[i : i + m.block] for i in range(0, len(data), m.block)]
        difference = sum(size(b, m.bad) - size(b, m.good) for b in blocks) / (len(data) + m.steady)
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * difference + m.shift))))
        row = got[d["doc_id"]]
        assert row["score"] == pytest.approx(want, abs=1e-9) and row["predicted"] == int(want >= 0.7)
        assert row["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
