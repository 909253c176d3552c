"""Word BPE by segment trees against the library, and its odd cases."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import queries, tree_bpe
from quire.sources.tables import table

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "b", "é", "\u03a3", "\u03c2", "\u0065\u0301", "'s", "'re", " ", "  ", "\n", "\t", "\x1c", "1", "23", "<|endoftext|>", "<|startoftext|>", "<|", "\U0001f642",
    "\u4e2d\u6587", "\u2009", "\u0130", "\u01c5", "!", "..", "==", "\u1c8a", "\ufb01", "\u00bd", "\x00", "of", "the", "ing", "A\u030a", "\u212b", "\u1100\u1161", "\U00010d50",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def compare(encoder, library, texts):
    ids, offsets = encoder.encode(texts)
    decoded = tree_bpe.decode_flat(encoder.vocab, ids, offsets)
    for i, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want.ids, texts[i][:100]
        assert decoded[i] == library.decode(want.ids, skip_special_tokens=False)


def test_ids_and_texts_equal_the_library(library):
    rng, encoder = random.Random(5), tree_bpe.Encoder(PATH, cache_chunks=500)
    for _ in range(20):  # the cache is emptied on the way
        compare(encoder, library, ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(200)])
    compare(encoder, library, [f"a{chr(c)}B1{chr(c)}" for c in range(0x3000)])


def test_long_words_and_both_forms_of_the_tree(library):
    rng, encoder = random.Random(6), tree_bpe.Encoder(PATH)
    words = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in [*range(1, 140), 5000]]
    compare(encoder, library, [*words, "a" * 3000, "=-" * 700, " ".join(words)])
    merges = encoder.vocab.merges
    for w in words[1:64]:
        symbols = encoder.vocab.first[list(w.encode())]
        assert merges.merge(symbols, tree_bpe.np.array([len(symbols)]))[0].tolist() == merges.tall(symbols.tolist())


def test_column_forms(spark, library):
    long = " ".join(f"word{i % 613}" for i in range(40_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "one Two", "x"), (3, "one Two", "x"), (None, "one Two", "x"), (4, long, "x"), (5, " \n\t", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string").repartition(3)
    made = tree_bpe.encode(df, PATH)
    assert len({c.lower() for c in made.columns}) == len(made.columns)
    got = {(r.doc_id, r.text): r for r in made.collect()}
    assert made.count() == len(rows) and got[(1, None)].ids == [] and got[(1, None)].decoded == "" and got[(5, " \n\t")].n_tokens == 0
    for text in ("one Two", long):
        want = library.encode(text, add_special_tokens=False)
        row = next(r for r in got.values() if r.text == text)
        assert row.ids == want.ids and row.n_tokens == len(want.ids) and row.decoded == library.decode(want.ids, skip_special_tokens=False)
    back = tree_bpe.decode(made.select("doc_id", "ids", made.decoded.alias("was")), PATH).collect()
    assert all(r.decoded == r.was for r in back)
    assert tree_bpe.encode(df.limit(0), PATH).count() == 0
    assert tree_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded == ""


def test_query_equals_the_library_on_the_given_table(spark, folder, library):
    got = {r.doc_id: r for r in queries.QUERIES["op12_tree_bpe"](spark, folder).collect()}
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        row = got[d.doc_id]
        assert row.n_tokens == len(want) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
