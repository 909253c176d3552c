"""Cross-tokenizer alignment against brute force, and the minimal perfect hash."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import alignment, queries
from quire.llm.tree_bpe import byte_letters
from quire.sources.tables import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    "a", "bc", " ", "  ", "\n", "\t", "\u00e9", "e\u0301", "\U0001f642", "\u4e2d\u6587", "<|endoftext|>", "<s>", "<0x41>", "\u2581", "'s", "...", "====", "12", "  \n",
    "\x1c", "\u2009", "aaaaaaaaaaaaaaaaaaaa", "of the", "ing ", "\x00", "      ",
]


class Plain:
    """Alignment one text at a time."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.byte = {c: b for b, c in enumerate(byte_letters())}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        of_a, of_b = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a], [self.piece(i) for i in b]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            return []
        ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in (of_a, of_b)]
        out, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            upto = [e.index(end, k) + 1 for e, k in zip(ends, at, strict=True)]
            out.append((a[at[0] : upto[0]], b[at[1] : upto[1]]))
            at = upto
        return out

    def rows(self, texts):
        """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each text."""
        cut = [self.groups(t) for t in texts]
        links = [[(x, y) for a, b in g for x in a for y in b] for g in cut]
        count = Counter(p for own in links for p in set(own))
        best = {}
        for (x, _), n in count.items():
            best[x] = max(n, best.get(x, 0))
        return [
            (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own),
             ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g))
            for g, own in zip(cut, links, strict=True)
        ]


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.mark.parametrize("bucket,slices", [(1 << 15, 128), (20, 2)])
def test_equals_brute_force_in_one_slice_and_in_many(spark, plain, monkeypatch, bucket, slices):
    monkeypatch.setattr(alignment, "BUCKET", bucket)
    monkeypatch.setattr(alignment, "SLICE", slices)
    monkeypatch.setattr(alignment, "FAN", 2)
    rng = random.Random(bucket)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(25 if slices == 2 else 300)]
    made += [None, "", " ", "  ", "a ", " a", "a" * 3000, " " * 2000 + "x", "same text"] + ["same text"] * 20
    if slices != 2:
        made.append(" ".join(f"word{rng.randrange(500)}," for _ in range(30_000)))
    df = spark.createDataFrame([(i, t, "mine", "x") for i, t in enumerate(made)], "id long, text string, N_A string, pair string").repartition(5)
    out = alignment.align(df, A, B)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.orderBy("id").collect()
    assert [r.text for r in rows] == made and {r.pair for r in rows} == {"x"}
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows] == plain.rows(made)


def test_empty_tables_and_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert alignment.align(df.limit(0), A, B).count() == 0
    assert {(r.n_a, r.n_links, r.count_sum, r.groups) for r in alignment.align(df, A, B).collect()} == {(0, 0, 0, "")}


def test_small_cache_gives_the_same(plain):
    rng = random.Random(9)
    aligner = alignment.Aligner(A, B, cache=50)
    texts = ["".join(rng.choice(PARTS) for _ in range(12)) for _ in range(300)]
    for i in range(0, 300, 10):
        of, offsets = aligner.align(texts[i : i + 10])
        groups = aligner.groups(0)
        assert [";".join(groups[j] for j in of[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)] == [r[-1] for r in plain.rows(texts[i : i + 10])]


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 50257 * alignment.PIECES, 30_000))
    buckets = 7
    of = alignment.bucket_of(keys, buckets)
    rows = []
    for b in range(buckets):
        sizes, bits, order = alignment.cascade(keys[of == b])
        rows.append((b, sizes, bits, order.tobytes()))
    every = alignment.PairHash(0, buckets, rows)
    found = every.find(keys)
    assert sorted(found.tolist()) == list(range(len(keys))) and (every.keys[found] == keys).all()
    others = np.setdiff1d(rng.integers(0, 50257 * alignment.PIECES, 5000), keys)
    assert (every.find(others) == -1).all()
    part = alignment.PairHash(3, buckets, rows[3:5])
    inside = (of == 3) | (of == 4)
    assert sorted(part.find(keys[inside]).tolist()) == list(range(inside.sum())) and (part.find(keys[~inside]) == -1).all()
    assert (alignment.PairHash(0, 1, []).find(keys) == -1).all()


def test_query_equals_brute_force_on_the_given_table(spark, folder, plain):
    docs = table(spark, folder, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_pair_hash"](spark, folder).collect()}
    for d, want in zip(docs, plain.rows([d.text for d in docs]), strict=True):
        groups = hashlib.sha256(want[-1].encode()).hexdigest() if want[2] else ""
        assert got[d.doc_id] == (*want[:-1], groups)
