"""The Merkle manifest against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import merkle

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, LEAF string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = (row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for row in tree[:-1]:
        other = i ^ 1
        out.append((row[other], other < i) if other < len(row) else None)
        i //= 2
    return out


def brute(rows, changed):
    """doc_id, position, leaf, subroot, root, proof, root of the version: of each row."""
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, bytes.fromhex(leaf(r)))):
        by.setdefault(r.lang, []).append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: levels([leaf(r) for r in by[n]]) for n in names}
    upper = levels([trees[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(by[n]):
            way = siblings(trees[n], i) + siblings(upper, k)
            node = leaf(r, 1 if changed(r) else 0)
            for s in way:
                node = h(node) if s is None else h(s[0], node) if s[1] else h(node, s[0])
            out.append((str(r.doc_id), i, leaf(r), trees[n][-1][0], upper[-1][0], tuple(s[0] for s in way if s), node))
    return sorted(out)


def made(df, changed):
    new = F.when(changed, merkle.leaf(df, changed={"n_chars": F.col("n_chars") + 1}))
    rows = merkle.manifest(df, changed=new).collect()
    return sorted((str(r.doc_id), r.position, r.leaf, r.subroot, r.root, tuple(r.proof), r.version_root) for r in rows)


@pytest.mark.parametrize("levels_of_a_block", [1, 3, 12])
def test_equals_plain_python_whatever_the_block(spark, monkeypatch, levels_of_a_block):
    monkeypatch.setattr(merkle, "HEIGHT", levels_of_a_block)
    rng = random.Random(levels_of_a_block)
    langs = [None, "", "de", "en", "en", "en", "en", "é", "\U0001f600", "\uffff"]
    rows = [(rng.randrange(10**6), rng.choice(["a", None]), rng.choice(langs), rng.choice([None, 7]), "é" * rng.randrange(9), "x") for _ in range(150)]
    rows += [(5, "a", "en", 7, "same", "x")] * 30 + [(None, "a", "en", 7, "no id", "x"), (7, None, None, None, None, "x"), (8, "s", "fr", 1, "long " * 100_000, "x")]
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert made(df, F.col("doc_id") % 3 == 0) == brute(df.collect(), lambda r: r.doc_id is not None and r.doc_id % 3 == 0)


def test_empty_one_row_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "en", 7, "t", "mine")], SHAPE)
    assert merkle.manifest(df.limit(0)).count() == 0
    out = merkle.manifest(df, keep=("doc_id", "LEAF", "text"))
    (row,) = out.collect()
    assert out.columns == ["doc_id", "text", *merkle.OUT[:1], "leaf", "subroot", "root", "proof", "version_root"]
    assert row.root == row.subroot == row.leaf == row.version_root and row.proof == []


def test_versions_share_what_they_do_not_change():
    leaves = [bytes([i]) * 32 for i in range(11)]
    tree = merkle.PersistentTree(leaves, 4)
    before = list(tree.digests)
    for i in range(11):
        size = len(tree.digests)
        root = tree.with_leaf(tree.root, i, b"n" * 32)
        assert len(tree.digests) - size == 5  # the leaf and its ancestors
        fresh = merkle.PersistentTree([*leaves[:i], b"n" * 32, *leaves[i + 1 :]], 4)
        assert tree.digests[root] == fresh.digests[fresh.root] == merkle.climb(b"n" * 32, tree.steps(tree.root, i))
    assert tree.digests[: len(before)] == before
