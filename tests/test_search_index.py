"""The kept search index against a scan of the texts."""

import random
import re
from collections import Counter

import pytest

from quire.operators import search, search_index
from quire.operators.search import needle_of
from quire.sources.versions import Versions

PARTS = ["a", "b", "ab", "Ab", " ", "\n", "\u00e9", "\u6587\u5b57", "\U0001f642", "aa", "aaa", ".", "%", "_", "\\\\E"]
NEEDLES = ["ab", "aaa", "aA a", "\u6587\u5b57", "\U0001f642a", "b", "", "a.b", "%_", "\u00e9ab", "\\\\E", "zzz"]


def texts(rng, ids):
    return [(i, p, "".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) if rng.random() < 0.9 else None) for i in ids for p in (1, 2, 3)]


def scan(rows, alive, query):
    needle, out = needle_of(query), Counter()
    for i, _, t in rows:
        n = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).count(needle) if needle else 0
        if n and i in alive:
            out[str(i)] += n
    return dict(out)


def found(spark, path, query):
    return {r["job_id"]: r["hits"] for r in search_index.hit_counts(spark, path, query).collect()}


@pytest.mark.parametrize("named", [500, 0])
def test_equals_a_scan_through_changes(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(search_index, "NAMED", named)
    rng, path = random.Random(named), str(tmp_path / "index")
    shape, stamps = "job_id long, page int, markdown string", {i: "1" for i in range(20)}
    rows = texts(rng, stamps)

    def bring():
        jobs = spark.createDataFrame(list(stamps.items()), "id long, updated_at string")
        search_index.sync(jobs, spark.createDataFrame(rows, shape).repartition(3), path, compact_after=50)

    def same(needles):
        for n in needles:
            assert found(spark, path, n) == scan(rows, stamps, n), n

    bring()
    same(NEEDLES if named else NEEDLES[:4])
    before = Versions(spark, path).latest()
    bring()
    assert Versions(spark, path).latest() == before  # nothing has changed
    fresh = texts(rng, [3, 4, 30])
    rows = [r for r in rows if r[0] not in (3, 4)] + fresh
    stamps.update({3: "2", 4: "2", 30: "1"})
    gone = stamps.pop(7)
    bring()
    same(NEEDLES[:4])
    kept = [p for p in before[1] if p.bucket >= 0]
    assert set(kept) <= set(Versions(spark, path).latest()[1])  # what did not change is not written again
    stamps[7] = gone  # comes back as it was
    bring()
    same(NEEDLES[:2])
    search_index.compact(spark, path)
    same(NEEDLES[:3])
    assert len({p.at for p in Versions(spark, path).latest()[1]}) == 1


def test_reads_only_the_candidates(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(i, 1, f"page {i} " + ("needle" if i % 10 == 0 else "haystack need")) for i in range(100)]
    search_index.sync(
        spark.createDataFrame([(i, "1") for i in range(100)], "id long, updated_at string"), spark.createDataFrame(rows, "job_id long, page int, markdown string"), path)
    assert search_index.candidates(spark, path, "needle").count() == 10
    plan = search_index.pages_with(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "In(job_id" in plan.replace("PushedFilters: [", "") and "In(gram" in plan


def test_empty_library(spark, tmp_path):
    path = str(tmp_path / "index")
    none = spark.createDataFrame([], "id long, updated_at string"), spark.createDataFrame([], "job_id long, page int, markdown string")
    search_index.sync(*none, path)
    assert found(spark, path, "ab") == {}
    assert search.hit_counts(none[1], "ab").count() == 0


def test_a_row_of_postings_for_a_gram_and_block(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(i, p, "the same words on every page") for i in range(50) for p in (1, 2)]
    search_index.sync(
        spark.createDataFrame([(i, "1") for i in range(50)], "id long, updated_at string"),
        spark.createDataFrame(rows, "job_id long, page int, markdown string"), path)
    parts = [p for p in Versions(spark, path).latest()[1] if 0 <= p.bucket < search_index.BUCKETS]
    # a row of each page would be 100 for each gram; there is at most one block a task of the scan
    written = Versions(spark, path).read(parts, search_index.POSTINGS).groupBy("gram").count().agg({"count": "max"}).first()[0]
    assert written <= 8
    # what moves to the join are numbers: the text is counted where it is read
    lines = search_index.hit_counts(spark, path, "same")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(i for i, line in enumerate(lines) if "Join" in line)
    assert "Project [" in lines[joined + 1] and not re.search(r"[\[ ]markdown#", lines[joined + 1])


def test_grams_of_stretches(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    rng = random.Random(5)
    wide = [chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(2000)] + [chr(c) for c in range(0x20000, 0x2A6D0)]
    values = ["", None, "a", "Ab", "aB\n", "\U0001f642É", "".join(wide)] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(300)]
    values += ["".join(rng.sample(wide, 20000)) for _ in range(3)]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for most in (4_000_000, 200):
        monkeypatch.setattr(search_index, "BLOCK_BYTES", most)
        found = [set() for _ in values]
        for first, end, grams, ends, places in search_index._grams(pa.array(values, pa.string())):
            for i, g in enumerate(grams):
                for p in places[ends[i] : ends[i + 1]]:
                    assert g not in found[first + p]
                    found[first + p].add(g)
        for value, grams in zip(values, found, strict=True):
            t = (value or "").translate(lower) + "\0\0"
            assert grams == {t[i : i + 3] for i in range(len(t) - 2)}
