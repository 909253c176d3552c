"""Readers, writers and streams."""

import json
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators import chains
from quire.sources import changelog, results, sinks
from quire.sources.versions import Versions
from quire.streaming import ingest, state

T0 = datetime(2024, 1, 1)


def test_checkpoint_log(spark, tmp_path):
    doc = tmp_path / "job-1"
    doc.mkdir()
    lines = ['{"page":1,"result":{"markdown":"old"}}', "", '{"page":1,"result":{"markdown":"new"}}', '{"page":"x","result":{}}', '{"page":2}', '{"page":3,"result":{"mark']
    (doc / "pages.jsonl").write_text("\n".join(lines))
    got = changelog.latest_pages(changelog.read_log(spark, str(tmp_path)), "markdown string").collect()
    assert [(r["job_id"], r["page"], r["result"]["markdown"]) for r in got] == [("job-1", 1, "new")]
    changelog.append_log(got and spark.createDataFrame([("job-2", 5, ("z",))], "job_id string, page int, result struct<markdown:string>"), str(tmp_path / "out"))
    back = changelog.read_log(spark, str(tmp_path / "out"))
    assert json.loads(back.first()["line"]) == {"page": 5, "result": {"markdown": "z"}}


def test_results(spark, tmp_path):
    for job, body in (("a", {"title": "T", "pageCount": 1, "markdown": "m", "pages": [{"page": 1, "markdown": "x", "method": "ai", "usage": {"inputTokens": 3}}]}), ("b", None)):
        (tmp_path / job).mkdir()
        (tmp_path / job / "result.json").write_text("{half" if body is None else json.dumps(body))
    r = results.read_results(spark, str(tmp_path))
    assert {x["job_id"]: x["readable"] for x in r.collect()} == {"a": True, "b": False}
    p = results.result_pages(r).collect()
    assert len(p) == 1 and p[0]["usage"]["inputTokens"] == 3 and p[0]["no_text"] is None
    stored = results.result_pages(r).select(F.to_json(results.page_struct()).alias("j")).first()["j"]
    assert "noText" not in stored
    results.write_results(r.filter("readable").select("job_id", "title", "pages"), str(tmp_path / "out"))
    assert [r["title"] for r in results.read_results(spark, str(tmp_path / "out")).collect()] == ["T"]


IDS = ["job-1", "a b", "x:y", "50%", "a%20b", "ü+/?#=", "007", "c=d", None]


def test_log_round_trip(spark, tmp_path):
    out = str(tmp_path / "log")
    for text in ("old", "new"):  # the second append wins
        rows = [(j, p, (f"{text} {j} {p}",)) for j in IDS for p in ((1, 2) if text == "old" else (2, 3))]
        changelog.append_log(spark.createDataFrame(rows, "job_id string, page int, result struct<markdown:string>").repartition(3), out)
    got = {(r["job_id"], r["page"]): r["result"]["markdown"] for r in changelog.latest_pages(changelog.read_log(spark, out), "markdown string").collect()}
    assert got == {(j, p): f"{'old' if p == 1 else 'new'} {j} {p}" for j in IDS for p in (1, 2, 3)}
    (tmp_path / "log" / "job-1").mkdir()
    (tmp_path / "log" / "job-1" / "pages.jsonl").write_text(json.dumps({"page": 3, "result": {"markdown": "newest"}}))
    again = changelog.latest_pages(changelog.read_log(spark, out), "markdown string").filter("job_id = 'job-1' AND page = 3").collect()
    assert [r["result"]["markdown"] for r in again] == ["newest"]


def test_results_round_trip(spark, tmp_path):
    rows = [(j, f"title {j}\nof two lines", 2, [(1, "x"), (2, "é")]) for j in IDS]
    docs = spark.createDataFrame(rows, "job_id string, title string, pageCount long, pages array<struct<page: int, markdown: string>>")
    results.write_results(docs, str(tmp_path / "out"))
    got = results.read_results(spark, str(tmp_path / "out"))
    assert {(r["job_id"], r["title"], r["pageCount"], r["readable"]) for r in got.collect()} == {(j, t, n, True) for j, t, n, _ in rows}
    assert {(r["job_id"], r["page"], r["markdown"]) for r in results.result_pages(got).collect()} == {(j, p, m) for j, *_, ps in rows for p, m in ps}


def stored(spark, out):
    return {r["job_id"]: (r["title"], r["pageCount"], r["markdown"]) for r in results.read_results(spark, out).collect()}


def test_saving_one_document_leaves_the_others(spark, tmp_path):
    out = str(tmp_path / "out")
    shape = "job_id string, title string, pageCount long, markdown string"
    results.write_results(spark.createDataFrame([(j, f"t {j}", 1, "m") for j in IDS], shape), out, buckets=4)
    parts = {p.bucket: p for p in Versions(spark, out).latest()[1]}
    results.write_results(spark.createDataFrame([("a b", "new", 2, None), ("a b", "newest", 3, None)], shape).coalesce(1), out)
    assert stored(spark, out) == {j: ("newest", 3, None) if j == "a b" else (f"t {j}", 1, "m") for j in IDS}
    after = {p.bucket: p for p in Versions(spark, out).latest()[1]}
    assert sum(parts[b] != after[b] for b in parts) == 1 and len(parts) > 1  # one bucket is written anew
    results.write_results(spark.createDataFrame([("fresh", "f", 1, "x")], shape), out)
    assert len(stored(spark, out)) == len(IDS) + 1
    assert sum(1 for _ in tmp_path.rglob("*.parquet")) < 30


def test_patches_are_applied_in_order_and_absent_fields_stay(spark, tmp_path):
    out = str(tmp_path / "out")
    results.write_results(spark.createDataFrame([(j, f"t {j}", 1, "m") for j in IDS], "job_id string, title string, pageCount long, markdown string"), out, buckets=4)
    rows = [("50%", 2, ["title"], "second", 9), ("50%", 1, ["title", "pageCount"], "first", 7), (None, 1, ["markdown", "title"], None, 5), ("none", 1, ["title"], "x", 1), ("007", 1, [], "x", 1)]
    results.patch_results(spark.createDataFrame(rows, "job_id string, seq int, fields array<string>, title string, pageCount long"), out)
    want = {j: (f"t {j}", 1, "m") for j in IDS} | {"50%": ("second", 7, "m"), None: (None, 1, None)}
    assert stored(spark, out) == want


def test_two_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's reading and its commit."""
    out = str(tmp_path / "out")
    shape = "job_id string, title string"
    results.write_results(spark.createDataFrame([("x", "0"), ("y", "0")], shape), out, buckets=1)
    commit, between = Versions.commit, []

    def late(self, base, parts, settings):
        if not between:
            between.append(1)
            results.write_results(spark.createDataFrame([("y", "other"), ("z", "other")], shape), out)
        return commit(self, base, parts, settings)

    monkeypatch.setattr(Versions, "commit", late)
    results.write_results(spark.createDataFrame([("x", "mine")], shape), out)
    assert {j: t for j, (t, *_) in stored(spark, out).items()} == {"x": "mine", "y": "other", "z": "other"}


def lines(spark, out):
    return {(r["job_id"], r["page"]): r["result"]["markdown"] for r in changelog.latest_pages(changelog.read_log(spark, out), "markdown string").collect()}


def test_the_log_is_in_commit_order_and_compacts(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "log")
    add = lambda rows, **kw: changelog.append_log(spark.createDataFrame([(j, p, (m,)) for j, p, m in rows], "job_id string, page int, result struct<markdown:string>"), out, **kw)
    add([("a", 1, "1"), ("b", 1, "1")])
    commit, between = Versions.commit, []

    def late(self, base, parts, settings):
        if not between:
            between.append(1)
            add([("a", 1, "earlier"), ("c", 1, "c")])
        return commit(self, base, parts, settings)

    monkeypatch.setattr(Versions, "commit", late)
    add([("a", 1, "later")])  # begins first, commits second
    monkeypatch.setattr(Versions, "commit", commit)
    want = {("a", 1): "later", ("b", 1): "1", ("c", 1): "c"}
    assert lines(spark, out) == want
    changelog.compact_log(spark, out)
    assert lines(spark, out) == want and len(Versions(spark, out).latest()[1]) == 1
    for i in range(5):
        add([("a", 1, str(i))], compact_after=3)
    assert lines(spark, out)[("a", 1)] == "4" and len(Versions(spark, out).latest()[1]) <= 3
    changelog.clear_log(spark, out, spark.createDataFrame([("a",)], "job_id string"))
    assert lines(spark, out) == {("b", 1): "1", ("c", 1): "c"}


def test_ocr_and_files(spark, tmp_path):
    (tmp_path / "o" / "j1").mkdir(parents=True)
    (tmp_path / "o" / "j1" / "results.json").write_text(json.dumps({"doc": [{"blocks": [{"label": "Text", "html": "a"}]}, {"blocks": []}]}))
    rows = results.read_ocr(spark, str(tmp_path / "o")).orderBy("page").collect()
    assert [(r["job_id"], r["page"], len(r["blocks"])) for r in rows] == [("j1", 1, 1), ("j1", 2, 0)]
    (tmp_path / "o" / "n.md").write_text("# n")
    assert results.read_markdown(spark, str(tmp_path / "o")).first()["markdown"] == "# n"
    assert results.read_files(spark, str(tmp_path / "o")).count() == 2


def test_zip(spark, tmp_path):
    rows = [(f"文档 {i}.md", "内容" * i * 20, T0 + timedelta(days=i)) for i in range(12)]
    entries = spark.createDataFrame(rows, "name string, content string, updated_at timestamp")
    sinks.write_zip(entries, str(tmp_path / "zip"), archives=3)
    seen = {}
    for part in (tmp_path / "zip").glob("*.zip"):
        with zipfile.ZipFile(part) as z:
            assert z.testzip() is None
            seen.update({n: z.read(n).decode() for n in z.namelist()})
    assert seen == {n: c for n, c, _ in rows} and not list((tmp_path / "zip").glob("*.tmp"))
    import zlib

    crc = {r["name"]: r["crc32"] for r in sinks.checksums(entries, F.col("content")).collect()}
    assert crc["文档 3.md"] == zlib.crc32(rows[3][1].encode())


def test_merged_and_document_files(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b.pdf", "B"), (1, "a.pdf", "A")], "n int, filename string, markdown string")
    sinks.write_merged(docs, [F.col("n")], str(tmp_path / "m"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text == "<!-- 来源文件：a.pdf -->\n\nA\n\n---\n\n<!-- 来源文件：b.pdf -->\n\nB\n"
    pages = spark.createDataFrame([(1, p, f"p{p}" if p != 2 else "", "text", None, None) for p in (3, 1, 2)],
                                  "job_id long, page int, markdown string, method string, no_text boolean, note string")
    sinks.write_documents(pages, str(tmp_path / "d"))
    body = "".join(p.read_text() for p in (tmp_path / "d").rglob("part-*"))
    assert body.index("p1") < body.index("未检测到文字") < body.index("p3")


def file_stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def lane_rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice("aaab"), T0 + timedelta(milliseconds=700 * i), i, rng.random() < 0.8, rng.randrange(60000)) for i in range(n)]


def lane_loop(rows, top):
    want, lanes = [], {}
    for lane, ts, i, ok, ms in rows:
        limit, wins, cut = lanes.get(lane, (top, 0, -10**9))
        at = int(ts.timestamp() * 1000)
        before = limit
        if ok and ms <= 45000:
            wins += 1
            if wins >= 4 and limit < top:
                limit, wins = limit + 1, 0
        else:
            wins = 0
            if at - cut >= 5000:
                cut, limit = at, max(2, int(limit * 0.7))
        lanes[lane] = (limit, wins, cut)
        if limit != before:
            want.append((i, limit))
    return want


LANES = "lane string, ts timestamp, event_id long, ok boolean, latency_ms long"


def test_lane_limits_stream_against_a_plain_loop(spark, tmp_path):
    rows = lane_rows(5, 400)
    s = file_stream(spark, rows, LANES, tmp_path / "in")
    out = ingest.run_to_table(state.lane_limits(s, top=20), "test-lanes")
    got = sorted((r["event_id"], r["lane_limit"]) for r in out.collect())
    assert got == lane_loop(rows, 20) and got


@pytest.mark.parametrize("ranges", [1, 7])
def test_lane_limits_of_a_hot_lane_cut_in_ranges(spark, ranges):
    rows = lane_rows(6, 700)
    out = chains.lane_limits(spark.createDataFrame(rows, LANES), top=20, ranges=ranges)
    assert sorted((r["event_id"], r["lane_limit"]) for r in out.collect()) == lane_loop(rows, 20)


@pytest.mark.parametrize("seed", range(2))
def test_a_machine_that_never_forgets_is_still_exact(spark, seed):
    """A running sum depends on everything before: every range is walked again."""
    import pandas as pd

    rng = random.Random(seed)
    rows = [("h" if i % 3 else "k", i, rng.randrange(100)) for i in range(300)]

    def walk(total, pdf):
        sums = pdf["v"].cumsum() + total[0]
        return (int(sums.iloc[-1]),), pd.DataFrame({"i": pdf["i"], "s": sums})

    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = chains.walk_in_order(df, "k", ["i"], {"total": 0}, walk, "i long, s long", ranges=4)
    want, sums = {}, {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert {r["i"]: r["s"] for r in out.collect()} == want


def lanes_of(rows):
    import pandas as pd

    return pd.DataFrame([(ok and ms <= 45000, int(t.timestamp() * 1000), i) for _, t, i, ok, ms in rows], columns=["good", "at_ms", "event_id"])


@pytest.mark.parametrize("seed", range(40))
def test_lane_walk_in_any_pieces_equals_the_plain_loop(seed):
    rng = random.Random(seed)
    rows = [("a", T0 + timedelta(milliseconds=900 * i), i, rng.random() < 0.9, 0) for i in range(rng.randrange(1, 300))]
    top, state, got, start = rng.choice([1, 3, 20]), None, [], 0
    state = (top, 0, 0)
    while start < len(rows):
        size = rng.randrange(1, 60)
        state, out = chains.lane_walk(state, lanes_of(rows[start : start + size]), top, max(1, min(2, top)))
        got += list(zip(out["event_id"], out["lane_limit"]))
        start += size
        assert max(1, min(2, top)) <= state[0] <= top
    if top > 1:
        assert got == lane_loop(rows, top)
    else:
        assert got == []


@pytest.mark.parametrize("seed", range(40))
def test_progress_walk_in_any_pieces_equals_a_plain_loop(seed):
    import pandas as pd

    rng = random.Random(seed)
    page, rows, at = 0, [], 0
    for _ in range(rng.randrange(1, 200)):
        at += rng.choice([0, 10, 120, 500])
        page = rng.choice([page, page + 1, page + 1, page + 4, max(0, page - 2), 0, 50])
        rows.append((at, page, 50))
    want, last = [], (0, -1)
    for at, page, total in rows:
        if page in (0, total) or page > total or page < last[1] or page > last[1] + 1 or at >= last[0] + 300:
            want.append((at, page))
            last = (at, page)
    state, got, start = (0, -1), [], 0
    while start < len(rows):
        size = rng.randrange(1, 40)
        state, out = chains.progress_walk(state, pd.DataFrame(rows[start : start + size], columns=["at_ms", "page", "total"]))
        got += list(zip(out["at_ms"], out["page"]))
        start += size
    assert got == want


def test_progress_throttle(spark, tmp_path):
    rows = [(1, 0, 0, 9), (1, 100, 1, 9), (1, 250, 2, 9), (1, 310, 2, 9), (1, 320, 5, 9), (1, 330, 4, 9), (1, 340, 9, 9)]
    s = file_stream(spark, rows, "job_id long, at_ms long, page long, total long", tmp_path / "in")
    out = ingest.run_to_table(state.progress_writes(s), "test-progress")
    batch = chains.progress_writes(spark.createDataFrame(rows, "job_id long, at_ms long, page long, total long"), ranges=3)
    assert sorted(r["at_ms"] for r in batch.collect()) == [0, 250, 320, 330, 340]
    assert sorted(r["at_ms"] for r in out.collect()) == [0, 250, 320, 330, 340]  # jumps count from the last written page


def test_usage_logs(spark, tmp_path):
    entry = lambda i, **kw: json.dumps({"timestamp": "2024-01-01T00:00:00.000Z", "requestId": f"r{i}", "message": {"id": f"m{i}", "model": "claude-sonnet-1", "usage": {
        "input_tokens": 10, "output_tokens": 1, "cache_read_input_tokens": 100, "cache_creation_input_tokens": 7}, **kw}})
    made = {"usage": {"input_tokens": 0, "cache_creation": {"ephemeral_1h_input_tokens": 10, "ephemeral_5m_input_tokens": 4}, "cache_creation_input_tokens": 99}}
    lines = [entry(1), entry(1), entry(2, model="<synthetic>"), entry(3, **made), entry(4)[:50], '{"message":{"usage":{}}}', "{}"]
    for d in ("x", "own-app"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "log.jsonl").write_text("\n".join(lines if d == "x" else [entry(9)]) + "\n")
    rows = ingest.parse_usage(ingest.read_usage_logs(spark, str(tmp_path), exclude_dirs=["own-app"]))
    ingest.keep_first(rows, str(tmp_path / "table"), str(tmp_path / "check"))
    got = {r["key"]: r["usd"] for r in ingest.usage_rows(spark, str(tmp_path / "table")).collect()}
    assert set(got) == {"m1|r1", "m3|r3"}
    assert abs(got["m1|r1"] - (10 * 2 + 10 + 100 * 0.2 + 7 * 2.5) / 1e6) < 1e-12
    assert abs(got["m3|r3"] - (10 * 4 + 4 * 2.5) / 1e6) < 1e-12


def usage_line(i, n, at="2024-01-01T00:00:00.000Z"):
    return json.dumps({"timestamp": at, "requestId": "r", "message": {"id": f"m{i}", "model": "claude-sonnet-1", "usage": {"input_tokens": n}}}) + "\n"


def test_logs_grow_are_cut_and_shortened(spark, tmp_path):
    """Each trigger takes what is new and whole; the first copy of a key stays."""
    logs = tmp_path / "logs" / "deep"
    logs.mkdir(parents=True)

    def step():
        rows = ingest.parse_usage(ingest.read_usage_logs(spark, str(tmp_path / "logs"), split_bytes=100))
        ingest.keep_first(rows, str(tmp_path / "table"), str(tmp_path / "check"), compact_after=3)
        return {r["key"].split("|")[0]: round(r["usd"] * 1e6 / 2) for r in ingest.usage_rows(spark, str(tmp_path / "table")).collect()}

    half = usage_line(4, 4)
    (logs / "b.jsonl").write_text(usage_line(1, 20) + usage_line(2, 2))
    (logs / "a.jsonl").write_text(usage_line(1, 1) + usage_line(3, 3) + half[:70])
    (logs / "other.txt").write_text(usage_line(9, 9))
    assert step() == {"m1": 1, "m2": 2, "m3": 3}  # of two copies in one trigger the one in the first file
    with (logs / "a.jsonl").open("a") as f:
        f.write(half[70:] + usage_line(1, 50) + "é not json\n")
    assert step() == {"m1": 1, "m2": 2, "m3": 3, "m4": 4}
    (logs / "b.jsonl").write_text(usage_line(5, 5))  # shorter than it was: read from its start
    assert step() == {"m1": 1, "m2": 2, "m3": 3, "m4": 4, "m5": 5}
    (logs / "c.jsonl").write_text("".join(usage_line(i, i) for i in range(6, 40)) + "\n\n")
    want = {f"m{i}": i for i in range(1, 40)}
    assert step() == want
    for i in range(40, 44):
        (logs / f"d{i}.jsonl").write_text(usage_line(i, i) + usage_line(1, 99))
        step()
    assert step() == want | {f"m{i}": i for i in range(40, 44)}
    assert len(Versions(spark, str(tmp_path / "table")).latest()[1]) <= 3


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_every_line_is_read_once_whatever_the_splits(tmp_path, split):
    from quire.streaming import growing

    rng = random.Random(split)
    parts = ["x" * rng.randrange(30) + "é" * rng.randrange(3) for _ in range(60)]
    (tmp_path / "f.log").write_text("\n".join(parts) + "\nhalf")
    reader = growing.GrowingReader({"path": str(tmp_path), "splitbytes": str(split)})
    end = reader.latestOffset()
    rows = [(r["position"], r["value"]) for p in reader.partitions({}, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [v for _, v in rows] == parts and [a for a, _ in rows] == sorted(a for a, _ in rows)
    assert list(reader.partitions(end, end)) == []
    assert growing.last_line_end(growing.fs.LocalFileSystem(), str(tmp_path / "f.log"), 3) in (0, 1, 2, 3)


def test_old_files_are_passed_over_only_where_asked(tmp_path):
    import os

    from quire.streaming import growing

    (tmp_path / "old.log").write_text("a\n")
    (tmp_path / "new.log").write_text("b\n")
    os.utime(tmp_path / "old.log", (1, 1))
    for age, count in (("", 2), ("8", 1)):
        reader = growing.GrowingReader({"path": str(tmp_path), "maxagedays": age})
        assert len(reader.partitions({}, reader.latestOffset())) == count


def test_most_free_lane(spark):
    lanes = spark.createDataFrame([("b", 5, 1), ("a", 6, 2), ("c", 3, 3)], "lane string, lane_limit int, in_flight int")
    assert tuple(state.most_free(lanes).first()) == ("a", 4)
