"""Operators on small fixtures, among them skewed ones, against brute force."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import prices
from quire.operators import ledger, library, ordered, outages, reflect, search

T0 = datetime(2024, 1, 1)


def test_running_total_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", T0 + timedelta(seconds=rng.randrange(40000)), i, rng.randrange(-5, 6)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, v long")
    order = [F.col("ts").asc(), F.col("id").asc()]
    for how in ("sum", "max"):
        out = ordered.running_total(df, F.col("v"), order, ["k"], "r", how)
        got = {r["id"]: r["r"] for r in out.collect()}
        want, state = {}, {}
        for k, ts, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
            state[k] = v if k not in state else (state[k] + v if how == "sum" else max(state[k], v))
            want[i] = state[k]
        assert got == want


def test_row_numbers_descending(spark):
    rows = [(T0 + timedelta(hours=i % 50), i) for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id long")
    out = ordered.row_numbers(df, [F.col("ts").desc(), F.col("id")])
    got = {r["id"]: r["n"] for r in out.collect()}
    want = {i: n + 1 for n, (ts, i) in enumerate(sorted(rows, key=lambda r: (-r[0].timestamp(), r[1])))}
    assert got == want


def test_one_instant_with_most_rows_is_cut(spark):
    rows = [(T0 if i % 3 else T0 + timedelta(seconds=i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id long")
    order = [F.col("ts").asc(), F.col("id").asc()]
    sizes = [r["count"] for r in ordered.cut(df, order, ranges=10).groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 900
    got = {r["id"]: r["n"] for r in ordered.row_numbers(df, order).collect()}
    assert got == {i: n + 1 for n, (_, i) in enumerate(sorted(rows))}


def test_breaker_counts_failures_in_a_row(spark):
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", T0 + timedelta(minutes=i), i, rng.random() < 0.75) for i in range(600)]
    df = spark.createDataFrame(rows, "lane string, ts timestamp_ntz, event_id long, failed boolean")
    got = sorted(r["event_id"] for r in outages.breaker_trips(df, 6).collect())
    want, run = [], defaultdict(int)
    for lane, _, i, failed in rows:
        run[lane] = run[lane] + 1 if failed else 0
        if run[lane] == 6:
            want.append(i)
            run[lane] = 0
    assert got == sorted(want) and want


def test_rolling_spend_excludes_the_window_start(spark):
    rows = [(T0 + timedelta(minutes=30 * i), float(i % 7) / 4) for i in range(60)] + [(T0 + timedelta(hours=5), 2.5)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, cost_usd double")
    got = {r["ts"]: r["usd"] for r in ledger.rolling_spend(df, 5).collect()}
    want = {t: round(sum(v for s, v in rows if t - timedelta(hours=5) < s <= t), 6) for t, _ in rows}
    assert got == want


def test_costs_by_tier_prefix_and_default(spark):
    rows = [("gemini-2.5-pro", 200000, 10, 0, 0), ("gemini-2.5-pro", 200001, 10, 0, 0), ("gemini-2.5-flash-lite-001", 1000000, 0, 0, 0),
            ("gemini-2.5-flash", 100, 10, 200, 5), ("kimi", 1, 1, 0, 0)]
    df = spark.createDataFrame(rows, "m string, i long, o long, c long, t long")
    got = [r[0] for r in df.select(prices.estimate_cost(*[F.col(x) for x in "mioct"])).collect()]
    assert got == [0.2501, 0.500153, 0.1, pytest.approx((200 * 0.075 + 15 * 2.5) / 1e6, abs=1e-6), None]


def test_price_overrides(spark):
    merged = {n: (t, c) for n, t, c in prices.with_price_overrides({"gemini-2.5-pro": {"input": 1, "output": 2}, "x": 3, "own": {"tiers": [[10, 1, 1], [None, 2, 2]]}})}
    assert merged["gemini-2.5-pro"] == ([(None, 1, 2)], None) and "x" not in merged and merged["own"][0] == [(10, 1, 1), (None, 2, 2)]
    assert len(merged) == len(fv.PRICES) + 1


def calls(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, provider string, model string, purpose string, ref string, input_tokens long, output_tokens long, cost_usd double")


def test_refine_cost_needs_enough_priced_calls(spark):
    now = F.lit("2024-02-15").cast("timestamp_ntz")
    row = lambda day, cost: (datetime(2024, *day), "p", "m", "refine", "1", 1, 1, cost)
    month = [row((2, 1), 0.005)] * 20 + [row((1, 1), 9.0)]
    few = [row((2, 1), 0.5)] * 2
    three = [row((1, 1), 0.3)] * 3 + [row((1, 1), None)]
    per = lambda rows: ledger.refine_cost_per_page(calls(spark, rows), now).first()[0]
    assert (per(month), per(few), per(three)) == (0.005, None, pytest.approx(0.3))


def test_free_is_priced_and_missing_is_not(spark):
    c = calls(spark, [(T0, "ollama", "m", "x", "1", 1, 1, 0.0), (T0, "kimi", "k", "x", "1", 1, 1, None)])
    r = ledger.cost_by_ref(c).first()
    assert (r["calls"], r["cost_usd"], r["unpriced"]) == (2, 0.0, 1)
    assert [x[0] for x in ledger.unpriced_models(c).collect()] == ["k"]


def test_speed_table_keeps_a_window_per_mode(spark):
    rows = [(f"f{i}", "fast", T0 + timedelta(minutes=i), 4000, 1) for i in range(3)]
    rows += [(f"a{i}", "ai", T0 + timedelta(hours=1, minutes=i), 9000, 1) for i in range(420)] + [("l1", "local", T0, 1, 1)]
    df = spark.createDataFrame(rows, "id string, mode string, finished_at timestamp_ntz, duration_ms long, page_count long")
    got = {r["mode"]: (r["n"], r["sec_per_page"]) for r in library.speed_table(df).collect()}
    assert got == {"fast": (3, 4.0), "ai": (50, 9.0), "local": (1, None)}


def test_timeline_merges_neighbours_and_breaks_at_batches(spark):
    d = lambda day, h, m=0: datetime(2024, 1, day, h, m)
    done = spark.createDataFrame([("a", None, d(2, 9)), ("b", None, d(2, 8)), ("c", "B", d(2, 7)), ("e", None, d(2, 6)), ("f", None, d(1, 23))],
                                 "id string, batch_id string, updated_at timestamp_ntz")
    batches = spark.createDataFrame([("B", d(2, 7, 30)), ("empty", d(2, 1))], "batch_id string, updated_at timestamp_ntz")
    rows = library.timeline(done, batches).orderBy(F.col("updated_at").desc()).collect()
    assert [(str(r["day"])[-2:], r["is_batch"], r["docs"]) for r in rows] == [("02", 0, 2), ("02", 1, 1), ("02", 0, 1), ("01", 0, 1)]


def test_entry_names_count_repeats(spark):
    done = spark.createDataFrame([(f"id{i:08d}", "re:port.PDF" if i < 3 else "..x.docx" if i == 3 else ".pdf", T0 + timedelta(hours=-i)) for i in range(5)],
                                 "id string, filename string, created_at timestamp_ntz")
    got = {r["id"]: r["entry"] for r in library.unique_entry_names(done).collect()}
    assert list(got[f"id{i:08d}"] for i in range(5)) == ["re_port.md", "re_port (2).md", "re_port (3).md", "x.md", "id000000.md"]


PAGES = "job_id string, page int, markdown string"


def test_search_facts(spark):
    p = spark.createDataFrame([("a", 1, "# 标题"), ("a", 2, "这是鲁迅在《呐喊》自序里写的一段话。"), ("b", 1, "和鲁迅无关"),
                               ("one", 1, "Integration by parts"), ("many", 3, "integration, INTEGRATION, Integration"),
                               ("d", 1, "甲" * 80 + " **重点** " + "乙" * 80), ("n", 1, None)], PAGES)
    hit = search.search_hits(p, "鲁迅").filter("job_id = 'a'").first()
    assert (hit["page"], hit["match"]) == (2, "鲁迅") and "这是鲁迅在《呐喊》自序" in hit["before"] + hit["match"] + hit["after"]
    assert [tuple(r) for r in search.search(p, " INTEGRATION ").collect()] == [("many", 3), ("one", 1)]
    assert search.search_hits(p, "integration").filter("job_id = 'one'").first()["match"] == "Integration"
    long = search.search_hits(p, "重点").first()
    assert long["before"].startswith("…") and long["after"].endswith("…") and "*" not in long["before"] + long["after"]
    assert search.search(p, "鲁").count() == 0 and search.search(p, "周树人").count() == 0


def test_word_search_and_read(spark):
    jobs = spark.createDataFrame([("x", "Heat.pdf", None, None, '["physics"]', T0), ("y", "other.pdf", None, None, None, T0)],
                                 "id string, filename string, ai_title string, ai_one_line string, tags string, created_at timestamp_ntz")
    p = spark.createDataFrame([("x", 1, "latent heat"), ("x", 2, "Heat again"), ("y", 1, "derivative heat")], PAGES)
    both = search.word_search(jobs, p, ["HEAT", "physics"]).collect()
    assert [(r["id"], r["score"]) for r in both] == [("x", 52)]
    some = {r["id"]: r["score"] for r in search.word_search(jobs, p, ["heat", "derivative"], match_any=True).collect()}
    assert some == {"x": 52, "y": 2}
    assert search.top_scores(search.word_search(jobs, p, ["heat"]), 1).first()["total"] == 2
    assert search.read_window(p, "again").first()["page"] == 2
    assert search.read_page(p, "x", 9).first()["page"] == 1


def test_prefixes(spark):
    ids = spark.createDataFrame([("abcd1",), ("abcd2",), ("xyz99",)], "id string")
    refs = spark.createDataFrame([("ABCD",), ("abcd1",), ("xyz",), ("xyz9",), ("nope",)], "ref string")
    got = {r["ref"]: r["id"] for r in search.resolve_prefixes(ids, refs).collect()}
    assert got == {"abcd": None, "abcd1": "abcd1", "xyz9": "xyz99", "nope": None}


def test_find_drops_unknown_and_repeated_numbers(spark):
    cat = spark.createDataFrame([(1, "a"), (2, "b")], "n long, id string")
    a = spark.createDataFrame([("q", 0, "2", "w"), ("q", 1, "9", "w"), ("q", 2, "2", "x"), ("q", 3, "1", "y" * 90), ("q", 4, "z", "")],
                              "question string, position int, n string, why string")
    rows = search.find_results(a, cat).orderBy("rank").collect()
    assert [(r["id"], r["why"]) for r in rows] == [("b", "w"), ("a", "y" * 60 + "…")]


def test_find_with_an_injected_model(spark):
    done = spark.createDataFrame([("a", T0, "f.pdf", None, None, None, 3)], "id string, created_at timestamp_ntz, filename string, ai_title string, ai_one_line string, tags string, page_count long")
    ask = lambda q, lines: lines.select(F.lit(q).alias("question"), F.lit(0).alias("position"), F.col("n").cast("string").alias("n"), F.col("line").alias("why"))
    assert search.find("which?", done, ask).first()["id"] == "a"
    with pytest.raises(ValueError):
        search.find("  ", done, ask)


def test_catalog_in_short_keeps_titles_only(spark):
    done = spark.createDataFrame([(f"i{k}", T0 - timedelta(hours=k), "f.pdf", f"T|{k}", "one line", '["t"]', 2) for k in range(12)],
                                 "id string, created_at timestamp_ntz, filename string, ai_title string, ai_one_line string, tags string, page_count long")
    full = [r["line"] for r in search.catalog(done).orderBy("n").collect()]
    assert full[0] == "1 | 2024-01-01 | T 0 | one line | t | f.pdf | 2页"
    assert search.catalog(done, full=False).orderBy("n").first()["line"] == "1 | 2024-01-01 | T 0 |  |  | f.pdf | 2页"


def test_months_ago_clamps():
    at = lambda *a: datetime(*a)
    assert reflect.months_ago(at(2026, 3, 31, 5), 1) == at(2026, 2, 28, 5)
    assert reflect.months_ago(at(2024, 3, 31), 1) == at(2024, 2, 29)
    assert reflect.months_ago(at(2026, 1, 15), 12) == at(2025, 1, 15)
    assert reflect.months_ago(at(2026, 1, 15), 1) == at(2025, 12, 15)


def topic_oracle(items):
    freq, first = defaultdict(float), {}
    for n, (w, tags) in enumerate(items):
        for pos, t in enumerate(tags):
            freq[t] += w / len(tags)
            first.setdefault(t, (n, pos))
    rank = {t: i for i, t in enumerate(sorted(freq, key=lambda t: (-round(freq[t], 9), first[t])))}
    weight, count, seen = Counter(), Counter(), {}
    for n, (w, tags) in enumerate(items):
        t = min(tags, key=rank.get)
        weight[t] += w
        count[t] += 1
        seen.setdefault(t, n)
    order = sorted(weight, key=lambda t: (-weight[t], seen[t]))
    rows = [(t, weight[t], count[t]) for t in order[:5]]
    if order[5:]:
        rows.append(("__other__", sum(weight[t] for t in order[5:]), sum(count[t] for t in order[5:])))
    total = sum(weight.values())
    pct = [int(100 * r[1] / total + 0.5) for r in rows]
    pct[0] += 100 - sum(pct)
    return [(*r, max(p, 0)) for r, p in zip(rows, pct)]


@pytest.mark.parametrize("seed", range(3))
def test_topics_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(rng.choice([1, 2, 5]), rng.sample("abcdefgh", rng.choice([1, 2, 4]))) for _ in range(60)]
    rows = [(f"i{k:03d}", T0 + timedelta(minutes=k), w, "[" + ",".join(f'"{t}"' for t in tags) + "]") for k, (w, tags) in enumerate(items)]
    done = spark.createDataFrame(rows, "id string, created_at timestamp_ntz, page_count long, tags string")
    got = [tuple(r)[1:] for r in reflect.topics(done, reflect.Period.of("1m", datetime(2024, 1, 20))).orderBy("rank").collect()]
    assert got == topic_oracle(items)


def test_fingerprint_follows_titles_and_tags(spark):
    period = reflect.Period.of("1m", datetime(2024, 1, 20))
    make = lambda title, tags: spark.createDataFrame(
        [("a", T0, "f.pdf", title, tags), ("b", T0, "g.pdf", None, None)], "id string, created_at timestamp_ntz, filename string, ai_title string, tags string")
    fp = lambda *a: reflect.fingerprint(make(*a), period).first()["fingerprint"]
    assert fp("t", '["x"]') == fp("t", '["x"]') and len({fp("t", '["x"]'), fp("u", '["x"]'), fp("t", '["y"]')}) == 3


def test_local_time_moves_days(spark):
    done = spark.createDataFrame([("a", datetime(2024, 1, 1, 23), 1)], "id string, created_at timestamp_ntz, page_count long")
    assert str(reflect.localised(done, "Asia/Tokyo").first()["created_at"]) == "2024-01-02 08:00:00"


def test_index_refresh(spark):
    done = spark.createDataFrame([("keep", 1), ("changed", 2), ("new", 1)], "id string, updated_at int")
    index = spark.createDataFrame([("keep", 1), ("changed", 1), ("gone", 1)], "id string, stamp int")
    actions = library.reconcile_index(index, done)
    assert {r["id"]: r["action"] for r in actions.collect()} == {"keep": "keep", "changed": "reload", "gone": "drop", "new": "load"}
    old = spark.createDataFrame([("keep", 1, "o"), ("changed", 1, "o"), ("gone", 1, "o")], PAGES)
    fresh = spark.createDataFrame([(i, 1, "n") for i in ("keep", "changed", "new")], PAGES)
    got = {r["job_id"]: r["markdown"] for r in library.refresh_index(old, actions, fresh).collect()}
    assert got == {"keep": "o", "changed": "n", "new": "n"}
