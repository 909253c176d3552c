"""The training-data operators against brute force, libraries and round trips, and on
nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quire import session
from quire.llm import chat, compression_score, decontamination, html_crf, language_model, license_scan, near_dedup, piece_bpe, quality_rules, sharding

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SHAPE = "doc_id long, text string, lang string, kept string, SCORE string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null key, null text, empty text, repeated rows, a long text, clashing columns."""
    words = " ".join(f"w{i % 977}x" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "one two three"), (4, words), (5, " \n\t"), (6, "é" * 3000)]
    return spark.createDataFrame([(i, t, "en", "mine", "s") for i, t in rows], SHAPE)


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_operators_keep_rows_and_replace_clashing_columns(spark, odd):
    model = compression_score.Model(b"good text " * 30, b"bad $$$ " * 30, 1.0, 0.0)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    made = [
        quality_rules.apply_rules(odd), decontamination.decontaminate(odd, bench), piece_bpe.encode(odd, MODEL), compression_score.score(odd, model),
        license_scan.scan(odd), near_dedup.near_duplicates(odd), sharding.shuffle_shards(odd, shards=3),
    ]
    for df in made:
        assert bag(df, "doc_id", "text", "lang") == bag(odd, "doc_id", "text", "lang")
        assert len({c.lower() for c in df.columns}) == len(df.columns)
    for df in made:
        if df is not made[0] and df is not made[5]:
            assert {r[0] for r in df.select("kept").collect()} == {"mine"}


def test_operators_on_empty_tables(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = compression_score.fit(none, labels)
    for df in (
        quality_rules.apply_rules(none), decontamination.decontaminate(none, bench), piece_bpe.encode(none, MODEL), compression_score.score(none, model),
        license_scan.scan(none), near_dedup.near_duplicates(none), sharding.shuffle_shards(none), language_model.score(none, language_model.fit(none)),
        html_crf.extract(none.withColumnRenamed("text", "html"), html_crf.fit(none.withColumnRenamed("text", "html"))),
        chat.read_back(chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    ):
        assert df.count() == 0


# Chat ---------------------------------------------------------------------


def test_escape_round_trip():
    rng = random.Random(3)
    parts = ["\\", "<", "|", "<|", "</s>", "[INST]", "[/INST]", "a", "<s", ">", "[", "<|end|>", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)


@pytest.mark.parametrize("budget,history", [(30, 2), (60, 0), (1000, 3)])
def test_windows_hold_every_turn_once_within_budget(spark, budget, history):
    rng = random.Random(budget)
    rows, want = [], {}
    for c in [None, *range(30)]:
        turns = [("system", "be <|end|> kind")] if rng.random() < 0.5 else []
        for _ in range(rng.randrange(1, 12)):
            turns += [("user", " ".join("q" * rng.randrange(1, 9))), ("assistant", rng.choice([None, "", "a b", "</s>[INST] x " * 3]))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
        want[c] = [(r, t or "") for r, t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = collections.defaultdict(list)
    for r in chat.format_windows(df, budget, history).collect():
        windows[r["conv_id"]].append(r)
    assert set(windows) == set(want)
    for c, found in windows.items():
        found.sort(key=lambda r: r["window"])
        got, targets = [], []
        for r in found:
            everything = chat.read_turns(r["formatted"])
            got += everything[r["n_context"] :]
            targets += [chat.unescape(r["formatted"][s["start"] : s["stop"]]) for s in r["loss"]]
            assert r["over_budget"] == (r["n_tokens"] > budget)
            assert not r["over_budget"] or len(everything) - r["n_context"] == 1
            if r["window"] and want[c][0][0] == "system":
                assert everything[0] == want[c][0]
        assert got == want[c]
        assert targets == [t for r, t in want[c] if r == "assistant" and t]


# Quality rules --------------------------------------------------------------


def brute_repeats(words):
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_repeated_words_by_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        words = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        assert quality_rules.repeated_words(words) == brute_repeats(words)


def test_order_changes_work_not_verdict(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r["kept"] for r in quality_rules.apply_rules(docs).collect()}
    for r in docs.collect():
        t = quality_rules.Text(r["text"])
        assert found[r["doc_id"]] == (not any(rule.rejects(t) for rule in quality_rules.RULES))


# Sharding -------------------------------------------------------------------


def test_shards_are_even_gapless_and_repeatable(spark, tmp_path):
    rows = [(7 if i % 3 else i, f"text {i}") for i in range(1000)]  # one key has two thirds of the rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = sharding.shuffle_shards(df, shards=7, bucket_bytes=2000)
    got = placed.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
    sizes = collections.Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    again = sharding.shuffle_shards(df, shards=7, bucket_bytes=2000).collect()
    assert {(r["text"], r["shard"], r["slot"]) for r in got} == {(r["text"], r["shard"], r["slot"]) for r in again}
    sharding.write_shards(placed, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1000


# Decontamination -------------------------------------------------------------


def brute_hits(words, items, k):
    hit, found = set(), set()
    for item_id, item in items:
        n = min(k, len(item))
        for j in range(len(item) - n + 1) if item else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == item[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(item_id)
    return hit, found


def test_automaton_by_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        items = [(str(i), [rng.choice("abc") for _ in range(rng.randrange(9))]) for i in range(rng.randrange(6))]
        words = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        spans, found = decontamination.SuffixAutomaton(items, 4).match(words)
        hit, names = brute_hits(words, items, 4)
        assert {i for a, b in spans for i in range(a, b)} == hit
        assert found == names


def test_blocks_of_items_give_the_same(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    one = decontamination.decontaminate(docs, bench)
    many = decontamination.decontaminate(docs, bench, block_words=500)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert one.filter("contaminated").count()


def test_cut_removes_the_spans():
    assert decontamination.cut("Keep A, b c! keep", [(1, 4)]) == "Keep ! keep"


# SentencePiece ---------------------------------------------------------------


def test_ids_and_texts_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    cases = ["", " ", "\n", "a" * 3000, " " * 100 + "x", "日本語 😀👍🏽", "<0x41> <s> </s> <unk>", "▁▁a ▁", "\x00\x01", "ab" * 2000, "x" * 40 + " " * 17]
    cases += [" " * n + tail for n in range(14, 52) for tail in ("", "the", "\x07", "\n")]
    cases += ["".join(rng.choice("aabbc thein▁ \n\t0189éß漢😀.,-_") for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    ids, offsets = (encoder := piece_bpe.Encoder(MODEL)).encode(cases)
    texts = piece_bpe.decode_flat(encoder.vocab, ids, offsets)
    for i, case in enumerate(cases):
        want = library.encode(case)
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want
        assert texts[i] == library.decode(want)


def test_full_cache_and_foreign_ids(spark):
    encoder = piece_bpe.Encoder(MODEL, cache_words=3)
    for text in ("one two three four five", "six seven one two", "one"):
        assert encoder.encode([text])[0].tolist() == encoder.vocab.library.encode(text)
    ids = [[300, 5, 250, 400], [], None, [3, 4], [28705, 28705]]
    df = spark.createDataFrame([(x,) for x in ids], "ids array<int>")
    assert [r["decoded"] for r in piece_bpe.decode(df, MODEL).collect()] == [encoder.vocab.library.decode(x or []) for x in ids]


# HTML ------------------------------------------------------------------------


def test_main_text_of_known_and_unseen_markup(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    chain = html_crf.fit(pages)
    for r in html_crf.extract(pages, chain).collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html_crf.html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?(?:p|h1|br)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])
    unseen = (
        '<body><div class="top-menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></div><div class="cookie-notice"><p>We use cookies.</p></div>'
        '<div class="post-content"><h1>A  title</h1><p>First &amp; best <b>text</b>\nof the page, which goes on for a while.</p><p>Second paragraph of the text, also long.</p></div>'
        '<aside class="sidebar"><p>Read this too</p></aside><section id="comments"><p>I liked it a lot.</p></section><form><p>Your mail</p></form>'
        '<div class="footer">&copy; Someone</div><script>x="<p>no</p>"</script>'
    )
    assert html_crf.main_text(chain, unseen)[0] == "A title\nFirst & best text of the page, which goes on for a while.\nSecond paragraph of the text, also long."


def test_chain_decodes_the_best_sequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        chain = html_crf.Chain({f"f{i}": float(x) for i, x in enumerate(rng.normal(size=n))}, tuple(map(tuple, rng.normal(size=(2, 2)).tolist())))
        score = lambda y: sum(chain.weight[f"f{i}"] for i in range(n) if y[i]) + sum(chain.pair[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(([int(b) for b in f"{k:0{n}b}"] for k in range(2**n)), key=score)
        assert chain.labels([[f"f{i}"] for i in range(n)]) == best


def test_pages_without_content():
    for page in ("", "<p></p>", "<script>x</script>", "<div hidden><p>a</p></div>", "<!-- a", "<p", "</p></div>"):
        assert html_crf.main_text(html_crf.prior(), page)[0] in ("", "<p")


@pytest.mark.parametrize(
    "attr,seen",
    [('class="post overflow-hidden"', 1), ('class="md:block hidden-xs"', 1), ('aria-hidden="false"', 1), ('data-hidden="0"', 1), ('id="the-hidden-valley"', 1),
     ('title="a hidden b" data-x=hidden', 1), ('hidden="until-found"', 1), ('style="x-display: none"', 1), ("class='hidden'", 1), ("hidden", 0), ('HIDDEN=""', 0),
     ('id=a hidden="hidden"', 0), ("aria-hidden=true", 0), ('style="color:red; display : none"', 0), ("hidden/", 0)],
)
def test_only_attributes_that_hide_drop_text(attr, seen):
    assert [b.text for b in html_crf.blocks(f"<body><div {attr}><p>Text.</p></div><p>Rest.</p></body>")] == ["Text."] * seen + ["Rest."]


def test_embedded_elements_end_where_they_should():
    def found(page):
        return [b.text for b in html_crf.blocks(page)]

    assert found('<article><h1>T <svg class="icon"/></h1><p>First paragraph.</p><p>Second.</p></article>') == ["T", "First paragraph.", "Second."]
    for name in html_crf.UNSEEN - {"head"}:
        assert found(f"<div><p>a <{name} x='1'>no <i>no</i></{name}> b</p><p>c</p></div>") == ["a b", "c"], name
        assert found(f"<div><p>a <{name} x='1'/> b</p><p>c</p></div>") == ["a b", "c"], name
        assert found(f"<article><div>a <{name}>no <p>no</p></div><p>b</p></article><p>c</p>") == ["a", "b", "c"], name
    assert found("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>") == ["Let x=2 hold."]
    assert found("<svg><title/><path/><style/></svg><p>a</p>") == ["a"]
    assert found("<p>a</p><script>x='<p>no</p>'</script><style/>no</style><textarea><p>no</textarea><p>b</p>") == ["a", "b"]
    assert found("<head><meta x><title>no</title><link y><p>a</p>") == found("<html><head><noscript>no<body><p>a</p></body>") == found("<head><title>no</title> a") == ["a"]
    assert html_crf.blocks("<div class='c'>a <svg>no</div>b")[0].above == ("tag=div", "name=c")


# Classifier ------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = compression_score.fit(docs, labels.filter(~held))
    got = compression_score.score(docs, model).join(labels, "doc_id").filter(held).select("score", "predicted", "quality").collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.93


def test_one_class_gives_its_share(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for label, least, most in ((1, 0.99, 1), (0, 0, 0.5)):
        model = compression_score.fit(docs, spark.createDataFrame([(1, label), (2, None)], "doc_id long, quality int"))
        assert all(least <= r["score"] <= most for r in compression_score.score(docs, model).collect())


# Licences --------------------------------------------------------------------


def test_notices_are_found_whole_and_damaged():
    scanner = license_scan.Scanner()
    rng = random.Random(4)
    filler = [f"word{i}" for i in range(500)]
    for name, notice in license_scan.NOTICES:
        for _ in range(5):
            before, after = (rng.choices(filler, k=rng.randrange(80)) for _ in range(2))
            found = scanner.scan([*before, *license_scan.words_of(notice), *after])
            assert name in {scanner.names[i] for i, *_ in found}, notice
    assert scanner.scan(rng.choices(filler, k=3000)) == []
    assert scanner.scan(license_scan.words_of("licensed under the terms of the public road")) == []


def test_notices_side_by_side_are_all_found():
    scanner = license_scan.Scanner()

    def found(text):
        return [(scanner.names[i], a, b, c) for i, a, b, c in sorted(scanner.scan(license_scan.words_of(text)), key=lambda m: m[1])]

    gpl = "This work is licensed under the GNU General Public License, version 2"
    assert found(f"Licensed under the Apache License, Version 2.0. {gpl}") == [("Apache-2.0", 0, 8, 1.0), ("GPL-2.0", 8, 20, 1.0)]
    assert found("Licensed under the Apache License, Version 2.0 or licensed under the BSD 3-Clause License") == [("Apache-2.0", 0, 8, 1.0), ("BSD-3-Clause", 9, 16, 1.0)]
    assert found(f"licensed under the x y z {gpl}. {gpl}") == [("GPL-2.0", 6, 18, 1.0), ("GPL-2.0", 18, 30, 1.0)]
    rng = random.Random(7)
    one = {}
    for name, text in license_scan.NOTICES:
        one[text] = {m[0] for m in found(text)}
        assert one[text] == {name}
    for _ in range(400):
        texts = [rng.choice(license_scan.NOTICES)[1] for _ in range(rng.randrange(2, 5))]
        assert {m[0] for m in found(rng.choice((". ", " or ", " and also ")).join(texts))} >= set().union(*(one[t] for t in texts)), texts


def test_damaged_notices_at_every_place_and_agpl():
    scanner = license_scan.Scanner()
    names = lambda words: {scanner.names[i] for i, *_ in scanner.scan(words)}
    gpl = license_scan.words_of(dict(license_scan.NOTICES)["GPL"])
    for start in range(70):
        assert names(["x"] * start + gpl[:12] + ["y"] * 12 + gpl[12:] + ["x"] * 40) == {"GPL"}, start
    at = gpl.index("general")
    assert names([*gpl[:at], "affero", *gpl[at:]]) == {"AGPL"}


def test_band_count_keeps_its_promise():
    for s in (0.2, 0.5, 0.9):
        assert (1 - s**2) ** license_scan.band_count(s, 2, 1e-6) <= 1e-6


# Language model --------------------------------------------------------------


def test_base_score_counts_and_model(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    model = language_model.fit(docs.filter(~held), share=1e-3)  # most words are rare: the joined part is at work
    got = {r["doc_id"]: r for r in language_model.score(docs, model).collect()}
    words = {r["doc_id"]: language_model.tokens(r["text"] or "") for r in docs.collect()}
    counts = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    total = sum(counts.values())
    assert model.total == total and model.distinct == len(counts)
    one = {w: math.log10((c - model.word_discount) / total) for w, c in counts.items()}
    for i, ws in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"]) == (len(ws), sum(w in counts for w in ws))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in ws))
        read, _, rare = model.automaton.read(ws)
        assert r["score"] == pytest.approx(read + sum(one.get(w, model.unknown) for w in rare))


@pytest.mark.parametrize("fast", [1e-6, 0.05, 1.0])
def test_every_ngram_is_kept_at_any_input_size(spark, monkeypatch, fast):
    monkeypatch.setattr(language_model, "FAST", fast)  # decides what is sent, never a value
    rng = random.Random(6)
    texts = [" ".join(rng.choice("aaabbcdefg") for _ in range(rng.randrange(9))) for _ in range(60)] + ["once seen " + "w" * 300, None]
    seen = [language_model.tokens(t or "") for t in texts]
    counts = [collections.Counter(tuple(ws[i : i + k]) for ws in seen for i in range(len(ws) - k + 1)) for k in (1, 2, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = language_model.fit(docs)
    for k in (2, 3):
        assert model.tables.grams[k].count() == len(counts[k - 1])
    total = sum(counts[0].values())

    def prob(gram):
        c = counts[len(gram) - 1][gram]
        if len(gram) == 1:
            return (c - model.word_discount) / total if c else 10**model.unknown
        after = [g for g in counts[len(gram) - 1] if g[:-1] == gram[:-1]]
        if not after:
            return prob(gram[1:])
        n = sum(counts[len(gram) - 1][g] for g in after)
        if c:
            return (c - 0.75) / n
        return max(0.75 * len(after) / n, 1e-12) / max(1 - sum(prob(g[1:]) for g in after), 1e-12) * prob(gram[1:])

    asked = [*texts, "g f e d c b a", "once seen never", "never once", "a a a a a"]
    got = language_model.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    assert len(got) == len(asked)
    for r in got:
        ws = language_model.tokens(asked[r["doc_id"]] or "")
        assert r["score"] == pytest.approx(sum(math.log10(prob(tuple(ws[max(0, i - 2) : i + 1]))) for i in range(len(ws))))
        assert (r["n_tokens"], r["n_known"]) == (len(ws), sum((w,) in counts[0] for w in ws))


def test_buckets_and_their_size_give_the_same(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    words = [f"w{rng.randrange(40) ** 2 // 8}" for _ in range(3000)]
    texts = [" ".join(words[i : i + 1 + i % 40]) for i in range(0, 3000, 20)] + ["", None, "w0 unseen w0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    for bucket, most, chunk in ((1 << 19, 200_000, 4_000_000), (60, 200_000, 300), (60, 10, 300)):
        monkeypatch.setattr(language_model, "BUCKET", bucket)  # small: common words have many buckets
        monkeypatch.setattr(language_model, "WORDS", most)
        monkeypatch.setattr(language_model, "CHUNK", chunk)
        model = language_model.fit(docs.filter("doc_id % 3 > 0"))
        assert (model.tables.deal.parts > 1).any() == (bucket == 60)
        got = language_model.score(docs, model).collect()
        seen.append({r["doc_id"]: tuple(r)[1:] for r in got})
        assert len(got) == len(texts)
    for other in seen[1:]:
        for i, values in seen[0].items():
            assert other[i][:2] == values[:2]
            assert other[i][2:] == pytest.approx(values[2:])


def test_whole_model_takes_few_bytes_an_ngram(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(100)]
    language_model.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 12 * 40_000  # nearly all are seen once


def test_backoff_probabilities_sum_to_one():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(12)]
    ids = rng.choice(12, 4000, p=np.arange(1, 13) / 78)
    counts = np.bincount(ids, minlength=12)
    levels, grams = [], []
    for _ in range(2):
        part = language_model.positions(ids, levels, 12)
        ok = (part[:-1] >= 0) & (part[1:] >= 0)
        codes, n = np.unique((part[:-1] * 12 + ids[1:])[ok], return_counts=True)
        grams.append((codes[n >= 12], n[n >= 12]))
        levels.append(grams[-1][0])
    a = language_model.build(words, counts, len(ids), grams, 0.7)
    unknown = 0.7 * 12 / len(ids)
    contexts = [[], *([w] for w in words), *([u, v] for u in words for v in words)]
    for context in contexts:
        total = sum(10 ** (a.read([*context, w])[0] - a.read(context)[0]) for w in words) + 10 ** (a.read([*context, "?"])[0] - a.read(context)[0]) * unknown
        assert total == pytest.approx(1, abs=2e-3)  # heads at the very end of the text have no follower


# Near duplicates -------------------------------------------------------------


def brute_components(rows, shingle, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        k = min(shingle, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("shingle", [2, 5])
def test_components_by_brute_force(spark, shingle):
    rng = random.Random(shingle)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice((3, 30, 120)))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "solo"), (3, "Solo")]
    for i in range(4, 160):  # copies with more and more changes: many pairs are near the threshold
        words = list(base[rng.randrange(12)])
        for _ in range(rng.choice((0, 0, 1, 2, 4, 6, 9))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.judged(df, shingle=shingle).collect()}
    assert got == brute_components(rows, shingle, 80)


def test_null_ids_and_least_matches(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "z y x w v u")], "doc_id long, text string")
    assert bag(near_dedup.near_duplicates(df), "doc_id", "component_id", "kept") == {(None, 5, False): 1, (5, 5, True): 1, (None, None, True): 1}
    m = near_dedup.least_matches(64, 0.8, 1e-6)
    below = sum(math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(m))
    assert below <= 1e-6 < below + math.comb(64, m) * 0.8**m * 0.2 ** (64 - m)
