"""File names, addresses, labels, keys, answers."""

from pyspark.sql import functions as F

from quire.functions import answers, files, labels

C = F.col


def col(spark, expr, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_kinds(spark):
    assert col(spark, files.file_kind(C("v")), ["a.PDF", "b.docx", "c.HEIC", "d.md", "e.txt", "noext", "x.png.zip"]) == [
        "pdf", "office", "image", "markdown", "other", "other", "other"]
    heads = [bytes.fromhex(h) for h in ("89504e470d0a1a0a00", "ffd8ffe0", "4749463839", "424d00", "49492a00", "4d4d002a", "52494646aaaaaaaa57454250",
                                        "00000018667479706d696631", "504b0304", "d0cf11e0a1b11ae1", "25504446", "00")]
    assert col(spark, files.magic_kind(C("v")), heads, "binary") == [
        "PNG", "JPEG", "GIF", "BMP", "TIFF-LE", "TIFF-BE", "WEBP", "ISO-BMFF", "ZIP", "OLE", "PDF", "unknown"]


def test_names(spark):
    assert col(spark, files.strip_source_extension(C("v")), ["报告.docx", "a.pdf.pdf", "b.txt", None]) == ["报告", "a.pdf", "b.txt", ""]
    assert col(spark, files.safe_entry_name(C("v"), F.lit("id")), ["a/b\\c:d.pdf", "...pdf", ".docx", " x .png"]) == ["a_b_c_d", "id", "id", "x"]
    parts = col(spark, files.decode_part_name(C("v")), ["0007-%E4%BD%A0+%2B.png", "0010-IMG_10.HEIC", "abcd-%E4%"])
    assert [tuple(p) for p in parts] == [(7, "你++.png"), (10, "IMG_10.HEIC"), (0, "%E4%")]
    names = ["IMG_10.png", "img_2.png", "IMG_02b", "a"]
    keys = col(spark, files.natural_key(C("v")), names)
    assert [n for _, n in sorted(zip(keys, names))] == ["a", "img_2.png", "IMG_02b", "IMG_10.png"]


def test_titles(spark):
    df = spark.createDataFrame([("a__b_.pdf", " T ", False), ("a__b_.pdf", "T", True), ("x.pdf", "", False), ("?.pdf", None, None)], "f string, t string, m boolean")
    title = files.record_title(C("f"), C("t"), C("m"))
    name = files.download_name(C("f"), C("t"), C("m"), F.lit("2024-01-01"), "md")
    assert [tuple(r) for r in df.select(title, name).collect()] == [
        ("T", "T 2024-01-01.md"), ("a b", "a__b_ 2024-01-01.md"), ("x", "x 2024-01-01.md"), ("?", "document 2024-01-01.md")]


def test_addresses(spark):
    links = ["#top", "https://a.b/c", " HTTP://a.b ", "mailto:x@y", "javascript:alert(1)", "java\tscript:x", "/rel", "file:///x", "data:x", None, "https://"]
    assert col(spark, files.safe_link(C("v")), links) == ["#top", "https://a.b/c", "HTTP://a.b", "mailto:x@y"] + [None] * 7
    imgs = ["data:image/png;base64,AA==", "data:image/svg+xml;base64,AA==", "https://x/y.png", "DATA:IMAGE/JPEG;BASE64,aa"]
    assert col(spark, files.safe_image(C("v")), imgs) == [imgs[0], None, None, imgs[3]]
    assert col(spark, files.escape_html(C("v")), ["<a href='x'>&\"</a>"]) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"]
    df = spark.createDataFrame([("LOCALHOST:1", None), ("localhost:1", "http://localhost:3000"), ("evil:1", None), ("localhost:1", "null")], "h string, o string")
    got = [r[0] for r in df.select(files.foreign_reason(C("h"), C("o"), 1)).collect()]
    assert got == [None, None, "Host「evil:1」不是本机地址", "来源「null」不是本机页面"]


def test_keys(spark):
    assert col(spark, files.split_keys(C("v")), [" a, b\n\nc ", None]) == [["a", "b", "c"], []]
    assert col(spark, files.masked_key(C("v")), ["secret1234", "", None]) == ["••••••••1234", "", ""]
    rows = [(["__KEEP__:1:BBBB", "__KEEP__:2:CCCC"],), (["__KEEP__:0:CCCC", "new", "new", " "],), ([],), (None,), (["__KEEP__:0:ZZZZ"],), (["__KEEP__"],)]
    df = spark.createDataFrame(rows, "e array<string>")
    got = [r[0] for r in df.select(files.merge_keys(C("e"), F.lit("xAAAA,xBBBB,xCCCC"))).collect()]
    assert got == [["xBBBB", "xCCCC"], ["xCCCC", "new"], [], ["xAAAA", "xBBBB", "xCCCC"], [], ["xAAAA"]]
    df = spark.createDataFrame([(401, ""), (400, "api_key_invalid"), (400, "x"), (429, "permission")], "s int, m string")
    assert [r[0] for r in df.select(files.key_rejected(C("s"), C("m"))).collect()] == [True, True, False, False]


def test_labels(spark):
    assert col(spark, labels.size_label(C("v")), [1, 1536, 3 * 1024 * 1024], "long") == ["1 KB", "2 KB", "3.0 MB"]
    assert col(spark, labels.big_number(C("v")), [999, 12345, 2500000], "long") == ["999", "12.3K", "2.5M"]
    assert col(spark, labels.usd_label(C("v")), [0.0, 0.0012, 0.25, 3.0], "double") == ["$0", "$0.0012", "$0.250", "$3.00"]
    assert col(spark, labels.elapsed_label(C("v")), [5400, 64000, 3720000], "long") == ["5s", "1m 04s", "1h 02m"]
    assert col(spark, labels.pace_label(C("v")), [0.25, 15.4, 90.0], "double") == ["0.3 s/page", "15 s/page", "1.5 min/page"]
    assert col(spark, labels.nice_ceiling(C("v")), [0, 7, 10, 11, 900], "long") == [1, 8, 10, 20, 1000]
    df = spark.createDataFrame([(None, 0, 0), (0.5, 3, 0), (0.0, 3, 3), (0.5, 3, 1)], "c double, n int, u int")
    assert [r[0] for r in df.select(labels.cost_label(C("c"), C("n"), C("u"))).collect()] == [None, "$0.500", "未计价", "$0.500（1 次未计价）"]
    df = spark.createDataFrame([(3, 30, 21000, 9.0), (2, 30, 21000, 9.0), (3, 30, 20000, None), (0, 0, 99999, 9.0)], "d int, t int, e int, s double")
    assert [r[0] for r in df.select(labels.eta_seconds(*[C(c) for c in "dtes"])).collect()] == [189, 252, None, None]


def test_sizes(spark):
    df = spark.createDataFrame([(1684, 842), (100, 50), (0, 0), (8000, 2)], "w int, h int")
    assert [tuple(r[0]) for r in df.select(labels.page_fit(C("w"), C("h"))).collect()] == [(842.0, 421.0), (100.0, 50.0), (1.0, 1.0), (842.0, 1.0)]
    assert [tuple(r[0]) for r in df.select(labels.downscale(C("w"), C("h"))).collect()] == [(1684, 842), (100, 50), (1, 1), (4000, 1)]


def test_lanes(spark):
    df = spark.createDataFrame([("gemini", 3, 2), ("gemini", 0, 0), ("claude", 1, 1), ("new", 1, 1)], "p string, n int, k int")
    assert [r[0] for r in df.select(labels.lane_weight(C("p"), C("n"), C("k"))).collect()] == [12, 6, 20, 6]
    df = spark.createDataFrame([(["claude", "qwen"], []), (["claude"], ["qwen", "gemini"]), (["claude"], []), (["kimi"], [])], "p array<string>, c array<string>")
    assert [r[0] for r in df.select(labels.stand_in(C("p"), C("c"))).collect()] == [["qwen"], ["gemini"], ["claude"], ["kimi"]]


def test_page_answers(spark):
    raw = ['```json\n{"markdown":" x ","noText":false,"formulaCount":2.6,"uncertain":["a",""]}\n```', 'Sure: {"markdown":"","note":"photo"} ok', '{"markdown":""}', "nothing", None]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    a = [r["answer"] for r in answers.page_answers(df, C("raw")).collect()]
    assert (a[0]["markdown"], a[0]["formula_count"], a[0]["uncertain"], a[0]["error"]) == ("x", 3, ["a"], None)
    assert a[1]["no_text"] and a[1]["note"] == "photo" and a[1]["error"] is None
    assert a[2]["error"] == "模型返回了空白 Markdown。" and a[3]["error"] == a[4]["error"] == "模型没有返回有效 JSON。"


def test_card_and_find_answers(spark):
    df = spark.createDataFrame([('{"tags":[" a ","","bbbbbbbbbbbbbbbbbbbbbbbbbbbbbb","c","d","e"],"title":"","filename_meaningful":"x"}',), ('{"tags":[]}',)], "raw string")
    c = [r["card"] for r in answers.card_answers(df, C("raw")).collect()]
    assert c[0]["tags"] == ["a", "b" * 24, "c", "d"] and c[0]["title"] is None and c[0]["filename_meaningful"] is None and len(c) == 1
    df = spark.createDataFrame([("q1", 'Here: {"results":[{"n":3,"why":"w"},{"n":"1"}]} done'), ("q2", "no"), ("q3", "{bad}")], "q string, raw string")
    rows = answers.find_picks(df, C("raw")).orderBy("q", "position").collect()
    assert [(r["q"], r["n"]) for r in rows] == [("q1", "3"), ("q1", "1"), ("q2", None), ("q3", None)]
    assert rows[2]["error"] == "模型没有返回 JSON：no" and rows[3]["error"] == "模型返回的 JSON 解析不了"


def test_command_steps(spark):
    df = spark.createDataFrame([('python /x/look.py search "latent heat" --any --n 5',), ("look read ab12 --page 3",), ("rm -rf /",), ("look fly",)], "v string")
    got = [r["step"] for r in answers.command_steps(df, C("v")).collect()]
    assert [tuple(g) if g else None for g in got] == [("search", ["latent heat"]), ("read", ["ab12", "p3"]), None, None]


def test_natural_key_of_very_long_numbers(spark):
    names = [f"f{'1' * 20}5", f"f{'1' * 20}9", f"f{'1' * 22}", "f9", "f010"]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", files.natural_key(F.col("name")).alias("k"))
    assert [r["name"] for r in df.orderBy("k").collect()] == ["f9", "f010", *names[:3]]
