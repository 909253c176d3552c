"""Text rules: white space, rounding, metrics, previews, titles, marks."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import fixed_values as fv
from quire.functions import base, text

C = F.col


def values(spark, expr, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expr.alias("x")).collect())]


def test_trim_takes_every_kind_of_space(spark):
    odd = chr(0xA0) + chr(0x3000) + chr(0xFEFF) + "\t a b \x0b\n"
    assert values(spark, base.js_trim(C("v")), [odd, "", "x"]) == ["a b", "", "x"]


def test_rounding_is_half_up(spark):
    assert values(spark, base.js_round(C("v")), [0.5, 1.5, -0.5, -1.5, 2.4], "double") == [1, 2, 0, -1, 2]
    assert values(spark, base.js_round(C("v"), 2), [1.005, 2.675, 1.0], "double") == [1.0, 2.68, 1.0]


def test_lines(spark):
    assert values(spark, base.line_count(C("v")), ["", "a", "a\n\nb", "\na", None]) == [0, 1, 2, 2, 0]


def test_tags(spark):
    got = values(spark, base.parse_tags(C("v")), ['["a",1]', "[bad", '{"a":1}', None, ""])
    assert got == [["a", "1"], [], [], [], []]


def test_upper_median(spark):
    df = spark.createDataFrame([([3.0, 1.0],), ([],), ([5.0, 1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in df.select(base.upper_median(C("v"), 12.0)).collect()] == [3.0, 12.0, 2.0]


PATTERN = re.compile(r"\$\$[\s\S]*?\$\$|\$(?:\\.|[^$\n])+\$")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="$\\ab\n ", max_size=14), min_size=40, max_size=80))
def test_formula_count_is_the_plain_patterns_count(spark, items):
    got = values(spark, text.count_formulas(C("v")), items)
    assert got == [len(PATTERN.findall(i)) for i in items]


def test_formula_patterns_on_every_short_text():
    import itertools

    shaped = [re.compile(p.replace(r"\z", r"\Z")) for p in (text._FORMULA_JAVA, text._INLINE_JAVA)]
    plain = [re.compile(p) for p in (fv.FORMULA, fv.INLINE_FORMULA)]
    for size in range(8):
        for letters in itertools.product("$\\a\n", repeat=size):
            item = "".join(letters)
            for mine, theirs in zip(shaped, plain):
                assert [m.span() for m in mine.finditer(item)] == [m.span() for m in theirs.finditer(item)], item


def test_formula_found_by_random_search(spark):
    assert values(spark, text.count_formulas(C("v")), ["$$\\$ $ $"]) == [1]


def test_formulas_on_a_long_line_do_not_overflow(spark):
    line = "$" + "x\\y " * 20000
    assert values(spark, text.count_formulas(C("v")), [line, line + "$"]) == [0, 1]


def test_options_and_visible_length(spark):
    md = "A. one\n- b) two\n  C) three\nE. no\nA.none"
    assert values(spark, text.count_options(C("v")), [md]) == [3]
    assert values(spark, text.visible_length(C("v")), ["# a*b `c`\n|\\_$ <d>" + chr(0x3000)]) == [4]


def test_preview_skips_what_the_library_wrote_itself(spark):
    md = ("# 作业\n\n> 由quire转换，共 3 页。由视觉模型直接识别 3/3 页。\n\n## PDF 第 1 页\n\n小说文体的阅读方法\n\n---\n\n## PDF 第 2 页\n\n"
          "_[此页未检测到文字，请查看原始 PDF。]_\n\n---\n\n## 第 3 张图\n\n**细读**《祝福》")
    links = "# t\n\n![封面](images/p1.png) 见[官网](https://example.com)"
    second = "## kept\n# first\n# second"
    got = values(spark, text.preview(C("v")), [md, links, second, None, "x" * 500])
    assert got == ["小说文体的阅读方法 细读《祝福》", "封面 见官网", "kept second", "", "x" * 240]


def test_titles(spark):
    got = values(spark, text.markdown_title(C("v"), F.lit("doc")),
                 ["---\na: b\n---\n# My\\_Title  \nx", "---\nno key\n---\n# T", "## no", "#  \n# real"])
    assert got == ["My_Title", "T", "doc", "# real"]  # white space after the mark may hold a line feed


def test_card_content_needs_enough_text(spark):
    assert values(spark, text.card_content(C("v")), ["short", "# " + "word " * 1000])[0] is None
    assert len(values(spark, text.card_content(C("v")), ["word " * 1000])[0]) == 3000


def test_snippets(spark):
    assert values(spark, text.tidy(C("v")), ["![a](b) [c](d) **e**"]) == ["a c e "]
    assert values(spark, text.flat(C("v")), ["![a](b) [c](d) **e**"]) == ["[c](d) e"]


@pytest.mark.parametrize("needle", ["ab", "a", "\\E", "aa"])
def test_offsets_equal_a_scan(spark, needle):
    items = ["", "ab", "aabab\\Eaa", "b" * 5 + needle * 3, "aAaB", "xabyaab\n" + needle]

    def scan(s):
        out, at = [], s.find(needle)
        while at >= 0:
            out.append(at)
            at = s.find(needle, at + len(needle))
        return out

    assert values(spark, text.occurrence_offsets(C("v"), needle), items) == [scan(i) for i in items]
    assert values(spark, text.occurrence_offsets(C("v"), needle, 2), items) == [scan(i)[:2] for i in items]
    assert values(spark, text.count_occurrences(C("v"), needle), items) == [len(scan(i)) for i in items]


def test_formula_inventory(spark):
    df = spark.createDataFrame([("a $x$ b $$ y\n$$ \\$no$z$",)], "v string")
    got = [(r["display"], r["latex"]) for r in df.select(text.formulas(C("v")).alias("f")).first()["f"]]
    assert got == [(True, "y"), (False, "x"), (False, "z")]


def test_note_marks(spark):
    df = spark.createDataFrame([("> [!Warning]- \n> body\n\n> [!tip] Do it\n==hot== [[Note#x|shown]] ![[pic.png]]",)], "v string")
    r = df.select(text.callouts(C("v")).alias("c"), text.highlights(C("v")).alias("h"), text.wikilinks(C("v")).alias("w")).first()
    assert [tuple(x) for x in r["c"]] == [("warning", "Warning"), ("tip", "Do it")]
    assert r["h"] == ["hot"]
    assert [tuple(x) for x in r["w"]] == [(False, "shown"), (True, "pic.png")]


def test_service_text(spark):
    got = values(spark, text.translate_service_text(C("v")), ["已完成 1/1 页", "补救 1 页失败的识别", "别的", "AI 检测：未发现可提取的文字（photo）"])
    assert got == ["Done 1/1 pages", "Retrying 1 failed pages", "别的", "AI detection: no extractable text (photo)"]


def test_white_space_table_is_complete():
    assert len(set(fv.WS_CHARS)) == 25


def test_formulas_of_very_long_lines(spark):
    long = "x" * 1_000_000
    df = spark.createDataFrame([(f"a ${long}$ b",), (f"a ${long}",), ("a $x$ and $y\\$z$",)], "md string")
    got = [[x["latex"] for x in r[0]] for r in df.select(text.formulas(F.col("md"))).collect()]
    assert got == [[long], [], ["x", "y\\$z"]]


def test_callouts_with_bodies_and_nesting(spark):
    from quire.operators import layout

    md = "\n".join([
        "intro", "> [!Note] Title", "> body", "> > [!tip]- ", "> > inner", "> >> [!x-1] deep", "> last", "", "> plain", "> [!no] not first", "", "   > [!WARN]", "> [!no] body", "", "    > [!code]", "> [!end]"])
    rows = spark.createDataFrame([(1, md), (2, None), (3, ""), (4, "> quote"), (5, "> [!a]\n" + "> line\n" * 20_000)], "id int, markdown string")
    got = {(r["id"], tuple(r["path"])): (r["kind"], r["title"], r["body"]) for r in layout.callouts(rows, ["id"]).collect()}
    long = got.pop((5, (0,)))
    assert long[:2] == ("a", "A") and long[2].count("line") == 20_000
    assert got == {
        (1, (0,)): ("note", "Title", "body\n> [!tip]- \n> inner\n>> [!x-1] deep\nlast"),
        (1, (0, 0)): ("tip", "Tip", "inner\n> [!x-1] deep"),
        (1, (0, 0, 0)): ("x-1", "deep", ""),
        (1, (1,)): ("warn", "Warn", "[!no] body"),
        (1, (2,)): ("end", "End", ""),
    }
    assert layout.callouts(rows.filter("id = 3"), ["id"]).count() == 0


def test_formulas_are_kept_and_the_rest_is_changed(spark):
    rows = [("<$a<b$>", "&lt;$a<b$&gt;"), ("$$x\n<$$ & $y$ $z<$", "$$x\n<$$ &amp; $y$ $z<$"), (r"\$5 < $6 <", r"\$5 &lt; $6 &lt;"), ("", ""), ("$$<$$" * 300 + "<", "$$<$$" * 300 + "&lt;"), (None, None)]
    df = spark.createDataFrame([(a, b) for a, b in rows], "md string, want string")
    for r in df.select("want", text.outside_formulas(F.col("md"), text.escape_html).alias("got")).collect():
        assert r["got"] == r["want"]
