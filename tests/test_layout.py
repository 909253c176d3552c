"""HTML, blocks, positioned text and print chunks."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions.markup import html_to_markdown, lines_to_markdown, print_chunks
from quire.operators import layout

HTML = [
    ("<h2>Title</h2><p>a <b>bold</b> and <i>it</i></p>", "### Title\n\na **bold** and *it*"),
    ("<ul><li>one<li> two </ul><p>x<br>y", "- one\n- two\n\nx\ny"),
    ("x<sup>2</sup><sub> i </sub> <code> c </code>", "x<sup>2</sup><sub>i</sub> `c`"),
    ("<p>open<p>next</p></p>", "open\n\nnext"),
    ("<math>a<b>b</b></math>", "$ab$"),
    ("<table><tr><th>A</th><th>B|C</th></tr><tr><td>1</td></tr></table>", "| A | B\\|C |\n| --- | --- |\n| 1 | |"),
    ("a &amp; b &lt; c<!-- no --> d", "a & b < c d"),
    ("<table></table>z", "z"),
    ("<span>  many   spaces </span>\n\n\n\n<div>next</div>", "many spaces\n\nnext"),
]


@pytest.mark.parametrize("html, want", HTML)
def test_html(html, want):
    assert html_to_markdown(html) == (want, False)


def test_display_math_but_not_in_cells():
    assert html_to_markdown("<math> x </math>", True)[0] == "$$x$$"
    assert html_to_markdown("<table><tr><td><math>x</math></td></tr></table>", True)[0] == "| $x$ |\n| --- |"


def test_lost_formula_is_reported():
    # text outside rows is not part of a rendered table
    assert html_to_markdown("<table><tr><td>a</td></tr><math>x^9</math></table>") == ("| a |\n| --- |", True)


def run(text, x, y, size=12.0, width=None):
    return (text, float(x), float(y), float(width if width is not None else 8 * len(text)), float(size))


def md(runs):
    return lines_to_markdown(*[[r[i] for r in runs] for i in (0, 1, 2, 3, 4)])


def test_headings_lists_and_paragraphs():
    runs = [run("Big", 0, 700, 24), run("Middle", 0, 670, 16), run("• item", 0, 640), run("2) second", 0, 620), run("plain text hy-", 0, 600),
            run("phen", 0, 586), run("joined", 0, 572), run("far", 0, 500), run("w1", 0, 480), run("w2", 40, 480.5), run("w3", 56.5, 479)]
    assert md(runs) == "### Big\n\n#### Middle\n\n- item\n\n2. second plain text hyphen joined\n\nfar w1 w2w3"


def test_empty_layout():
    assert md([]) == ""


def scan_rows(runs):
    """Plain search for the first fitting row, as a check on the bisection."""
    rows = []
    for r in sorted(runs, key=lambda r: (-r[2], r[1])):
        fit = [row for row in rows if abs(row[0][2] - r[2]) <= max(2.5, r[4] * 0.24)]
        fit[0].append(r) if fit else rows.append([r])
    return rows


@pytest.mark.parametrize("seed", range(20))
def test_rows_against_a_plain_search(seed):
    from quire.functions.markup import _rows

    rng = random.Random(seed)
    runs = [run(f"t{i}", rng.randrange(300), rng.randrange(60), rng.choice([6, 12, 24, 60])) for i in range(60)]
    order = sorted(range(60), key=lambda i: (-runs[i][2], runs[i][1]))
    got = _rows([r[2] for r in runs], [max(2.5, r[4] * 0.24) for r in runs], order)
    assert [[runs[i][0] for i in row] for row in got] == [[r[0] for r in row] for row in scan_rows(runs)]


def test_chunks_keep_blocks_whole():
    text = "# A\n\n```\n# no\n```\n$$\n## no\n$$\n## B\n正文\n"
    assert print_chunks(text, 4) == ["# A\n\n```\n# no\n```\n$$\n## no\n$$", "## B\n正文\n"]
    assert print_chunks("", 4) == [""] and print_chunks("a\n\n\n\n", 1) == ["a\n\n\n\n"]
    assert print_chunks("aaaa\n\nb", 2) == ["aaaa", "\nb"]


@pytest.mark.parametrize("seed", range(30))
def test_chunks_join_to_the_text(seed):
    rng = random.Random(seed)
    text = "\n".join(rng.choice(["# h", "", "text", "```", "~~~", "$$", "$$x$$", "   ", "## é"]) for _ in range(rng.randrange(60)))
    chunks = print_chunks(text, rng.randrange(1, 40))
    assert "\n".join(chunks) == text and (len(chunks) == 1 or all(c.strip() for c in chunks))


def test_block_pages(spark):
    rows = [(1, [("PageHeader", "head", 0, False), ("Text", "<p>second</p>", 2, False), ("Text", "<p>first</p>", None, False), ("Picture", None, 3, False)]),
            (2, [("Equation", "<math>x</math>", 1, True)]), (3, [("PageFooter", "f", 1, False)])]
    df = spark.createDataFrame(rows, "page int, blocks array<struct<label:string,html:string,reading_order:int,error:boolean>>")
    p = {r["page"]: r for r in layout.block_pages(df, ["page"]).collect()}
    assert p[1]["markdown"] == "first\n\nsecond\n\n_[图像或示意图：请对照原 PDF]_" and p[1]["reasons"] == ["包含图像或示意图，建议核对"]
    assert p[2]["markdown"] == "$$x$$" and p[2]["formula_count"] == 1 and p[2]["reasons"] == ["本地视觉识别报告了异常区块"]
    assert (p[3]["markdown"], p[3]["method"], p[3]["reasons"]) == ("", "empty", ["本地高精度识别后仍未检测到文字"])


def test_text_layer_pages(spark):
    df = spark.createDataFrame([(1, [("a long enough line of text for a page", 0.0, 10.0, 50.0, 12.0), (" ", 0.0, 0.0, 0.0, 0.0)]), (2, [])],
                               "page int, items array<struct<text:string,x:double,y:double,width:double,size:double>>")
    p = {r["page"]: r for r in layout.text_layer_pages(df, ["page"]).collect()}
    assert (p[1]["method"], p[1]["status"]) == ("text", "good") and (p[2]["method"], p[2]["status"]) == ("empty", "review")


def test_page_count_check(spark):
    found = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "job_id long, page int")
    expected = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "job_id long, page_count long")
    assert {r["job_id"]: r["found"] for r in layout.require_page_count(found, expected).collect()} == {2: 1, 3: 0}


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "# a\n# b\n# c")], "id int, markdown string")
    rows = layout.chunked(df, ["id"], target=1).orderBy("chunk").collect()
    assert [(r["chunk"], r["markdown"]) for r in rows] == [(0, "# a"), (1, "# b"), (2, "# c")]
    assert layout.chunked(df, ["id"]).select(F.max("chunk")).first()[0] == 0
