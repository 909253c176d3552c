"""The HTML walk against a second, tree-based one on the given pages."""

import html as entities
import re

from quire.functions.markup import html_to_markdown, strip
from quire.operators import layout

TOKEN = re.compile(r"<!--.*?-->|<!\w[^>]*>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S)
P_ENDS = set("article div footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def tree(source):
    """Nested [tag, children] lists."""
    root = ["", []]
    path, at = [root], 0
    while at < len(source):
        token = TOKEN.match(source, at)
        text, at = token[0], token.end()
        raw = path[-1][0] in ("script", "style")
        if raw and not text.lower().startswith("</" + path[-1][0]):
            path[-1][1].append(text)
        elif text.startswith(("<!--", "<!")):
            continue
        elif text.startswith("</"):
            name = re.match(r"</(\w+)", text)[1].lower()
            depth = [i for i, node in enumerate(path) if node[0] == name]
            if depth:
                del path[depth[-1]:]
            elif name == "p":
                path[-1][1].append(["p", []])
            elif name == "br":
                path[-1][1].append(["br", []])
        elif re.match(r"<[a-zA-Z]", text):
            name = re.match(r"<(\w+)", text)[1].lower()
            top = path[-1][0]
            if (top == "p" and name in P_ENDS) or (top == name == "li") or (name == "body" and top in ("head", "link", "script")):
                path.pop()
            node = [name, []]
            path[-1][1].append(node)
            if name not in ("br", "img", "meta", "link", "input", "hr"):
                path.append(node)
        else:
            path[-1][1].append(entities.unescape(text))
    return root


def flatten(node):
    if isinstance(node, str):
        return node
    tag, inner = node[0], "".join(map(flatten, node[1]))
    shapes = {"p": "{}\n\n", "div": "{}\n\n", "section": "{}\n\n", "ul": "{}\n\n", "ol": "{}\n\n", "li": "- {}\n", "b": "**{}**", "strong": "**{}**",
              "em": "*{}*", "i": "*{}*", "code": "`{}`", "sup": "<sup>{}</sup>", "sub": "<sub>{}</sub>", **{f"h{n}": "### {}\n\n" for n in range(1, 7)}}
    if tag == "br":
        return "\n"
    return shapes[tag].format(strip(inner)) if tag in shapes else inner


def plain(source):
    text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", flatten(tree(source))))
    return strip(re.sub(r"\n{3,}", "\n\n", text))


def test_all_given_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html")
    rows = layout.html_pages(pages).collect()
    assert len(rows) > 20
    for row in rows:
        assert row["markdown"] == plain(row["html"]), row["page_id"]
        assert not row["formula_lost"]


def test_both_agree_on_odd_nesting():
    for source in ("<p>a<b>b<p>c</b>d</p>e", "<ul><li>a<ul><li>b</ul><li>c</ul>", "</p>x</br>y", "<div><p>a</div>b", "a < b &amp; c"):
        assert html_to_markdown(source)[0] == plain(source), source
