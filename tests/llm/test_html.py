import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from driftwell.llm import html


def test_blocks_lists_and_tables():
    page = "<title>no</title><p>One<p>Two <b>bold</b>text<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>x<p>y</ol><table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>fig &amp; co<td>12</table>"
    assert html.render(page) == "One\n\nTwo boldtext\n\n- a\n- b\n  - c\n\n3. x\n\n   y\n\nName      Qty\napple     3\nfig & co  12"


def test_spans_keep_columns():
    page = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td colspan=2>wide cell<td>f</table>"
    assert html.render(page).split("\n") == ["a  b  c", "   d  e", "wide cell  f"]


def test_visibility():
    page = """<style>.ad,#x{display:none}</style><script>var a="</p>";</script><div class="big ad">no</div><p id=x>no<p hidden>no</p><template>no</template>
    <div style="VISIBILITY: hidden">no<i style="visibility:visible">yes</i></div><details><summary>head</summary>no</details><details open><summary>s</summary>body</details><!-- no -->"""
    text = html.render(page)
    assert "no" not in text and text.split() == ["yes", "head", "s", "body"]


def test_pre_and_breaks_and_stray_signs():
    assert html.render("<pre>  k\n   l</pre>a < b<br>c</i></b>&lt;d&gt;") == "  k\n   l\n\na < b\nc<d>"
    assert html.render("") == "" and html.render("plain") == "plain" and html.render("a<b") == "a<b"


def test_depth_and_length_are_no_limit():
    assert html.render("<div>" * 50_000 + "x") == "x"
    assert html.render("<" * 100_000) == "<" * 100_000
    assert len(html.render("<p>" + "word " * 200_000)) == 5 * 200_000 - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "div", "b", "li", "td", "ul", "table", "tr", "span", "h1"]), st.text("abc ", max_size=8), st.booleans()), max_size=25))
def test_no_visible_word_is_lost(parts):
    page = "".join(f"<{t}>{x}{f'</{t}>' if closed else ''}" for t, x, closed in parts)
    assert sorted(re.findall("[abc]", html.render(page))) == sorted(re.findall("[abc]", "".join(x for _, x, _ in parts)))


def test_table(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    got = sorted(html.extract(rows.withColumn("text", rows.url)).collect(), key=str)
    assert sorted((r.page_id is None, r.text) for r in got) == [(False, ""), (False, ""), (False, "a"), (True, "")]
    assert html.extract(rows.limit(0)).count() == 0


def test_xmp_shows_its_source():
    assert html.render("<p>a<xmp>  <b>x</b> &amp;\n y</xmp>z") == "a\n\n  <b>x</b> &amp;\n y\n\nz"
    assert html.render("<div hidden><xmp>no</xmp></div><xmp>open") == "open"


HOSTILE = {
    "equals": "<a " + '=""' * 40_000, "unclosed": "<a " * 40_000, "quoted": '<a x="' * 20_000 + ">", "declarations": "<!" * 50_000, "lists": "<ul><li>x" * 10_000, "quotes": "<blockquote>x" * 10_000,
    "wide": "<table>" + ("<tr>" + "<td colspan=1000>x" * 10) * 1000, "row": "<table><tr>" + "<td colspan=1000>x" * 10_000, "tables": "<table><tr><td>a" * 10_000, "scopes": "<p><button>" + "<span>" * 8000 + "<div>" * 8000,
    "tall": "<table><tr>" + "".join(f"<td rowspan={i}>x" for i in range(1, 3000)) + "<tr><td>x" * 3000, "padded": "<table><tr>" + ("<td rowspan=65534>" + "y" * 50) * 999 + "<tr><td>x" * 5000,
    "sheet": "<style>none" + "a" * 200_000 + "</style>x", "comments": "<style>none" + "/*" * 50_000 + "</style>x", "alternating": ("<a b=\"' " + "<c d='\" ") * 8000, "numbers": "<ol start=999999999><li>x" * 10_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_no_page_takes_or_makes_more_than_its_length(name):
    began = time.process_time()
    text = html.render(HOSTILE[name])
    assert time.process_time() - began < 3 and len(text) < 8 * len(HOSTILE[name]) + 1000


class Naive:
    """A second renderer: recursive, from a tree that no parser has seen; every block copies the lines of its parts."""

    def __init__(self):
        self.lines, self.run, self.gap = [], "", False

    def flush(self, always=False):
        line = " ".join(self.run.split())
        if line or always:
            self.put([line])
        self.run = ""

    def put(self, lines):
        if lines:
            self.lines += [""] * bool(self.lines and self.gap) + lines
            self.gap = False

    def block(self, apart):
        self.flush()
        self.gap |= apart

    def done(self):
        self.flush()
        return "\n".join(self.lines).strip("\n").split("\n") if any(self.lines) else []

    def add(self, node, parent="", number=0):
        if isinstance(node, str):
            self.run += node
            return
        tag, children = node
        if tag == "br":
            self.flush(True)
        elif tag in ("b", "hidden"):
            for c in children if tag == "b" else ():
                self.add(c)
        elif tag in ("div", "p", "h1"):
            self.block(tag != "div")
            for c in children:
                self.add(c)
            self.block(tag != "div")
        elif tag == "table":
            rows = [[Naive().all(cell[1]) for cell in row[1]] for row in children]
            wide = [max((len(x) for r in rows for x in (r[k] if k < len(r) else ()) if len(x) <= html.WIDE), default=0) for k in range(max(map(len, rows), default=0))]
            self.block(True)
            for r in rows:
                for i in range(max(map(len, r), default=0)):
                    line = ""
                    for k, cell in enumerate(r):
                        if i < len(cell) and cell[i]:
                            line = line.ljust(max(sum(w + 2 for w in wide[:k] if w), len(line) + 2 * bool(line))) + cell[i]
                    self.put([line] if line else [])
            self.block(True)
        else:
            apart = tag == "blockquote" or tag in ("ul", "ol") and parent != "li"
            self.block(apart)
            own = Naive()
            for n, c in enumerate(children, 1):
                own.add(c, tag, n)
            lines = own.done()
            if tag == "li":
                mark = f"{number}. " if parent == "ol" else "- "
                lines = [(" " * len(mark) if i else mark) + x if x else x for i, x in enumerate(lines)]
            elif tag == "blockquote":
                lines = [("> " + x).rstrip() for x in lines]
            self.put(lines)
            self.block(apart)

    def all(self, nodes):
        for n in nodes:
            self.add(n)
        return self.done()


def page(node):
    if isinstance(node, str):
        return node
    tag, children = node
    inner = "".join(map(page, children))
    return "<br>" if tag == "br" else f"<div hidden>{inner}</div>" if tag == "hidden" else f"<{tag}>{inner}</{tag}>"


texts = st.sampled_from(["a", "b ", " c", "dd ee", "  f\n g", "x" * 70, " "])
inline = st.lists(st.one_of(texts, st.just(("br", [])), st.tuples(st.just("b"), st.lists(texts, max_size=2))), max_size=3)


def nested(below):
    parts = st.lists(st.one_of(texts, below), max_size=3)
    items = st.lists(st.tuples(st.just("li"), parts), min_size=1, max_size=3)
    cells = st.lists(st.tuples(st.just("td"), parts), min_size=1, max_size=3)
    rows = st.lists(st.tuples(st.just("tr"), cells), min_size=1, max_size=3)
    return st.one_of(st.tuples(st.sampled_from(["div", "blockquote", "hidden"]), parts), st.tuples(st.sampled_from(["ul", "ol"]), items), st.tuples(st.just("table"), rows))


trees = st.lists(st.recursive(st.one_of(texts, st.tuples(st.sampled_from(["p", "h1"]), inline), st.just(("br", []))), nested, max_leaves=14), max_size=5)


@settings(max_examples=400, deadline=None)
@given(trees)
def test_against_the_naive_renderer(nodes):
    assert html.render("".join(map(page, nodes))).split("\n") == ("\n".join(Naive().all(nodes))).split("\n")
