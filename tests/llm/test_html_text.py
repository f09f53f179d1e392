"""Layout, visibility and implied tags on small pages."""

import random
import re
import time

import pytest

from loomlog.llm import html_text as ht
from loomlog.llm.html_text import rendered, extract

PAGES = [
    ("<p>a<p>b<div>c<ul><li>x<li>y<ol start=3><li>q<li>r</ol><li>z</ul>d", "a\n\nb\n\nc\n\n- x\n- y\n  3. q\n  4. r\n- z\n\nd"),
    ("<title>no</title><b>x<p>y</b>z</p>w<!-- c --><script>if(a<b)</script>k &amp; l&lt;", "x\n\nyz\n\nwk & l<"),
    ("<table><tr><th>Name<th>N<tr><td>abc<td>1<tr><td>x<br>y<td>2</table>after", "Name | N\nabc  | 1\nx    | 2\ny    |\n\nafter"),
    ("<table><caption>C</caption><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide</table>", "C\na | b\n  | c\nwide"),
    ("<table><tr><td>o<table><tr><td>i<td>j</table><td>p</table>", "o     | p\n      |\ni | j |"),
    ("<div hidden>h</div><p style='display: none'>q</p><p>v<span style=\"visibility:hidden\">w</span>u</p>", "vu"),
    ("<pre>\n a\n  b</pre><blockquote>q<p>r</blockquote>t", " a\n  b\n\n  q\n\n  r\n\nt"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl><h1>H</h1>x<hr>y<br>z", "t\n  d\nu\n  e\n\nH\n\nx\n---\ny\nz"),
    ("<p><b hidden>a<p>b</b>c", "c"), ("a < b <3 & c <", "a < b <3 & c <"), ("<table>foster<tr><td>c</table>", "foster\n\nc"),
    ("<p title=it's>ok</p>don't", "ok\n\ndon't"), ("", ""), ("<div a='", ""), ("<script>x", ""), ("a  \n b<i> c</i> d", "a b c d"),
    ("<select><option>1<option>2</select><input type=hidden value=h><input type=submit value=Go>", "1\n2\nGo"),
    ("<textarea>a\n <b></textarea>", "a\n <b>"), ("x<template>t</template><noscript>n</noscript>y", "xy"),
]


@pytest.mark.parametrize(("source", "text"), PAGES)
def test_page(source, text):
    assert rendered(source) == text


@pytest.mark.parametrize("source", ["<div>" * 20_000 + "x", "<table><tr><td>" * 600 + "x", "<li><ul>" * 3000 + "x", "<b hidden>" * 900 + "<p>x" * 900 + "</b>" * 900 + "x",
                                    "<p title='" * 5000 + "x", "<" * 50_000, "<!--" * 20_000, "</p>" * 5000, "&" * 50_000])
def test_broken_pages_end(source):
    rendered(source)


@pytest.mark.parametrize("above", ["<div>", "<font>", "<span>", "<section><i>"])
def test_deep_pages(above):
    rows = "<table><tr><td>x<td>y<tr><td>z</table>"
    assert rendered(above * 600 + rows) == rendered(rows) == "x | y\nz"
    assert rendered("<table><tr><td>" + above * 600 + rows) == rendered("<table><tr><td>" + above + rows)
    assert rendered(above * 600 + "<div hidden><p>no<p>no</div>yes") == "yes"
    assert rendered(above * 600 + "<pre>a  <b>b\n  c") == "a  b\n  c"


@pytest.mark.parametrize("source", ["<b hidden><ul><li>x</b>y</li></ul>", "<b hidden><blockquote>x</b>y</blockquote>", "<b hidden><dl><dd>x</b>y</dd></dl>"])
def test_hidden_formatting_ends_inside(source):
    assert rendered(f"<ul><li>a{source}</li><li>z</ul>").split() == ["-", "ay", "-", "z"]
    assert rendered(source) == "y"


def test_words_survive(spark):
    words = [f"w{i}" for i in range(30_000)]
    assert rendered("<p>" + " <b>".join(words)).split() == words
    pages = spark.createDataFrame([(1, None, "x"), (None, "<p>a", "y"), (1, "", "z")], "page_id long, html string, text string")
    assert sorted(map(tuple, extract(pages).collect()), key=str) == [(1, ""), (1, ""), (None, "a")]
    assert extract(pages.limit(0)).count() == 0


# ---- against a slow walk over the tree that the page was made from ----

def _tree(rnd, depth, inline=False):
    """(tag, attributes, children) or a word; paragraphs hold inline elements only, lists items, tables rows."""
    if depth == 0 or rnd.random() < 0.3:
        return f"w{rnd.randrange(1000)}"
    kinds = ["b", "span", "i"] if inline else ["b", "span", "div", "p", "ul", "table", "section", "details", "blockquote", "h2"]
    tag = rnd.choice(kinds)
    style = rnd.choice([""] * 6 + [" hidden", " style='display: none'", " style='visibility:hidden'", " style='visibility: visible'"])
    if tag == "details" and rnd.random() < 0.5:
        style += " open"
    inner = inline or tag in ("p", "h2", "b", "span", "i")
    kids = [_tree(rnd, depth - 1, inner) for _ in range(rnd.randrange(1, 4))]
    if tag == "ul":
        kids = [("li", "", [k]) for k in kids]
    elif tag == "table":
        kids = [("tr", "", [("td", rnd.choice(["", "", " hidden"]), [_tree(rnd, 2, True)]) for _ in range(2)]) for _ in kids]
    elif tag == "details" and rnd.random() < 0.7:
        kids.insert(rnd.randrange(len(kids) + 1), ("summary", "", [_tree(rnd, 1, True)]))
    return tag, style, kids


def _source(node):
    return f" {node} " if isinstance(node, str) else f"<{node[0]}{node[1]}>{''.join(map(_source, node[2]))}</{node[0]}>"


def _words(node, shown=True, visible=True):
    """Words that a reader sees, in order."""
    if isinstance(node, str):
        return [node] if shown and visible else []
    tag, style, kids = node
    shown = shown and "hidden" not in style.replace("visibility:hidden", "") and "none" not in style
    visible = False if "visibility:hidden" in style else True if "visible" in style else visible
    out, summary = [], False
    for kid in kids:
        first = not isinstance(kid, str) and kid[0] == "summary" and not summary
        summary |= first
        out += _words(kid, shown and (tag != "details" or "open" in style or first), visible)
    return out


def test_visible_words_of_random_pages():
    rnd = random.Random(11)
    for _ in range(3000):
        nodes = [_tree(rnd, 4) for _ in range(rnd.randrange(1, 5))]
        page = "".join(map(_source, nodes))
        expected = [w for n in nodes for w in _words(n)]
        assert re.findall(r"w\d+", ht.rendered(page)) == expected, page


def test_columns_of_random_tables():
    """Places of cells against a grid that is filled field by field."""
    rnd = random.Random(12)
    for _ in range(500):
        taken, at, grid = set(), 0, ht.Grid()
        rows = [[(rnd.randrange(1, 4), rnd.randrange(1, 4)) for _ in range(rnd.randrange(4))] for _ in range(rnd.randrange(1, 7))]
        for r, cells in enumerate(rows):
            grid.row()
            at, expected = 0, []
            for across, down in cells:
                while (r, at) in taken:
                    at += 1
                expected.append(at)
                taken |= {(r + i, at + j) for i in range(down) for j in range(across) if i}
                grid.cell(["x"], across, down)
                at += across
            assert [c[0] for c in grid.rows[-1]] == expected


def test_large_tables_are_aligned():
    """Over a million fields, with and without fields that are empty for cells above them."""
    page = "<table><tr><td>long" + "<td>y" * 1049 + ("<tr><td>a" + "<td>b" * 1049) * 1049 + "</table>"
    lines = ht.rendered(page).split("\n")
    assert lines[0] == "long" + " | y" * 1049 and set(lines[1:]) == {"a   " + " | b" * 1049} and len(lines) == 1050
    page = "<table><tr>" + "<td rowspan=1200>xy" * 1000 + "<td>z" + "<tr><td>z" * 1199 + "</table>"
    lines = ht.rendered(page).split("\n")
    assert lines[0] == "xy | " * 1000 + "z" and set(lines[1:]) == {"   | " * 1000 + "z"} and len(lines) == 1200


@pytest.mark.parametrize("page", ["<table>" + ("<tr>" + "<td colspan=1000 rowspan=60000>x" * 5) * 300, "<b hidden><div>" * 5000 + "</div></b>" * 5000,
                                  "<b hidden><div>" * 5000 + "x</div>" * 5000])
def test_hostile_pages_cost_little(page):
    began = time.process_time()
    ht.rendered(page)
    assert time.process_time() - began < 2


def test_visibility_inputs_details_plaintext():
    assert ht.rendered("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span>c</div>") == "b"
    assert ht.rendered("<input value=v><input type=password value=p><input type=submit value=go>") == "vgo"
    assert ht.rendered("<details>x<summary>s</summary>y<summary>t</summary></details>z") == "s\nz"
    assert ht.rendered("<p>a<plaintext><b>c</b>\n d") == "a\n\n<b>c</b>\n d"
    assert ht.rendered("<i style='visibility:hidden'><p>a</i>b</p>c") == "b\nc" or ht.rendered("<i style='visibility:hidden'><p>a</i>b</p>c") == "b\n\nc"
