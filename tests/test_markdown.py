from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import markup as m
from quire.operators import markdown as md


def sources(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, markdown string")


def blocks(spark, text):
    rows = md.block_table(sources(spark, text)).orderBy("position").collect()
    return [(r.kind, r.source) for r in rows]


def test_outline_and_blocks(spark):
    text = (
        "# One\n\nInline $x^2$ text\n\n$$\na+b\n$$\n\n$\\begin{array}{cc}\na & b \\\\\nc & d\n\\end{array}$\n"
        "## Two\n[unclear: word]\n"
    )
    rows = md.outline(sources(spark, text)).orderBy("ordinal").collect()
    assert [(r.level, r.heading, r.anchor) for r in rows] == [(1, "One", "section-1"), (2, "Two", "section-2")]
    assert [k for k, _ in blocks(spark, text) if k not in ("blank",)] == [
        "heading", "paragraph", "math", "math", "heading", "paragraph",
    ]
    math = [r.tex for r in md.math_inventory(sources(spark, text)).orderBy("position").collect()]
    assert math == ["x^2", "\na+b\n", "\\begin{array}{cc}\na & b \\\\\nc & d\n\\end{array}"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("$$", [("math", "$$")]),
        ("$$a$$\nb", [("math", "$$a$$"), ("paragraph", "b")]),
        ("$$ a $$ b\nc $$ d\ne", [("math", "$$ a $$ b\nc $$ d"), ("paragraph", "e")]),
        ("$open\nno end", [("paragraph", "$open"), ("paragraph", "no end")]),
        ("$open\n mid \nend$ \nx", [("math", "$open\n mid \nend$ "), ("paragraph", "x")]),
        ("- a\n* b\n1. c\n2) d\n##### e", [("item", "- a"), ("item", "* b"), ("ordered_item", "1. c"),
                                          ("ordered_item", "2) d"), ("paragraph", "##### e")]),
        ("a\r\n\r\nb\n", [("paragraph", "a"), ("blank", ""), ("paragraph", "b"), ("blank", "")]),
        ("<!-- page-break -->", [("page_break", "<!-- page-break -->")]),
    ],
)
def test_block_kinds(spark, text, expected):
    assert blocks(spark, text) == expected


def brute_blocks(text):
    """The line rules restated over a plain list."""
    lines = text.replace("\r\n", "\n").split("\n")
    found, i = [], 0
    while i < len(lines):
        start, t = i, lines[i].strip(" \t")
        closing = next((j for j in range(i + 1, len(lines)) if lines[j].strip(" \t").endswith("$")), None)
        pair = next((j for j in range(i + 1, len(lines)) if "$$" in lines[j]), None)
        if t.startswith("$") and not t.startswith("$$") and "$" not in t[1:] and closing is not None:
            i = closing + 1
        elif t.startswith("$$") and not t[2:].endswith("$$"):
            i = len(lines) if pair is None else pair + 1
        else:
            i += 1
        found.append("\n".join(lines[start:i]))
    return found


def test_blocks_against_brute_force(spark):
    rng = random.Random(11)
    bits = ["$", "$$", "a", " ", "\n", "\n", "b$", "$$$", "# h", "- x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    df = sources(spark, *texts).select("doc_id", m.raw_blocks(F.col("markdown")).alias("b"))
    for row in df.collect():
        assert row.b == brute_blocks(texts[row.doc_id]), texts[row.doc_id]


def test_long_source_needs_no_stack(spark):
    text = "$$\n" + "line of text\n" * 200_000 + "$$\nend"
    rows = blocks(spark, text)
    assert [k for k, _ in rows] == ["math", "paragraph"]


def test_uncertain_marks(spark):
    assert md.uncertain_counts(sources(spark, "a [unclear: x] b [UNCLEAR: y or z] c")).first().uncertain_count == 2


def test_html(spark):
    text = "# T & $x<1$\n- a **b**\n- c\n1. d\n\n[unclear: q] ![alt](../up.png) ![f.png](f.png)\n$$y$$"
    html = md.to_html(sources(spark, text)).first().html
    assert html.startswith('<nav class="toc"') and '<a href="#section-1">T &amp; $x&lt;1$</a>' in html
    assert '<h1 id="section-1">T &amp; <math' in html and "<mtext>x&lt;1</mtext>" in html
    assert "<ul>\n<li>a <strong>b</strong></li>\n<li>c</li>\n</ul>\n<ol>\n<li>d</li>\n</ol>" in html
    assert "[blocked image path]" in html and "<figcaption>Source figure</figcaption>" in html
    assert '<div class="display-math"><math' in html


def test_latex(spark):
    text = "# A_b\n- x & $y_1$\n- z\n\n![cap](a_b.png)\n50% \\ ~^{} $$q$$ $open_"
    assert md.to_latex(sources(spark, text)).first().latex.split("\n") == [
        "\\section{A\\_b}", "\\begin{itemize}", "\\item x \\& $y_1$", "\\item z", "\\end{itemize}", "",
        "\\begin{figure}[htbp]\\centering\\includegraphics[width=.92\\linewidth]{a\\_b.png}\\caption{cap}\\end{figure}",
        "50\\% \\textbackslash{} \\textasciitilde{}\\textasciicircum{}\\{\\} $$q$$ $open_\\par",
    ]


def test_command_usage(spark):
    math = spark.createDataFrame([("\\alpha \\le \\alpha \\frac{1}{2} \\foo \\,",)], "tex string")
    got = {r.command: (r.uses, r["class"], r.shown) for r in md.command_usage(math).collect()}
    assert got == {
        "alpha": (2, "greek", "α"), "le": (1, "symbol", "≤"), "frac": (1, "structure", None), "foo": (1, "unsupported", None),
    }


def test_matrices(spark):
    math = spark.createDataFrame(
        [(1, "\\begin{array}{cc} a & b \\\\ c & \\end{array}"), (2, "\\begin{bmatrix}x\\end{bmatrix}"), (3, "\\begin{matrix} x"), (4, "y")],
        "doc_id int, tex string",
    )
    got = [(r.doc_id, r.environment, r.row, r.column, r.cell) for r in md.matrices(math).orderBy("doc_id", "row", "column").collect()]
    assert got == [
        (1, "array", 0, 0, "a"), (1, "array", 0, 1, "b"), (1, "array", 1, 0, "c"), (1, "array", 1, 1, ""), (2, "bmatrix", 0, 0, "x"),
    ]


def test_figures(spark):
    files = spark.createDataFrame([(0, "assets/a.jpg")], "doc_id int, path string")
    text = "![](assets/a.jpg) ![x](assets/b.webp) ![y](/etc/p)"
    rows = md.figure_report(sources(spark, text), files).orderBy("span_index").collect()
    assert [(r.status, r.media_type) for r in rows] == [("ok", "image/jpeg"), ("missing", "image/webp"), ("blocked", "image/png")]
