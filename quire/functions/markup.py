"""Markdown, HTML and TeX text as column expressions.

A source is cut into blocks by one regular expression that consumes whole lines
in order. Repetitions are possessive or over single characters, so matching
needs no stack depth. A single-dollar line opens a block only while a line that
closes one still follows: lines behind the last such line are known from a scan
beforehand and never look for an end, so each character is touched a bounded
number of times whatever the source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .assets import figure_caption, is_blocked_path
from .text import trim_all, trim_blank

# Page-break lines.
PAGE_BREAKS = ['<div class="page-break"></div>', "<!-- page-break -->"]
# Markup written around rendered text.
TOC_OPEN = '<nav class="toc" aria-label="Table of contents"><h2>Contents</h2><ol>'
TOC_CLOSE = "</ol></nav>"
MATH_OPEN = '<math xmlns="http://www.w3.org/1998/Math/MathML" display="{0}"><mtext>'
MATH_CLOSE = "</mtext></math>"
DISPLAY_OPEN, DISPLAY_CLOSE = '<div class="display-math">', "</div>"
BREAK_ELEMENT = '<div class="page-break" aria-hidden="true"></div>'
UNCLEAR_OPEN, UNCLEAR_CLOSE = '<span class="unclear">', "</span>"
BLOCKED_IMAGE = '<span class="unclear">[blocked image path]</span>'
_FIGURE_BEGIN, _FIGURE_END = "<figure>", "</figure>"
TEX_FIGURE = "\\begin{figure}[htbp]\\centering\\includegraphics[width=.92\\linewidth]{"
TEX_CAPTION, TEX_FIGURE_END = "}\\caption{", "}\\end{figure}"
UNCERTAIN_MARK = r"(?i)\[unclear:\s*[^\]]*\]"

_GAP = r"[\t\p{Zs}]*+"
# A line whose last sign is "$" ends a single-dollar block; a line with one "$", its first sign, begins one.
_LAST_CLOSING = rf"(?s)\A.*\${_GAP}\n"
_OPENING = rf"(?md)^{_GAP}\$(?!\$)[^$\n]*+$"
#: Line marks of a source with openings that nothing closes: a closing line follows, or none does.
_CLOSABLE, _FINAL = "C", "F"


def _block_pattern(closable: str = "", line: str = "", open_end: bool = False) -> str:
    """Blocks of lines that begin with a mark.

    In order: single-dollar block closed by a later line ending in "$" (with ``open_end`` also one that is not closed
    here); one-line "$$…$$"; "$$" block up to the next line holding "$$"; unclosed "$$" block; any other line.
    """
    return (
        rf"{closable}{_GAP}\$(?!\$)[^$\n]*+\n(?s:.*?)\${_GAP}\n"
        + (rf"|{_GAP}\$(?!\$)[^$\n]*+\n(?s:.*+)" if open_end else "")
        +        rf"|{line}{_GAP}\$\$[^\n]*?\$\${_GAP}\n"
        rf"|{line}{_GAP}\$\$[^\n]*+\n(?s:.*?)\$\$[^\n]*+\n"
        rf"|{line}{_GAP}\$\$(?s:.*+)"
        r"|[^\n]*+\n"
    )


_INLINE = (
    r"(?s)!\[[^\]]*+\]\([^)]*+\)|\*\*.*?\*\*|\$[^$]*+\$|\[unclear:[^\]]*+\]|[^!*$\[]++|."
)
_PROSE = r"(?s)\$\$.*?(?:\$\$|\z)|\$(?!\$)(?:[^$]|\$\$)*+(?:\$|\z)|[^$]++"


def normalize_newlines(markdown: Column) -> Column:
    return F.replace(markdown, F.lit("\r\n"), F.lit("\n"))


def lines(markdown: Column) -> Column:
    return F.split(normalize_newlines(markdown), "\n", -1)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def raw_blocks(markdown: Column) -> Column:
    """Array of block sources in order, each without its final newline."""
    text = F.concat(normalize_newlines(markdown), F.lit("\n"))

    def cut(whole: Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), lambda b: F.regexp_replace(b, r"\n\z", ""))

    def marked(closable: Column, rest: Column) -> Column:
        lines_ = F.concat(
            F.when(closable == "", "").otherwise(F.regexp_replace(closable, "(?md)^", _CLOSABLE)),
            F.regexp_replace(rest, "(?md)^", _FINAL),
        )
        blocks = cut(lines_, _block_pattern(_CLOSABLE, f"[{_CLOSABLE}{_FINAL}]"))
        return F.transform(blocks, lambda b: F.regexp_replace(b, f"(?md)^[{_CLOSABLE}{_FINAL}]", ""))

    def classified(whole: Column) -> Column:
        return let(
            F.regexp_extract(whole, _LAST_CLOSING, 0),
            lambda closable: let(
                F.substring(whole, F.length(closable) + 1, F.length(whole)),
                lambda rest: F.when(rest.rlike(_OPENING), marked(closable, rest)).otherwise(cut(whole, _block_pattern())),
            ),
        )

    return let(text, lambda whole: F.when(F.contains(whole, F.lit("$")), classified(whole)).otherwise(cut(whole, r"[^\n]*+\n")))


# What a part of a source leaves open: nothing, a "$$" block, or a single-dollar block that a later part closes.
NOTHING, PAIR, SINGLE = 0, 1, 2
_TO_PAIR = r"(?s)\A.*?\$\$[^\n]*+"
_TO_SINGLE = rf"(?s)\A(.*?\${_GAP})\n"


def has_closing_line(markdown: Column) -> Column:
    """A line whose last sign is "$"."""
    return F.concat(normalize_newlines(markdown), F.lit("\n")).rlike(rf"\${_GAP}\n")


def closes(markdown: Column) -> Column:
    """For each state a part may begin in: it ends what is open there."""
    return F.array(F.lit(True), F.contains(markdown, F.lit("$$")), has_closing_line(markdown))


def continued(markdown: Column, state: Column) -> Column:
    """Beginning of a part that belongs to the block open there, without the end of its last line."""
    text = normalize_newlines(markdown)
    pair = F.when(F.contains(text, F.lit("$$")), F.regexp_extract(text, _TO_PAIR, 0)).otherwise(text)
    single = F.when(has_closing_line(text), F.regexp_extract(F.concat(text, F.lit("\n")), _TO_SINGLE, 1)).otherwise(text)
    return F.when(state == PAIR, pair).when(state == SINGLE, single).otherwise(F.lit(""))


def open_states(markdown: Column, closing_follows: Column) -> Column:
    """For each state a part may begin in, the state it ends in; ``closing_follows`` tells of the later parts.

    The part's lines are given without the line end in front of them.
    """
    text = normalize_newlines(markdown)

    def last_block(rest: Column) -> Column:
        whole = F.concat(rest, F.lit("\n"))
        closed = F.element_at(raw_blocks(rest), -1)
        opened = F.element_at(F.regexp_extract_all(whole, F.lit(_block_pattern(open_end=True)), F.lit(0)), -1)
        return F.when(closing_follows, F.regexp_replace(opened, r"\n\z", "")).otherwise(closed)

    def state_of(block: Column) -> Column:
        pair = block.rlike(rf"\A{_GAP}\$\$") & ~block.rlike(rf"\A{_GAP}\$\$[^\n]*?\$\${_GAP}\z")
        pair = pair & ~block.rlike(rf"\A{_GAP}\$\$[^\n]*+\n(?s:.*?)\$\$")
        single = block.rlike(rf"\A{_GAP}\$(?!\$)[^$\n]*+(?:\n|\z)") & ~block.rlike(rf"(?s)\A{_GAP}\$(?!\$)[^$\n]*+\n.*\${_GAP}\z")
        return F.when(pair, PAIR).when(single & closing_follows, SINGLE).otherwise(NOTHING)

    def from_state(state: int) -> Column:
        if state == NOTHING:
            return let(last_block(text), state_of)
        done = F.element_at(closes(text), state + 1)
        rest = let(continued(text, F.lit(state)), lambda head: F.substring(text, F.length(head) + 2, F.length(text)))
        return F.when(~done, F.lit(state)).otherwise(let(let(rest, last_block), state_of))

    same = F.array(*[F.lit(s) for s in (NOTHING, PAIR, SINGLE)])
    return F.when(F.contains(text, F.lit("$")), F.array(*[from_state(s) for s in (NOTHING, PAIR, SINGLE)])).otherwise(same)


def is_math_block(block: Column) -> Column:
    """Display math: an opening "$$", or an opening "$" that spans lines."""
    return block.rlike(rf"\A{_GAP}\$\$") | block.rlike(rf"\A{_GAP}\$[^$\n]*+\n")


def block_kind(block: Column) -> Column:
    """page_break, math, blank, heading, ordered_item, item or paragraph."""
    text = trim_blank(block)
    return (
        F.when(is_math_block(block), "math")
        .when(text.isin(PAGE_BREAKS), "page_break")
        .when(text == "", "blank")
        .when(heading_level(text) > 0, "heading")
        .when(text.rlike(r"^[-*] "), "item")
        .when(text.rlike(r"^\p{Nd}+[.)][\t-\r\p{Z}]+"), "ordered_item")
        .otherwise("paragraph")
    )


def heading_level(line: Column) -> Column:
    """1 to 4 for a heading line, else 0."""
    hashes = F.length(F.regexp_extract(line, r"^(#{1,4}) ", 1))
    return hashes


def heading_text(line: Column) -> Column:
    return F.regexp_replace(line, r"\A#{1,4} ", "")


def item_text(line: Column) -> Column:
    return F.regexp_replace(line, r"\A(?:[-*] |\p{Nd}+[.)][\t-\r\p{Z}]+)", "")


def display_math(block: Column) -> Column:
    """TeX of a display-math block, without its delimiters."""
    text = trim_blank(block)
    opened = F.regexp_replace(block, rf"\A{_GAP}\$\$", "")
    head = F.substring_index(opened, "\n", 1)
    tail = F.substring(opened, F.length(head) + F.lit(1), F.length(opened))
    # The opening line is trimmed; the closing line loses every "$$".
    several = F.concat(F.regexp_replace(head, r"[\t\p{Zs}]++\z", ""), F.replace(tail, F.lit("$$"), F.lit("")))
    one_line = F.regexp_replace(F.regexp_replace(text, r"\A\$\$", ""), r"\$\$\z", "")
    # A single-dollar block has every line trimmed before its delimiters go.
    trimmed = F.array_join(F.transform(F.split(block, "\n", -1), trim_blank), "\n")
    single = F.regexp_replace(F.regexp_replace(trimmed, r"\A\$", ""), r"\$\z", "")
    return (
        F.when(text.rlike(r"\A\$\$") & F.contains(block, F.lit("\n")), several)
        .when(text.rlike(r"\A\$\$"), one_line)
        .otherwise(single)
    )


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_tex(text: Column) -> Column:
    """TeX special characters escaped in one logical pass.

    The text is cut at backslashes first, so no escape is escaped again.
    """

    def piece(part: Column) -> Column:
        marked = F.regexp_replace(part, r"[&%$#_{}]", r"\\$0")
        tilde = F.replace(marked, F.lit("~"), F.lit("\\textasciitilde{}"))
        return F.replace(tilde, F.lit("^"), F.lit("\\textasciicircum{}"))

    return F.array_join(F.transform(F.split(text, r"\\", -1), piece), "\\textbackslash{}")


def escape_tex_prose(text: Column) -> Column:
    """Escape prose only; ``$…$`` and ``$$…$$`` stay, an unclosed one to the end."""
    parts = F.regexp_extract_all(text, F.lit(_PROSE), F.lit(0))
    return F.array_join(
        F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("$")), p).otherwise(escape_tex(p))), ""
    )


def inline_spans(text: Column) -> Column:
    """Sources of inline spans in order: images, bold, math, unclear marks, text."""
    return F.regexp_extract_all(text, F.lit(_INLINE), F.lit(0))


def span_kind(span: Column) -> Column:
    """Kind of a span from :func:`inline_spans`.

    The cut leaves "!", "*", "$" and "[" only at the start of a matched span or
    as a single character, so first character and length decide.
    """
    first = F.left(span, F.lit(1))
    size = F.length(span)
    return (
        F.when(size < 2, "text")
        .when(first == "!", "image")
        .when(first == "*", "bold")
        .when(first == "$", "math")
        .when(first == "[", "unclear")
        .otherwise("text")
    )


def image_alt(span: Column) -> Column:
    return F.regexp_extract(span, r"\A!\[([^\]]*+)\]\(", 1)


def image_path(span: Column) -> Column:
    return F.regexp_extract(span, r"\A!\[[^\]]*+\]\(([^)]*+)\)", 1)


def math_element(tex: Column, display: str) -> Column:
    """Math kept as escaped TeX inside a ``math`` element."""
    safe = escape_html(tex)
    return F.concat(
        F.lit(MATH_OPEN.format(display)),
        safe, F.lit(MATH_CLOSE),
    )


def inline_html(text: Column) -> Column:
    """HTML of a line's inline spans; figures keep their path as the source."""

    def render(span: Column) -> Column:
        kind = span_kind(span)
        inner = escape_html(F.substring(span, F.lit(3), F.length(span) - 4))
        tex = F.substring(span, F.lit(2), F.length(span) - 2)
        path = image_path(span)
        caption = escape_html(figure_caption(image_alt(span), path))
        picture = F.when(
            is_blocked_path(path), F.lit(BLOCKED_IMAGE)
        ).otherwise(
            F.concat(
                F.lit(f'{_FIGURE_BEGIN}<img alt="'), caption, F.lit('" src="'), escape_html(path),
                F.lit('"><figcaption>'), caption, F.lit(f"</figcaption>{_FIGURE_END}"),
            )
        )
        return (
            F.when(kind == "bold", F.concat(F.lit("<strong>"), inner, F.lit("</strong>")))
            .when(kind == "math", math_element(tex, "inline"))
            .when(kind == "unclear", F.concat(F.lit(UNCLEAR_OPEN), escape_html(span), F.lit(UNCLEAR_CLOSE)))
            .when(kind == "image", picture)
            .otherwise(escape_html(span))
        )

    return F.array_join(F.transform(inline_spans(text), render), "")


def inline_source(kind: Column, block: Column) -> Column:
    """Text of a block that may hold inline spans; null for all other kinds."""
    text = trim_blank(block)
    return F.when(kind == "heading", heading_text(text)).when(kind.isin("item", "ordered_item"), item_text(text)).when(
        kind == "paragraph", text
    )


def figure_paths(blocks: Column, kinds: Column) -> Column:
    """Paths of the figures of all blocks that are not blocked, in the order they are rendered in."""

    def of_block(block: Column, kind: Column) -> Column:
        images = F.filter(inline_spans(inline_source(kind, block)), lambda span: span_kind(span) == "image")
        return F.filter(F.transform(images, image_path), lambda path: ~is_blocked_path(path))

    # zipped, so that the kinds are evaluated once and not once per block
    return F.flatten(F.filter(F.zip_with(blocks, kinds, of_block), lambda paths: paths.isNotNull()))


def uncertain_count(source: Column) -> Column:
    return F.regexp_count(source, F.lit(UNCERTAIN_MARK))


#: A mark that is begun and not ended; a later part may end it.
_OPEN_MARK = r"(?i)\[unclear:[^\]]*\z"


def uncertain_table(source: Column) -> Column:
    """For a part that begins outside and inside a mark: ``struct<marks,open>``, the marks it ends and whether one is open after it."""

    def counted(text: Column, ended: int) -> Column:
        return F.struct((uncertain_count(text) + ended).cast("long").alias("marks"), text.rlike(_OPEN_MARK).alias("open"))

    still = F.struct(F.lit(0).cast("long").alias("marks"), F.lit(True).alias("open"))
    rest = F.substring(source, F.position(F.lit("]"), source) + 1, F.length(source))
    inside = F.when(F.contains(source, F.lit("]")), let(rest, lambda text: counted(text, 1))).otherwise(still)
    return F.array(counted(source, 0), inside)


def _list_tag(kind: Column) -> Column:
    return F.when(kind == "item", "ul").when(kind == "ordered_item", "ol")


def _mark_missing(body: Column, paths: Column, present: Column) -> Column:
    """Figures whose file is not there become a mark; the body is cut at "<figure>", which escaped text cannot contain."""

    def piece(part: Column, n: Column) -> Column:
        after = F.substring(part, F.position(F.lit(_FIGURE_END), part) + len(_FIGURE_END), F.length(part))
        missing = F.concat(
            F.lit(f"{UNCLEAR_OPEN}[missing figure: "), escape_html(F.get(paths, n - 1)), F.lit(f"]{UNCLEAR_CLOSE}"), after
        )
        shown = F.concat(F.lit(_FIGURE_BEGIN), part)
        return F.when(n == 0, part).when(F.get(present, n - 1), shown).otherwise(missing)

    return F.array_join(F.transform(F.split(body, _FIGURE_BEGIN, -1), piece), "")


def html_body(
    blocks: Column, kinds: Column, paths: Column | None = None, present: Column | None = None, headings_before: Column | int = 0
) -> Column:
    """Body HTML from block sources and their kinds.

    List tags depend on the neighbouring kinds only. Headings get their ordinal
    by cutting the result at "<h", which escaped text cannot contain. With the
    figures' ``paths`` and flags of the ``present`` ones the others are marked.
    """

    def render(block: Column, i: Column) -> Column:
        kind = F.get(kinds, i)
        text = trim_blank(block)
        tag = _list_tag(kind)
        before = F.coalesce(_list_tag(F.get(kinds, i - 1)), F.lit(""))
        after = F.coalesce(_list_tag(F.get(kinds, i + 1)), F.lit(""))
        item = F.concat(
            F.when(before != tag, F.concat(F.lit("<"), tag, F.lit(">\n"))).otherwise(""),
            F.lit("<li>"), inline_html(item_text(text)), F.lit("</li>"),
            F.when(after != tag, F.concat(F.lit("\n</"), tag, F.lit(">"))).otherwise(""),
        )
        level = heading_level(text).cast("string")
        heading = F.concat(
            F.lit("<h"), level, F.lit(">"), inline_html(heading_text(text)), F.lit("</h"), level, F.lit(">")
        )
        return (
            F.when(kind == "heading", heading)
            .when(tag.isNotNull(), item)
            .when(kind == "math", F.concat(
                F.lit(DISPLAY_OPEN), math_element(display_math(block), "block"), F.lit(DISPLAY_CLOSE)))
            .when(kind == "page_break", F.lit(BREAK_ELEMENT))
            .when(kind == "paragraph", F.concat(F.lit("<p>"), inline_html(text), F.lit("</p>")))
        )

    body = F.array_join(F.filter(F.transform(blocks, render), lambda x: x.isNotNull()), "\n")
    if present is not None:
        body = _mark_missing(body, paths, present)
    numbered = F.transform(
        F.split(body, "<h(?=[1-4]>)", -1),
        lambda part, n: F.when(n == 0, part).otherwise(
            F.concat(
                F.lit("<h"), F.substring(part, 1, 1), F.lit(' id="section-'), (n + headings_before).cast("string"), F.lit('"'),
                F.substring(part, F.lit(2), F.length(part)),
            )
        ),
    )
    return F.array_join(numbered, "")


def headings(markdown: Column) -> Column:
    """Heading lines of the raw source, in order; these feed the outline."""
    return F.filter(lines(markdown), lambda line: heading_level(line) > 0)


def html_contents(markdown: Column) -> Column:
    """Table of contents, empty without headings."""
    return let(contents_entries(markdown), wrap_contents)


def wrap_contents(joined: Column) -> Column:
    return F.when(joined == "", joined).otherwise(F.concat(F.lit(TOC_OPEN), joined, F.lit(TOC_CLOSE)))


def contents_entries(markdown: Column, headings_before: Column | int = 0) -> Column:
    """Entries of the table of contents, as one text."""
    entries = F.transform(
        headings(markdown),
        lambda line, i: F.concat(
            F.lit('<li class="level-'), heading_level(line).cast("string"), F.lit('"><a href="#section-'),
            (i + 1 + headings_before).cast("string"), F.lit('">'), escape_html(heading_text(line)), F.lit("</a></li>"),
        ),
    )
    return F.array_join(entries, "")


def _is_bullet(line: Column) -> Column:
    return F.startswith(line, F.lit("- ")) | F.startswith(line, F.lit("* "))


_SECTIONS = {4: "paragraph", 3: "subsubsection", 2: "subsection", 1: "section"}
_FIGURE = r"(?s)\A!\[(.*?)\]\((.*)\)\z"


def latex_body(trimmed: Column) -> Column:
    """LaTeX body from trimmed lines; only bullets form lists."""

    def render(line: Column, i: Column) -> Column:
        listed = F.coalesce(_is_bullet(F.get(trimmed, i - 1)), F.lit(False))
        goes_on = F.coalesce(_is_bullet(F.get(trimmed, i + 1)), F.lit(False))
        bullet = F.concat(
            F.when(listed, "").otherwise("\\begin{itemize}\n"),
            F.lit("\\item "), escape_tex_prose(F.substring(line, F.lit(3), F.length(line))),
            F.when(goes_on, "").otherwise("\n\\end{itemize}"),
        )
        out = F.when(_is_bullet(line), bullet).when(line.isin(PAGE_BREAKS), F.lit("\\clearpage"))
        level = heading_level(line)
        for depth, command in _SECTIONS.items():
            out = out.when(
                level == depth, F.concat(F.lit(f"\\{command}{{"), escape_tex(heading_text(line)), F.lit("}"))
            )
        figure = F.concat(
            F.lit(TEX_FIGURE),
            escape_tex(F.regexp_extract(line, _FIGURE, 2)), F.lit(TEX_CAPTION),
            escape_tex(F.regexp_extract(line, _FIGURE, 1)), F.lit(TEX_FIGURE_END),
        )
        return (
            out.when(line.rlike(_FIGURE), figure)
            .when(line == "", line)
            .otherwise(F.concat(escape_tex_prose(line), F.lit("\\par")))
        )

    return F.array_join(F.transform(trimmed, render), "\n")


# Matrix environments in the order they are looked for.
MATRIX_ENVIRONMENTS = ["pmatrix", "bmatrix", "matrix", "vmatrix", "array"]


def matrix_environment(tex: Column) -> Column:
    found = F.lit(None).cast("string")
    for name in reversed(MATRIX_ENVIRONMENTS):
        found = F.when(F.contains(tex, F.lit(f"\\begin{{{name}}}")), F.lit(name)).otherwise(found)
    return found


def matrix_cells(tex: Column) -> Column:
    """array<array<string>> of trimmed cells of the first matrix; null without one."""
    result = F.lit(None).cast("array<array<string>>")
    for name in reversed(MATRIX_ENVIRONMENTS):
        begin, end = f"\\begin{{{name}}}", f"\\end{{{name}}}"
        rest = F.substring(tex, F.position(F.lit(begin), tex) + len(begin), F.length(tex))
        inner = F.substring_index(rest, end, 1)
        if name == "array":
            inner = F.regexp_replace(inner, r"\A[\t-\r\x{85}\p{Z}]*+\{[^}]*+\}", "")
        rows = F.filter(F.split(inner, r"\\\\", -1), lambda row: trim_all(row) != "")
        cells = F.transform(rows, lambda row: F.transform(F.split(row, "&", -1), trim_all))
        result = F.when(
            F.contains(tex, F.lit(begin)), F.when(F.contains(rest, F.lit(end)), cells)
        ).otherwise(result)
    return result
