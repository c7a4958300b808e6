"""Markdown corpus: blocks, outline, math, figures, HTML and LaTeX text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import markup as m
from quire.operators import jobs
from quire.operators import markdown as md
from quire.plans import flows

from . import relations as r


def sources(spark, sf_dir):
    """Web pages as Markdown, followed by math, figures and marks built from their columns."""
    i = F.col("doc_id").cast("string")
    extra = F.concat(
        F.lit("\n$$\n\\alpha_"), i, F.lit(" \\le \\foo{x}\n$$ tail $$\n## Part "), i,
        F.lit("\n  $ \\begin{array}{cc}\n  a & b_"), i, F.lit(" \\\\\n c & d \\end{array} $\n1. first **bold** & $x_"), i,
        F.lit("$\n2) second [unclear: w"), i, F.lit("] and [UNCLEAR: z]\n* star ![assets/f"), i, F.lit("](assets/f"), i,
        F.lit(".png)\n![alt](../x.jpg) ![cap \"q\"](img/p.JPEG)\n<!-- page-break -->\n#### Deep $$ ~^ \\ {a}\n##### no\n"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("$$ one $$\n$open without end\n")).otherwise(F.lit("$$ open\nuntil the end\n")),
    )
    return r.markdown_sources(spark, sf_dir).withColumn("markdown", F.concat("markdown", extra))


def _pages_of_lines(spark, sf_dir):
    """The same sources as jobs whose pages hold four lines each, so that math runs across page breaks."""
    lines = F.split("markdown", "\n", -1)
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 4).cast("int")), lambda i: F.array_join(F.slice(lines, i * 4 + 1, F.lit(4)), "\n")
    )
    return sources(spark, sf_dir).select(F.col("doc_id").alias("job_id"), F.posexplode(pages).alias("page_index", "final_markdown"))


def sources_in_parts(spark, sf_dir):
    """Assembled in parts of two pages."""
    return jobs.assemble_markdown(_pages_of_lines(spark, sf_dir), part_pages=2).withColumnRenamed("job_id", "doc_id")


SQL_EXTRA = r"""
src AS (
  SELECT doc_id, markdown || chr(10) || '$$' || chr(10) || '\alpha_' || doc_id || ' \le \foo{x}' || chr(10)
    || '$$ tail $$' || chr(10) || '## Part ' || doc_id || chr(10) || '  $ \begin{array}{cc}' || chr(10) || '  a & b_' || doc_id
    || ' \\' || chr(10) || ' c & d \end{array} $' || chr(10) || '1. first **bold** & $x_' || doc_id || '$' || chr(10)
    || '2) second [unclear: w' || doc_id || '] and [UNCLEAR: z]' || chr(10) || '* star ![assets/f' || doc_id || '](assets/f'
    || doc_id || '.png)' || chr(10) || '![alt](../x.jpg) ![cap "q"](img/p.JPEG)' || chr(10) || '<!-- page-break -->' || chr(10)
    || '#### Deep $$ ~^ \ {a}' || chr(10) || '##### no' || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN '$$ one $$' || chr(10) || '$open without end' || chr(10)
            ELSE '$$ open' || chr(10) || 'until the end' || chr(10) END AS markdown
  FROM sources)"""

#: The same, with a page break after every four lines; it knows no parts.
SQL_PAGED = SQL_EXTRA.replace("src AS (", "flat AS (", 1) + r"""
, fl AS (SELECT doc_id, string_split(markdown, chr(10)) AS ls FROM flat),
fi AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS i, unnest(ls) AS raw FROM fl),
pg AS (SELECT doc_id, i // 4 AS page_index, string_agg(raw, chr(10) ORDER BY i) AS final_markdown FROM fi GROUP BY ALL),
src AS (SELECT doc_id, string_agg(final_markdown, chr(10) || chr(10) || '<div class="page-break"></div>' || chr(10) || chr(10)
          ORDER BY page_index) AS markdown FROM pg GROUP BY 1)"""

_TRIM = r"regexp_replace({0}, '^[\t\p{{Zs}}]+|[\t\p{{Zs}}]+$', '', 'g')"

# The line-by-line state machine as a recursive walk from block start to block start.
SQL_BLOCKS = f"""
WITH RECURSIVE {r.SQL_SOURCES}, {SQL_EXTRA},
spl AS (SELECT doc_id, string_split(replace(markdown, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM src),
ln AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS i, unnest(ls) AS raw, len(ls) AS n FROM spl),
tr AS (SELECT *, {_TRIM.format('raw')} AS t FROM ln),
nx AS (SELECT *, min(CASE WHEN t LIKE '%$' THEN i END) OVER w AS dollar, min(CASE WHEN contains(raw, '$$') THEN i END) OVER w AS pair
       FROM tr WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
st AS (SELECT *, CASE
         WHEN t IN ('<div class="page-break"></div>', '<!-- page-break -->') THEN 'page_break'
         WHEN t LIKE '$%' AND t NOT LIKE '$$%' AND NOT contains(substr(t, 2), '$') AND dollar IS NOT NULL THEN 'single'
         WHEN t LIKE '$$%' AND substr(t, 3) LIKE '%$$' THEN 'one'
         WHEN t LIKE '$$%' THEN 'several'
         WHEN t = '' THEN 'blank'
         WHEN regexp_matches(t, '^#{{1,4}} ') THEN 'heading'
         WHEN t LIKE '- %' OR t LIKE '* %' THEN 'item'
         WHEN regexp_matches(t, '^\\p{{Nd}}+[.)][\\t-\\r\\x{{85}}\\p{{Z}}]+') THEN 'ordered_item'
         ELSE 'paragraph' END AS k FROM nx),
go AS (SELECT *, CASE k WHEN 'single' THEN dollar + 1 WHEN 'several' THEN coalesce(pair + 1, n) ELSE i + 1 END AS nxt FROM st),
walk AS (SELECT doc_id, 0 AS i FROM spl UNION ALL
         SELECT walk.doc_id, go.nxt FROM walk JOIN go ON go.doc_id = walk.doc_id AND go.i = walk.i WHERE go.nxt < go.n),
blk AS (SELECT go.*, CAST(row_number() OVER (PARTITION BY go.doc_id ORDER BY go.i) - 1 AS INTEGER) AS position,
               CASE WHEN k IN ('single', 'one', 'several') THEN 'math' ELSE k END AS kind
        FROM walk JOIN go ON go.doc_id = walk.doc_id AND go.i = walk.i),
bsrc AS (SELECT b.doc_id, b.position, string_agg(tr.raw, chr(10) ORDER BY tr.i) AS source
         FROM blk b JOIN tr ON tr.doc_id = b.doc_id AND tr.i >= b.i AND tr.i < b.nxt GROUP BY ALL),
bt AS (SELECT blk.*, bsrc.source, CASE kind WHEN 'heading' THEN regexp_replace(t, '^#{{1,4}} ', '')
              WHEN 'item' THEN substr(t, 3) WHEN 'ordered_item' THEN regexp_replace(t, '^\\p{{Nd}}+[.)][\\t-\\r\\x{{85}}\\p{{Z}}]+', '')
              WHEN 'paragraph' THEN t END AS body
       FROM blk JOIN bsrc USING (doc_id, position)),
mt AS (SELECT doc_id, position, k, CASE k
         WHEN 'one' THEN left(substr(t, 3), length(t) - 4)
         WHEN 'several' THEN substr(t, 3) || CASE WHEN contains(source, chr(10))
              THEN chr(10) || replace(substr(source, strpos(source, chr(10)) + 1), '$$', '') ELSE '' END
         ELSE (SELECT left(x, length(x) - 1) FROM (SELECT substr(array_to_string(list_transform(string_split(source, chr(10)),
               lambda q: {_TRIM.format('q')}), chr(10)), 2) AS x)) END AS tex
       FROM bt WHERE kind = 'math'),
sp AS (SELECT doc_id, position, regexp_extract_all(body,
         '(?s)!\\[[^\\]]*\\]\\([^)]*\\)|\\*\\*.*?\\*\\*|\\$[^$]*\\$|\\[unclear:[^\\]]*\\]|[^!*$\\[]+|.') AS ss FROM bt WHERE body IS NOT NULL),
su AS (SELECT doc_id, position, CAST(unnest(range(len(ss))) AS INTEGER) AS span_index, unnest(ss) AS span FROM sp),
sk AS (SELECT *, CASE WHEN regexp_full_match(span, '!\\[[^\\]]*\\]\\([^)]*\\)') THEN 'image'
                      WHEN length(span) >= 4 AND span LIKE '**%' AND span LIKE '%**' THEN 'bold'
                      WHEN regexp_full_match(span, '\\$[^$]*\\$') THEN 'math'
                      WHEN regexp_full_match(span, '\\[unclear:[^\\]]*\\]') THEN 'unclear' ELSE 'text' END AS span_kind FROM su)"""

_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_MATH = '\'<math xmlns="http://www.w3.org/1998/Math/MathML" display="{0}"><mtext>\' || {1} || \'</mtext></math>\''
_ALT = r"regexp_extract(span, '^!\[([^\]]*)\]\(', 1)"
_PATH = r"regexp_extract(span, '^!\[[^\]]*\]\(([^)]*)\)', 1)"

SQL_HTML = SQL_BLOCKS + f""",
cap AS (SELECT *, CASE WHEN {_ALT} = {_PATH} OR starts_with({_ALT}, 'assets/') THEN 'Source figure' ELSE {_ALT} END AS cap FROM sk),
ih AS (SELECT doc_id, position, string_agg(CASE span_kind
         WHEN 'bold' THEN '<strong>' || {_ESC.format("substr(span, 3, length(span) - 4)")} || '</strong>'
         WHEN 'math' THEN {_MATH.format('inline', _ESC.format("substr(span, 2, length(span) - 2)"))}
         WHEN 'unclear' THEN '<span class="unclear">' || {_ESC.format('span')} || '</span>'
         WHEN 'image' THEN CASE WHEN contains({_PATH}, '..') OR starts_with({_PATH}, '/') OR contains({_PATH}, '://')
              THEN '<span class="unclear">[blocked image path]</span>'
              ELSE '<figure><img alt="' || {_ESC.format('cap')} || '" src="' || {_ESC.format(_PATH)} || '"><figcaption>'
                   || {_ESC.format('cap')} || '</figcaption></figure>' END
         ELSE {_ESC.format('span')} END, '' ORDER BY span_index) AS html FROM cap GROUP BY ALL),
tg AS (SELECT bt.*, coalesce(ih.html, '') AS html, CASE kind WHEN 'item' THEN 'ul' WHEN 'ordered_item' THEN 'ol' END AS tag, tex,
              sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS ord
       FROM bt LEFT JOIN ih USING (doc_id, position) LEFT JOIN mt USING (doc_id, position)),
nb AS (SELECT *, coalesce(lag(tag) OVER w, '') AS pt, coalesce(lead(tag) OVER w, '') AS nt FROM tg
       WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
pc AS (SELECT doc_id, position, CASE
         WHEN kind = 'heading' THEN '<h' || length(regexp_extract(t, '^#+')) || ' id="section-' || ord || '">' || html
              || '</h' || length(regexp_extract(t, '^#+')) || '>'
         WHEN tag IS NOT NULL THEN CASE WHEN pt <> tag THEN '<' || tag || '>' || chr(10) ELSE '' END || '<li>' || html || '</li>'
              || CASE WHEN nt <> tag THEN chr(10) || '</' || tag || '>' ELSE '' END
         WHEN kind = 'math' THEN '<div class="display-math">' || {_MATH.format('block', _ESC.format('tex'))} || '</div>'
         WHEN kind = 'page_break' THEN '<div class="page-break" aria-hidden="true"></div>'
         WHEN kind = 'paragraph' THEN '<p>' || html || '</p>' END AS piece FROM nb),
body AS (SELECT doc_id, string_agg(piece, chr(10) ORDER BY position) AS body FROM pc WHERE piece IS NOT NULL GROUP BY 1),
hd AS (SELECT doc_id, i, raw, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o FROM ln WHERE regexp_matches(raw, '^#{{1,4}} ')),
toc AS (SELECT doc_id, string_agg('<li class="level-' || length(regexp_extract(raw, '^#+')) || '"><a href="#section-' || o || '">'
          || {_ESC.format("regexp_replace(raw, '^#{1,4} ', '')")} || '</a></li>', '' ORDER BY o) AS toc FROM hd GROUP BY 1)
SELECT doc_id, coalesce('<nav class="toc" aria-label="Table of contents"><h2>Contents</h2><ol>' || toc || '</ol></nav>', '')
       || chr(10) || body AS html FROM body LEFT JOIN toc USING (doc_id)"""

_TEX = (
    "replace(replace(replace(regexp_replace(replace({0}, '\\', chr(1)), '[&%$#_{{}}]', '\\\\\\0', 'g'), "
    "'~', '\\textasciitilde{{}}'), '^', '\\textasciicircum{{}}'), chr(1), '\\textbackslash{{}}')"
)


def _sql_prose(text: str) -> str:
    """Token fold: a "$" pair is one token; prose is escaped while no math is open."""
    start = "{'o': '', 'm': 0, 't': ''}"
    token = "lambda w: {'o': '', 'm': 0, 't': w}"
    return (
        f"list_reduce(list_prepend({start}, list_transform(regexp_extract_all({text}, '(?s)\\$\\$|\\$|[^$]+'), {token})), "
        "lambda a, b: {'o': a.o || CASE WHEN b.t LIKE '$%' OR a.m <> 0 THEN b.t ELSE "
        + _TEX.format("b.t")
        + " END, 'm': CASE WHEN b.t NOT LIKE '$%' THEN a.m WHEN a.m = 0 THEN length(b.t) "
        "WHEN a.m = length(b.t) THEN 0 ELSE a.m END, 't': ''}).o"
    )


SQL_LATEX_LINES = rf"""
WITH {r.SQL_SOURCES}, {SQL_EXTRA},
spl AS (SELECT doc_id, string_split(replace(markdown, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM src),
ln AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS i, unnest(ls) AS raw FROM spl),
tr AS (SELECT *, {_TRIM.format('raw')} AS t FROM ln),
nb AS (SELECT *, t LIKE '- %' OR t LIKE '* %' AS bullet FROM tr),
ng AS (SELECT *, coalesce(lag(bullet) OVER w, false) AS pb, coalesce(lead(bullet) OVER w, false) AS fb,
              length(regexp_extract(t, '^(#{{1,4}}) ', 1)) AS lv, regexp_replace(t, '^#{{1,4}} ', '') AS ht,
              regexp_extract(t, '^!\[(.*?)\]\((.*)\)$', 1) AS alt, regexp_extract(t, '^!\[(.*?)\]\((.*)\)$', 2) AS path
       FROM nb WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
pc AS (SELECT doc_id, i, CASE
         WHEN bullet THEN CASE WHEN pb THEN '' ELSE '\begin{{itemize}}' || chr(10) END || '\item ' || {_sql_prose('substr(t, 3)')}
              || CASE WHEN fb THEN '' ELSE chr(10) || '\end{{itemize}}' END
         WHEN t IN ('<div class="page-break"></div>', '<!-- page-break -->') THEN '\clearpage'
         WHEN lv > 0 THEN '\' || ['section','subsection','subsubsection','paragraph'][lv] || '{{' || {_TEX.format('ht')} || '}}'
         WHEN regexp_matches(t, '^!\[(.*?)\]\((.*)\)$') THEN
              '\begin{{figure}}[htbp]\centering\includegraphics[width=.92\linewidth]{{' || {_TEX.format('path')}
              || '}}\caption{{' || {_TEX.format('alt')} || '}}\end{{figure}}'
         WHEN t = '' THEN '' ELSE {_sql_prose('t')} || '\par' END AS piece FROM ng)
SELECT doc_id, string_agg(piece, chr(10) ORDER BY i) AS latex FROM pc GROUP BY 1"""


def markdown_blocks(spark, sf_dir):
    return md.block_table(sources(spark, sf_dir))


def outline(spark, sf_dir):
    return md.outline(sources(spark, sf_dir))


def body_headings(spark, sf_dir):
    return md.body_headings(sources(spark, sf_dir))


def list_runs(spark, sf_dir):
    return md.list_runs(sources(spark, sf_dir))


def inline_spans(spark, sf_dir):
    return md.spans(sources(spark, sf_dir))


def math_inventory(spark, sf_dir):
    return md.math_inventory(sources(spark, sf_dir))


def command_usage(spark, sf_dir):
    return md.command_usage(md.math_inventory(sources(spark, sf_dir)))


def _figure_files(spark, sf_dir):
    """A figure file exists for even pages."""
    return r.table(spark, sf_dir, "pages").filter("page_id % 2 = 0").select(
        F.col("page_id").alias("doc_id"), F.concat(F.lit("assets/f"), "page_id", F.lit(".png")).alias("path")
    )


def figure_report(spark, sf_dir):
    return md.figure_report(sources(spark, sf_dir), _figure_files(spark, sf_dir))


def html_with_figures(spark, sf_dir):
    """Figures whose file is not listed are marked as missing."""
    return md.to_html(sources(spark, sf_dir), _figure_files(spark, sf_dir))


def blocks_in_parts(spark, sf_dir):
    return md.block_table(sources_in_parts(spark, sf_dir))


def outline_in_parts(spark, sf_dir):
    return md.outline(sources_in_parts(spark, sf_dir))


def headings_in_parts(spark, sf_dir):
    return md.body_headings(sources_in_parts(spark, sf_dir))


def published_parts(spark, sf_dir):
    """Sources in parts of two pages, rendered part by part and put together: one row a source."""
    return flows.publish_sources(sources_in_parts(spark, sf_dir), _figure_files(spark, sf_dir))


def uncertain_counts(spark, sf_dir):
    return md.uncertain_counts(sources(spark, sf_dir))


def html_text(spark, sf_dir):
    return md.to_html(sources(spark, sf_dir))


def latex_text(spark, sf_dir):
    return md.to_latex(sources(spark, sf_dir))


def matrix_cells(spark, sf_dir):
    """Each document as a matrix: lines are rows, commas separate cells."""
    body = F.replace(F.replace("text", F.lit("\n"), F.lit(" \\\\ ")), F.lit(","), F.lit(" &"))
    tex = F.concat(F.lit("x \\begin{pmatrix} "), body, F.lit("\\end{pmatrix} y"))
    return md.matrices(r.table(spark, sf_dir, "documents").select("doc_id", tex.alias("tex")))


def escaped_text(spark, sf_dir):
    rows = sources(spark, sf_dir)
    return rows.select(
        "doc_id", m.escape_html(F.col("markdown")).alias("html"), m.escape_tex(F.col("markdown")).alias("tex")
    )


def prose_escape(spark, sf_dir):
    """TeX escape of whole document texts, math kept."""
    rows = r.table(spark, sf_dir, "documents")
    return rows.select("doc_id", m.escape_tex_prose(F.col("text")).alias("tex"))


def _sql_known() -> str:
    rows = [(c, "structure", None) for c in md.TEX_STRUCTURES] + [(c, "symbol", s) for c, s in md.TEX_SYMBOLS.items()]
    rows += [(c, "greek", s) for c, s in md.TEX_GREEK.items()]
    return ", ".join(f"('{c}', '{k}', {'NULL' if s is None else repr(s)})" for c, k, s in rows)


QUERIES = {
    f.__name__: f
    for f in (
        markdown_blocks, outline, body_headings, list_runs, inline_spans, math_inventory, command_usage, figure_report,
        uncertain_counts, html_text, latex_text, matrix_cells, escaped_text, prose_escape, html_with_figures, blocks_in_parts,
        outline_in_parts, headings_in_parts, published_parts,
    )
}

_MISSING_SQL = SQL_HTML.replace(
    "ELSE '<figure><img",
    f"WHEN NOT (doc_id % 2 = 0 AND {_PATH} = 'assets/f' || doc_id || '.png') THEN '<span class=\"unclear\">[missing figure: ' || "
    + _ESC.format(_PATH) + " || ']</span>' ELSE '<figure><img", 1,
)


def _paged(sql: str) -> str:
    return sql.replace(SQL_EXTRA, SQL_PAGED)


_OUTLINE = (
    f"{SQL_BLOCKS}, hd AS (SELECT doc_id, raw, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) "
    "AS ordinal FROM ln WHERE regexp_matches(raw, '^#{1,4} ')) SELECT doc_id, ordinal, "
    "CAST(length(regexp_extract(raw, '^#+')) AS INTEGER) AS level, regexp_replace(raw, '^#{1,4} ', '') AS heading, "
    "'section-' || ordinal AS anchor FROM hd"
)
_HEADINGS = (
    f"{SQL_BLOCKS} SELECT doc_id, 'section-' || row_number() OVER (PARTITION BY doc_id ORDER BY position) "
    "AS anchor, CAST(length(regexp_extract(t, '^#+')) AS INTEGER) AS level, body AS heading FROM bt WHERE kind = 'heading'"
)
_UNCERTAIN = (
    f"WITH {r.SQL_SOURCES}, {SQL_EXTRA} SELECT doc_id, CAST(len(regexp_extract_all(markdown, "
    r"'(?i)\[unclear:\s*[^\]]*\]')) AS INTEGER) AS uncertain_count FROM src"
)
_INVENTORY = (
    "SELECT doc_id, position, true AS display, tex FROM mt UNION ALL "
    "SELECT doc_id, position, false, substr(span, 2, length(span) - 2) FROM sk WHERE span_kind = 'math'"
)
ORACLE = {
    "markdown_blocks": f"{SQL_BLOCKS} SELECT doc_id, position, kind, source FROM bt",
    "outline": _OUTLINE,
    "body_headings": _HEADINGS,
    "blocks_in_parts": _paged(f"{SQL_BLOCKS} SELECT doc_id, position, kind, source FROM bt"),
    "outline_in_parts": _paged(_OUTLINE),
    "headings_in_parts": _paged(_HEADINGS),
    "published_parts": f"SELECT doc_id, html, latex, uncertain_count FROM ({_paged(_MISSING_SQL)}) JOIN ({_paged(SQL_LATEX_LINES)}) "
    f"USING (doc_id) JOIN ({_paged(_UNCERTAIN)}) USING (doc_id)",
    "html_with_figures": _MISSING_SQL,
    "list_runs": f"{SQL_BLOCKS}, g AS (SELECT doc_id, position, CASE kind WHEN 'item' THEN 'ul' WHEN 'ordered_item' THEN 'ol' END "
    "AS tag FROM bt), f AS (SELECT *, tag IS NOT NULL AND tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY doc_id "
    "ORDER BY position) AS fresh FROM g), s AS (SELECT *, CAST(count(*) FILTER (fresh) OVER (PARTITION BY doc_id "
    "ORDER BY position) AS INTEGER) AS run FROM f) SELECT doc_id, run, tag, min(position) AS first_position, "
    "count(*) AS items FROM s WHERE tag IS NOT NULL GROUP BY ALL",
    "inline_spans": f"{SQL_BLOCKS} SELECT doc_id, position, span_index, span, span_kind FROM sk",
    "math_inventory": f"{SQL_BLOCKS} {_INVENTORY}",
    "command_usage": f"{SQL_BLOCKS}, inv AS ({_INVENTORY}), known(command, class, shown) AS (VALUES {_sql_known()}), "
    "c AS (SELECT unnest(regexp_extract_all(tex, '\\\\(\\p{L}+)', 1)) AS command FROM inv) "
    "SELECT command, count(*) AS uses, coalesce(any_value(class), 'unsupported') AS class, any_value(shown) AS shown "
    "FROM c LEFT JOIN known USING (command) GROUP BY command",
    "figure_report": f"{SQL_BLOCKS}, l AS (SELECT doc_id, position, span_index, {_PATH} AS path, {_ALT} AS alt FROM sk "
    "WHERE span_kind = 'image') SELECT *, CASE WHEN contains(path, '..') OR starts_with(path, '/') OR contains(path, '://') "
    "THEN 'blocked' WHEN doc_id % 2 = 0 AND path = 'assets/f' || doc_id || '.png' THEN 'ok' ELSE 'missing' END AS status, "
    "CASE WHEN alt = path OR starts_with(alt, 'assets/') THEN 'Source figure' ELSE alt END AS caption, "
    "CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' "
    "WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' ELSE 'image/png' END AS media_type FROM l",
    "uncertain_counts": _UNCERTAIN,
    "html_text": SQL_HTML,
    "latex_text": SQL_LATEX_LINES,
    "prose_escape": f"SELECT doc_id, {_sql_prose('text')} AS tex FROM documents",
    "matrix_cells": r"""
WITH x AS (SELECT doc_id, list_filter(string_split(replace(replace(text, chr(10), ' \\ '), ',', ' &'), '\\'),
             lambda s: trim(s) <> '') AS rs FROM documents),
y AS (SELECT doc_id, CAST(unnest(range(len(rs))) AS INTEGER) AS row, string_split(unnest(rs), '&') AS cs FROM x)
SELECT doc_id, 'pmatrix' AS environment, row, CAST(unnest(range(len(cs))) AS INTEGER) AS column,
       trim(unnest(cs)) AS cell FROM y""",
    "escaped_text": f"WITH {r.SQL_SOURCES}, {SQL_EXTRA} SELECT doc_id, {_ESC.format('markdown')} AS html, "
    f"{_TEX.format('markdown')} AS tex FROM src",
}
