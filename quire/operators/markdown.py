"""Markdown-corpus operators. Sources: ``doc_id``, ``markdown``, and ``part`` where sources come in parts.

A source is one value, so its blocks are cut and rendered inside its row with
array expressions: no shuffle, and a long source is linear work. Only the
inventories that leave the row (outline, math, figures, commands) explode.

Parts are cut at page breaks, as ``jobs.assemble_markdown`` does; the break itself
is in none of them. Math that is open there moves to the part it began in
(``settle``); numbers of blocks and headings go on from part to part, so every
result is that of the source as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as m
from ..functions.assets import figure_caption, is_blocked_path, media_type
from ..functions.text import trim_blank
from ..runtime import broadcast_if_small, cut, written
from .jobs import PAGE_BREAK
from .ordered import Ordered, per_group, same_keys
from .parts import PART, later_parts, several_parts, sums_before

# TeX commands the math display knows, and what they stand for.
TEX_STRUCTURES = [
    "frac", "sqrt", "bar", "overline", "vec", "boxed", "mathbb", "mathcal", "mathfrak", "mathbf", "mathrm",
    "text", "operatorname", "quad", "qquad", "left", "right",
]
TEX_SYMBOLS = {
    "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "neq": "≠", "approx": "≈", "infty": "∞", "cup": "∪", "cap": "∩",
    "subset": "⊂", "subseteq": "⊆", "supset": "⊃", "supseteq": "⊇", "in": "∈", "notin": "∉", "to": "→",
    "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftarrow": "⇐", "leftrightarrow": "↔",
    "Leftrightarrow": "⇔", "iff": "⇔", "implies": "⇒", "langle": "⟨", "rangle": "⟩", "checkmark": "✓", "sum": "∑",
    "prod": "∏", "int": "∫", "partial": "∂", "nabla": "∇", "times": "×", "cdot": "·", "pm": "±", "ldots": "…",
    "dots": "…", "cdots": "⋯", "mapsto": "↦", "forall": "∀", "exists": "∃", "neg": "¬",
}
TEX_GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ϵ", "zeta": "ζ", "eta": "η",
    "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π",
    "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "ϕ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ",
    "Omega": "Ω",
}


def _own_lines(sources: DataFrame) -> DataFrame:
    """Text of a part without the line end that belongs to the part before it."""
    return sources.withColumn("markdown", F.when(F.col("_later"), F.regexp_replace("markdown", r"\A\r?\n", "")).otherwise(F.col("markdown")))


def _with_breaks(parts: DataFrame, several: DataFrame | None) -> DataFrame:
    """Parts after the first with the page break in front of them, so that they stand one directly behind the other."""
    text = F.col("markdown")
    led = F.when(F.col("_later"), F.concat(F.lit(PAGE_BREAK), text)).otherwise(text)
    return later_parts(parts.select("doc_id", PART, "markdown"), ["doc_id"], several).select("doc_id", PART, led.alias("markdown"))


def settle(sources: DataFrame) -> DataFrame:
    """(doc_id, part, markdown): parts of the same sources, cut so that no block reaches into the next part.

    All but the first begin with a line end; one directly behind the other they are the whole.
    Each part tells, for each state it may begin in, the state it ends in; folded over the few parts of a source that
    gives where a block is open. The text up to its end moves to the part it began in. A block is one value, so a block
    that is never closed gathers the rest of its source.
    """
    several = several_parts(sources, ["doc_id"])
    parts = _with_breaks(sources, several)
    if several is None:
        return parts
    within = parts.join(broadcast_if_small(several.select("doc_id")), "doc_id", "left_semi")
    own = _own_lines(later_parts(within, ["doc_id"], several))
    text = F.col("markdown")
    last_closing = own.groupBy("doc_id").agg(F.max(F.when(m.has_closing_line(text), F.col(PART))).alias("_closing"))
    follows = F.coalesce(F.col(PART) < F.col("_closing"), F.lit(False))
    tables = own.join(broadcast_if_small(cut(last_closing)), "doc_id").select(
        "doc_id", PART, m.open_states(text, follows).alias("ends"), m.closes(text).alias("closes")
    )

    def step(state: Column, row: Column) -> Column:
        at = state["open"]
        end = F.get(row["ends"], at)
        swallowed = (at != m.NOTHING) & ~F.get(row["closes"], at)
        here = F.struct(row[PART].alias(PART), at.alias("_state"), state["owner"].alias("_owner"))
        return F.struct(
            end.alias("open"), F.when(swallowed, state["owner"]).otherwise(row[PART]).alias("owner"),
            F.array_append(state["rows"], here).alias("rows"),
        )

    start = F.struct(
        F.lit(m.NOTHING).alias("open"), F.lit(0).alias("owner"), F.array().cast(f"array<struct<{PART}:int,_state:int,_owner:int>>").alias("rows")
    )
    rows = F.array_sort(F.collect_list(F.struct(F.col(PART).cast("int").alias(PART), "ends", "closes")))
    folded = tables.groupBy("doc_id").agg(F.aggregate(rows, start, step, lambda state: state["rows"]).alias("_rows"))
    open_parts = cut(folded.select("doc_id", F.inline("_rows")).filter(F.col("_state") != m.NOTHING))
    if not open_parts.take(1):
        return parts
    moved = broadcast_if_small(open_parts.select("doc_id").distinct())
    joined = parts.join(moved, "doc_id", "left_semi").alias("a").join(
        broadcast_if_small(open_parts).alias("b"), same_keys(["doc_id", PART]), "left"
    ).select("a.*", F.coalesce("b._state", F.lit(m.NOTHING)).alias("_state"), "b._owner")
    plain = m.normalize_newlines(F.col("markdown"))
    # the line end in front of a later part's first line goes with that line
    first_line = F.concat(F.lit("\n"), m.continued(F.substring(plain, F.lit(2), F.length(plain)), F.col("_state")))
    head = F.when(F.col("_state") == m.NOTHING, "").otherwise(first_line)
    rows = joined.withColumn("_head", head).withColumn("_tail", F.substring(plain, F.length("_head") + 1, F.length(plain)))
    piece = F.inline(
        F.array(
            F.struct(F.col("_owner").alias("_to"), F.col("_head").alias("_text")),
            F.struct(F.col(PART).cast("int").alias("_to"), F.col("_tail").alias("_text")),
        )
    )
    pieces = rows.select("doc_id", F.col(PART).alias("_from"), piece).filter("_text <> ''")
    settled = pieces.groupBy("doc_id", F.col("_to").alias(PART)).agg(
        F.expr("listagg(_text, '') within group (order by _from)").alias("markdown")
    )
    return parts.join(moved, "doc_id", "left_anti").unionByName(settled)


class _Parts:
    """Sources ready for cutting: settled, with own lines only, and what their earlier parts count.

    Parts are read many times, so sources and settled parts are written once.
    """

    def __init__(self, sources: DataFrame):
        self.parted = PART in sources.columns
        self.several = None
        if not self.parted:
            self.rows = sources.withColumn("_later", F.lit(False))
            return
        settled = written(settle(written(sources.select("doc_id", PART, "markdown"))))
        self.several = several_parts(settled, ["doc_id"])
        self.rows = _own_lines(later_parts(settled, ["doc_id"], self.several))

    def counting(self, counts: dict[str, Column]) -> DataFrame:
        """Rows with the sums of earlier parts; 0 where sources are one value."""
        return sums_before(self.rows, ["doc_id"], counts, self.several)


def block_table(sources: DataFrame) -> DataFrame:
    """One row per block: position, kind and source text."""
    blocks = m.raw_blocks(F.col("markdown"))
    rows = _Parts(sources).counting({"_before": F.size(blocks)})
    rows = rows.select("doc_id", "_before", F.posexplode(blocks).alias("position", "source"))
    placed = rows.withColumn("position", (F.col("position") + F.col("_before")).cast("int")).drop("_before")
    return placed.withColumn("kind", m.block_kind(F.col("source")))


def outline(sources: DataFrame) -> DataFrame:
    """Table of contents: headings of the raw lines with level, text and anchor."""
    found = m.headings(F.col("markdown"))
    rows = _Parts(sources).counting({"_before": F.size(found)})
    rows = rows.select("doc_id", "_before", F.posexplode(found).alias("_i", "_line"))
    ordinal = (F.col("_i") + F.col("_before") + 1).cast("int")
    return rows.select(
        "doc_id",
        ordinal.alias("ordinal"),
        m.heading_level(F.col("_line")).alias("level"),
        m.heading_text(F.col("_line")).alias("heading"),
        F.concat(F.lit("section-"), ordinal.cast("string")).alias("anchor"),
    )


def body_headings(sources: DataFrame) -> DataFrame:
    """Headings of the body: trimmed lines outside math, numbered as anchors.

    Kept apart from :func:`outline`, which reads raw lines; anchors may drift.
    """
    found = _body_headings()
    rows = _Parts(sources).counting({"_before": F.size(found)})
    rows = rows.select("doc_id", "_before", F.posexplode(found).alias("_i", "_line"))
    text = trim_blank(F.col("_line"))
    return rows.select(
        "doc_id",
        F.concat(F.lit("section-"), (F.col("_i") + F.col("_before") + 1).cast("string")).alias("anchor"),
        m.heading_level(text).alias("level"),
        m.heading_text(text).alias("heading"),
    )


def _body_headings() -> Column:
    return F.filter(m.raw_blocks(F.col("markdown")), lambda b: m.block_kind(b) == "heading")


def list_runs(sources: DataFrame) -> DataFrame:
    """Runs of list items: (doc_id, run, tag, first_position, items)."""
    tag = F.when(F.col("kind") == "item", "ul").when(F.col("kind") == "ordered_item", "ol")
    tags = block_table(sources).select("doc_id", "position", tag.alias("tag"))

    def number(rows: DataFrame, slices: int) -> DataFrame:
        scan = Ordered(rows, ["doc_id"], [F.col("position")], slices).lag({"_before": "tag"})
        fresh = F.col("tag").isNotNull() & ~F.col("tag").eqNullSafe(F.col("_before"))
        return scan.running_sum(F.when(fresh, 1).otherwise(0), "run").done()

    return (
        per_group(tags, ["doc_id"], number)
        .filter("tag IS NOT NULL")
        .groupBy("doc_id", F.col("run").cast("int").alias("run"), "tag")
        .agg(F.min("position").alias("first_position"), F.count("*").alias("items"))
    )


def _present_figures(rows: DataFrame, keys: list[str], files: DataFrame) -> DataFrame:
    """Add ``_present``: for each of a row's ``_paths``, whether ``files`` lists it. Only paths are shuffled to meet files."""
    links = rows.select(*keys, F.posexplode("_paths").alias("_n", "path"))
    listed = files.select("doc_id", "path").distinct().withColumn("_there", F.lit(True))
    met = links.join(listed, ["doc_id", "path"], "left").select(*keys, "_n", F.coalesce("_there", F.lit(False)).alias("_there"))
    flags = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_there"))), lambda r: r["_there"])
    gathered = met.groupBy(*keys).agg(flags.alias("_present"))
    return rows.alias("a").join(broadcast_if_small(cut(gathered)).alias("b"), same_keys(keys), "left").select("a.*", "b._present")


def to_html(sources: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(doc_id, html): contents and body; math stays TeX text inside ``math``.

    ``files`` lists (doc_id, path) of existing figures; all others are marked as missing. Without it none is.
    Sources in parts give (doc_id, part, html), in order the HTML of the whole: contents first (negative parts), then bodies.
    """
    parts = _Parts(sources)
    keys = ["doc_id", *([PART] if parts.parted else [])]
    text = F.col("markdown")
    parts.rows = parts.rows.withColumn("_blocks", m.raw_blocks(text)).withColumn("_kinds", F.transform("_blocks", m.block_kind))
    if parts.parted:
        # blocks are cut once; counting, figures and bodies read them
        titles = F.size(F.filter("_kinds", lambda kind: kind == "heading"))
        parts.rows = written(parts.rows.withColumn("_titles", F.size(m.headings(text))).withColumn("_headings", titles))
    rows = parts.counting({"_lines": F.col("_titles"), "_bodies": F.col("_headings")} if parts.parted else {})
    blocks, kinds = F.col("_blocks"), F.col("_kinds")
    figures: tuple = ()
    if files is not None:
        rows = _present_figures(rows.withColumn("_paths", m.figure_paths(blocks, kinds)), keys, files)
        figures = (F.col("_paths"), F.coalesce("_present", F.array().cast("array<boolean>")))
    if not parts.parted:
        html = F.concat(m.html_contents(text), F.lit("\n"), m.html_body(blocks, kinds, *figures))
        return rows.select("doc_id", html.alias("html"))
    return _html_parts(rows, parts, m.html_body(blocks, kinds, *(figures or (None, None)), F.col("_bodies")))


def _html_parts(rows: DataFrame, parts: _Parts, body: Column) -> DataFrame:
    """Contents and bodies of parts as rows of their own, in one order of negative and other part numbers."""
    several = parts.several
    rows = rows.withColumn("_entries", m.contents_entries(F.col("markdown"), F.col("_lines"))).withColumn("_body", body)
    if several is None:
        html = F.concat(m.wrap_contents(F.col("_entries")), F.lit("\n"), F.col("_body"))
        return rows.select("doc_id", PART, html.alias("html"))
    rows = written(rows.select("doc_id", PART, "_entries", "_body"))  # rendered once, for what shows and for the pieces
    titled = parts.rows.filter("_titles > 0").groupBy("doc_id").agg(
        F.min(PART).alias("_first"), F.max(PART).alias("_last")
    )
    ends = parts.rows.groupBy("doc_id").agg(F.max(PART).alias("_end"))
    joined = rows.join(broadcast_if_small(cut(titled)), "doc_id", "left").join(broadcast_if_small(cut(ends)), "doc_id")
    contents = F.concat(
        F.when(F.col(PART) == F.col("_first"), m.TOC_OPEN).otherwise(""), F.col("_entries"),
        F.when(F.col(PART) == F.col("_last"), m.TOC_CLOSE).otherwise(""),
        F.when(F.col(PART) == F.col("_end"), "\n").otherwise(""),
    )
    # a part of blank lines alone has no body; the line end between bodies stands in front of all but the first
    empty = F.col("_body") == ""
    shown = rows.filter(~empty).groupBy("doc_id").agg(F.min(PART).alias("_shown"))
    joined = joined.join(broadcast_if_small(cut(shown)), "doc_id", "left")
    led = F.when(empty | (F.col(PART) == F.col("_shown")), F.col("_body")).otherwise(F.concat(F.lit("\n"), F.col("_body")))
    pieces = F.inline(
        F.array(
            F.struct((F.col(PART) - F.col("_end") - 1).cast("int").alias(PART), contents.alias("html")),
            F.struct(F.col(PART).cast("int").alias(PART), led.alias("html")),
        )
    )
    return joined.select("doc_id", pieces)


def to_latex(sources: DataFrame) -> DataFrame:
    """(doc_id, latex): body text with prose escaped and math kept. Sources in parts give parts, in order the whole."""
    parted = PART in sources.columns
    rows = sources.withColumn("_later", F.lit(False))
    if parted:
        # lines stand for themselves, so parts stay as they are
        several = several_parts(sources, ["doc_id"])
        rows = _own_lines(later_parts(_with_breaks(sources, several), ["doc_id"], several))
    body = F.col("_body")
    led = F.when(F.col("_later"), F.concat(F.lit("\n"), body)).otherwise(body)
    trimmed = rows.withColumn("_lines", F.transform(m.lines(F.col("markdown")), trim_blank))
    return trimmed.withColumn("_body", m.latex_body(F.col("_lines"))).select("doc_id", *([PART] if parted else []), led.alias("latex"))


def spans(sources: DataFrame) -> DataFrame:
    """Inline spans of every text block: (doc_id, position, span_index, span_kind, span)."""
    rows = block_table(sources).withColumn("_text", m.inline_source(F.col("kind"), F.col("source")))
    return rows.filter("_text IS NOT NULL").select(
        "doc_id", "position", F.posexplode(m.inline_spans(F.col("_text"))).alias("span_index", "span")
    ).withColumn("span_kind", m.span_kind(F.col("span")))


def math_inventory(sources: DataFrame) -> DataFrame:
    """Every math span: (doc_id, position, display, tex); one pass over the blocks."""

    def entry(display: bool, tex):
        return F.struct(F.lit(display).alias("display"), tex.alias("tex"))

    text = m.inline_source(F.col("kind"), F.col("source"))
    inline = F.transform(
        F.filter(m.inline_spans(text), lambda span: m.span_kind(span) == "math"),
        lambda span: entry(False, F.substring(span, F.lit(2), F.length(span) - 2)),
    )
    found = F.when(F.col("kind") == "math", F.array(entry(True, m.display_math(F.col("source"))))).otherwise(inline)
    return block_table(sources).select("doc_id", "position", F.inline(found))


def tex_commands(spark: SparkSession) -> DataFrame:
    """Known commands (constant size): command, class and displayed character."""
    rows = [(c, "structure", None) for c in TEX_STRUCTURES]
    rows += [(c, "symbol", s) for c, s in TEX_SYMBOLS.items()]
    rows += [(c, "greek", s) for c, s in TEX_GREEK.items()]
    structs = [
        F.struct(F.lit(c).alias("command"), F.lit(k).alias("class"), F.lit(s).cast("string").alias("shown"))
        for c, k, s in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def command_usage(math: DataFrame) -> DataFrame:
    """Use counts per TeX command, with its class; ``unsupported`` when unknown.

    Counts are combined before the join, whose other side is a constant table.
    """
    used = (
        math.select(F.explode(F.regexp_extract_all("tex", F.lit(r"\\(\p{L}+)"), F.lit(1))).alias("command"))
        .groupBy("command")
        .agg(F.count("*").alias("uses"))
    )
    known = tex_commands(math.sparkSession)
    return used.join(F.broadcast(known), "command", "left").withColumn(
        "class", F.coalesce("class", F.lit("unsupported"))
    )


def figure_report(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Figure links with their status (blocked, missing, ok), caption and media type.

    ``files`` lists (doc_id, path) of existing figures.
    """
    found = spans(sources).filter("span_kind = 'image'")
    path, alt = m.image_path(F.col("span")), m.image_alt(F.col("span"))
    links = found.select("doc_id", "position", "span_index", path.alias("path"), alt.alias("alt"))
    present = files.select("doc_id", "path").distinct().withColumn("_present", F.lit(True))
    return (
        links.join(present, ["doc_id", "path"], "left")
        .withColumn(
            "status",
            F.when(is_blocked_path(F.col("path")), "blocked").when(F.col("_present"), "ok").otherwise("missing"),
        )
        .withColumn("caption", figure_caption(F.col("alt"), F.col("path")))
        .withColumn("media_type", media_type(F.col("path")))
        .drop("_present")
    )


def uncertain_counts(sources: DataFrame) -> DataFrame:
    """(doc_id, uncertain_count); over the parts of a source where there are some, marks across a cut included."""
    text = F.col("markdown")
    if PART not in sources.columns:
        return sources.select("doc_id", m.uncertain_count(text).alias("uncertain_count"))
    narrow = sources.select("doc_id", F.struct(F.col(PART).alias("part"), m.uncertain_table(text).alias("table")).alias("_row"))

    def step(state: Column, row: Column) -> Column:
        here = F.get(row["table"], state["open"].cast("int"))
        return F.struct((state["marks"] + here["marks"]).alias("marks"), here["open"].alias("open"))

    start = F.struct(F.lit(0).cast("long").alias("marks"), F.lit(False).alias("open"))
    total = F.aggregate(F.array_sort(F.collect_list("_row")), start, step, lambda state: state["marks"].cast("int"))
    return narrow.groupBy("doc_id").agg(total.alias("uncertain_count"))


def matrices(math: DataFrame) -> DataFrame:
    """Matrix cells of math spans: one row per cell."""
    rows = math.withColumn("environment", m.matrix_environment(F.col("tex"))).withColumn(
        "_rows", m.matrix_cells(F.col("tex"))
    )
    return rows.select("doc_id", "environment", F.posexplode("_rows").alias("row", "_cells")).select(
        "doc_id", "environment", "row", F.posexplode("_cells").alias("column", "cell")
    )
