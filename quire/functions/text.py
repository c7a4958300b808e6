"""Text matching: folding, terms, occurrence counts, highlights, snippets."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace is the Unicode set, not Spark's ASCII default.
WHITESPACE = "\t" + "".join(chr(c) for c in range(0x20, 0x3001) if unicodedata.category(chr(c)) == "Zs")
NEWLINES = "\n\x0b\x0c\r\x85\u2028\u2029"
WHITESPACE_RUN = r"[\t-\r\x{85}\p{Z}]+"
BLANK_RUN = r"[\t\p{Zs}]+"

CONTEXT_RADIUS = 48
PREVIEW_LENGTH = 120
ELLIPSIS = "…"

#: A letter is followed by any number of these.
_MARKS_AFTER = r"\p{Mn}*+"


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, str]:
    """Letters and what they fold to, one code point each, and the marks that are dropped; by rule from Unicode.

    A letter that decomposes into one base letter and nonspacing marks folds to the base, in any script; a letter
    whose folded case is one other letter than its lower case (final sigma, long s) folds to that.
    """
    letters, plain, marks = [], [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        letter = chr(code)
        if unicodedata.category(letter) == "Mn":
            marks.append(letter)
            continue
        base = [c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn"]
        if len(base) != 1:
            continue
        folded = base[0].casefold()
        # lower() of a text writes the capital sigma by its place in the word
        if len(folded) == 1 and (folded != letter.lower() or letter == "\u03a3"):
            letters.append(letter)
            plain.append(folded)
    return "".join(letters), "".join(plain), "".join(marks)


def fold(text: Column) -> Column:
    """Case- and accent-insensitive form used for matching and counting.

    Translation runs before ``lower`` so letters whose lower case expands keep
    one code point, and nonspacing marks are dropped. Pure ASCII text skips it.
    """
    letters, plain, marks = fold_tables()
    return _fold(text, letters + marks, plain)


def fold_aligned(text: Column) -> Column:
    """Like :func:`fold`, but keeps every code point, marks too, so offsets stay valid."""
    letters, plain, _ = fold_tables()
    return _fold(text, letters, plain)


def _fold(text: Column, source: str, target: str) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.lower(F.translate(text, source, target)))


def fold_literal(text: str) -> str:
    """Driver-side counterpart of :func:`fold` for query literals."""
    letters, plain, marks = fold_tables()
    table = {ord(a): p for a, p in zip(letters, plain, strict=True)}
    table.update({ord(m): None for m in marks})
    return text.translate(table).lower()


def parse_terms(query: str) -> list[str]:
    """Lower-cased search terms of a query literal; duplicates are kept."""
    for mark in WHITESPACE + NEWLINES:
        query = query.replace(mark, " ")
    return [term.lower() for term in query.split(" ") if term]


def query_terms(query: Column) -> Column:
    """Lower-cased search terms of a query column; duplicates are kept."""
    return F.filter(F.split(F.lower(query), WHITESPACE_RUN), lambda term: term != "")


def trim_all(text: Column) -> Column:
    """Strip Unicode whitespace and newlines from both ends."""
    return F.btrim(text, F.lit(WHITESPACE + NEWLINES))


def trim_blank(text: Column) -> Column:
    """Strip Unicode spaces and tabs, but not newlines, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def flatten_whitespace(text: Column) -> Column:
    return trim_all(F.regexp_replace(text, WHITESPACE_RUN, " "))


def contains_term(folded: Column, term: Column) -> Column:
    return (F.length(term) > 0) & F.contains(folded, term)


def contains_all(folded: Column, terms: list[str]) -> Column:
    """AND over literal folded terms, most selective (longest) first."""
    if not terms:
        return F.lit(False)
    ordered = sorted(set(terms), key=len, reverse=True)
    test = F.contains(folded, F.lit(ordered[0]))
    for term in ordered[1:]:
        test = test & F.contains(folded, F.lit(term))
    return test


def page_matches(text: Column, terms: list[str]) -> Column:
    """True for text holding every literal folded term; the text is folded once.

    A filter does not share sub-expressions, so the fold is bound in a lambda.
    """
    return F.exists(F.array(fold(text)), lambda folded: contains_all(folded, terms))


def occurrences(folded: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a folded term in folded text."""
    removed = F.length(folded) - F.length(F.replace(folded, term, F.lit("")))
    return F.when(F.length(term) > 0, (removed / F.length(term)).cast("int")).otherwise(F.lit(0))


def _quoted(term: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _with_marks(term: Column) -> Column:
    """Pattern of a folded term, each letter of which may carry marks."""
    return F.regexp_replace(term, "(?s)(.)", r"\\Q$1\\E" + _MARKS_AFTER.replace("\\", "\\\\"))


def _starts(pieces: Column, widths: Column) -> Column:
    """Start offsets of the separators between split pieces, of the given widths.

    The running offset is folded in runs of 256 pieces, so appending stays
    close to linear even for a text with very many matches.
    """
    run = 256
    gaps = F.size(pieces) - 1
    empty = F.array().cast("array<int>")

    def inner(begin: Column, base: Column) -> Column:
        length = F.least(F.lit(run), gaps - begin)
        steps = F.zip_with(
            F.slice(pieces, begin + 1, length), F.slice(widths, begin + 1, length),
            lambda piece, width: F.struct(F.length(piece).alias("before"), width.alias("width")),
        )
        return F.aggregate(
            steps,
            F.struct(base.alias("at"), empty.alias("starts")),
            lambda acc, step: F.struct(
                (acc["at"] + step["before"] + step["width"]).alias("at"),
                F.array_append(acc["starts"], acc["at"] + step["before"]).alias("starts"),
            ),
        )

    def outer(acc: Column, begin: Column) -> Column:
        return F.transform(
            F.array(inner(begin, acc["at"])),
            lambda done: F.struct(
                done["at"].alias("at"),
                F.array_append(acc["runs"], done["starts"]).alias("runs"),
            ),
        )[0]

    folded = F.aggregate(
        F.sequence(F.lit(0), gaps - 1, F.lit(run)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("runs")),
        outer,
        lambda acc: F.flatten(acc["runs"]),
    )
    return F.when(gaps > 0, folded).otherwise(empty)


def _bound(values: list[Column], use) -> Column:
    """Evaluate values once per row and hand them to ``use``."""
    names = [f"v{i}" for i in range(len(values))]
    row = F.struct(*[value.alias(name) for value, name in zip(values, names, strict=True)])
    return F.transform(F.array(row), lambda r: use(*[r[name] for name in names]))[0]


def highlight_ranges(text: Column, terms: Column) -> Column:
    """Sorted ``array<struct<start,end>>`` of every match of every term.

    ``terms`` is an array column. A match covers the marks its letters carry. Ranges
    of different terms may overlap; they are sorted by start (query order on ties)
    and not merged.
    """
    folded = fold_aligned(text)

    def of_term(whole: Column, marked: Column, key: Column, position: Column) -> Column:
        pattern = F.when(marked, _with_marks(key)).otherwise(_quoted(key))

        def ranges(pieces: Column, widths: Column) -> Column:
            return F.zip_with(
                _starts(pieces, widths), widths,
                lambda start, width: F.struct(start.alias("start"), position.alias("ord"), (start + width).alias("end")),
            )

        def measured(pieces: Column) -> Column:
            found = F.transform(F.regexp_extract_all(whole, pattern, F.lit(0)), lambda match: F.length(match))
            same = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda _: F.length(key))
            return _bound([pieces, F.when(marked, found).otherwise(same)], ranges)

        return _bound([F.split(whole, pattern, -1)], measured)

    def of_terms(whole: Column, keys: Column) -> Column:
        marked = whole.rlike(r"\p{Mn}")
        return F.flatten(F.transform(keys, lambda key, position: F.when(key != "", of_term(whole, marked, key, position)).otherwise(
            F.array().cast("array<struct<start:int,ord:int,end:int>>"))))

    kept = F.filter(terms, lambda term: term != "")
    hits = _bound([folded, F.transform(kept, fold)], of_terms)
    return F.transform(
        F.array_sort(hits),
        lambda hit: F.struct(hit["start"].alias("start"), hit["end"].alias("end")),
    )


def first_match(folded: Column, terms: Column) -> Column:
    """``struct<pos,ord,len>`` of the earliest match (1-based), null without one.

    ``folded`` is the length-preserving fold of the flattened text; a match covers
    the marks its letters carry.
    """

    def of_terms(whole: Column, keys: Column) -> Column:
        marked = whole.rlike(r"\p{Mn}")

        def hit(key: Column, position: Column) -> Column:
            pattern = _with_marks(key)
            before = F.length(F.get(F.split(whole, pattern, 2), F.lit(0)))
            with_marks = F.when(F.rlike(whole, pattern), before + 1).otherwise(0)
            return F.struct(
                F.when(marked, with_marks).otherwise(F.position(key, whole)).alias("pos"),
                position.alias("ord"),
                F.when(marked, F.length(F.regexp_substr(whole, pattern))).otherwise(F.length(key)).alias("len"),
            )

        hits = F.transform(F.filter(keys, lambda key: key != ""), hit)
        return F.array_min(F.filter(hits, lambda found: found["pos"] > 0))

    return _bound([folded, F.transform(terms, fold)], of_terms)


def _lead(flat: Column, length: int) -> Column:
    return F.when(
        F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit(ELLIPSIS))
    ).otherwise(flat)


def preview(text: Column, length: int = PREVIEW_LENGTH) -> Column:
    """Leading text of a page as one line, cut with an ellipsis."""
    return _lead(flatten_whitespace(text), length)


def with_snippet(df: DataFrame, text: str, terms: Column, radius: int = CONTEXT_RADIUS) -> DataFrame:
    """Add ``snippet``: context around the earliest match, else the preview.

    The flattened and folded texts are columns of their own, so each is
    computed once per row rather than once per use.
    """
    flat, hit = F.col("_flat"), F.col("_hit")
    low = F.greatest(hit["pos"] - 1 - radius, F.lit(0))
    high = F.least(hit["pos"] - 1 + hit["len"] + radius, F.length(flat))
    around = F.concat(
        F.when(low > 0, F.lit(ELLIPSIS)).otherwise(F.lit("")),
        F.substring(flat, low + 1, high - low),
        F.when(high < F.length(flat), F.lit(ELLIPSIS)).otherwise(F.lit("")),
    )
    return (
        df.withColumn("_flat", flatten_whitespace(F.col(text)))
        .withColumn("_folded", fold_aligned(flat))
        .withColumn("_hit", first_match(F.col("_folded"), terms))
        .withColumn("snippet", F.when(hit.isNotNull(), around).otherwise(_lead(flat, PREVIEW_LENGTH)))
        .drop("_flat", "_folded", "_hit")
    )


def title_rank(title: Column, query: str) -> Column:
    """0 = whole title equals the query, 1 = title holds every term, 2 = neither."""
    folded = fold(trim_all(title))
    terms = [fold_literal(term) for term in parse_terms(query)]
    whole = fold_literal(query.strip(WHITESPACE + NEWLINES))
    return F.when(folded == whole, 0).when(contains_all(folded, terms), 1).otherwise(2)


def match_kind(has_body: Column, rank: Column) -> Column:
    return F.when(has_body, "body").when(rank == 0, "title_exact").otherwise("title_partial")


def result_id(document_id: Column, page_id: Column, has_body: Column) -> Column:
    tail = F.when(has_body, page_id.cast("string")).otherwise(F.lit("title"))
    return F.concat(document_id.cast("string"), F.lit("#"), tail)
