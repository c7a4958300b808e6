"""Ranked keyword search over documents and their pages.

``documents``: document_id, title, document_type, updated_at.
``pages``: document_id, page_id, page_number, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.paging import clamp_page
from ..runtime import cut, is_small
from .ordered import with_global_index

RESULT_COLUMNS = [
    "result_id",
    "document_id",
    "title",
    "document_type",
    "page_id",
    "page_number",
    "snippet",
    "highlights",
    "match_kind",
    "title_rank",
    "body_match_count",
    "updated_at",
]


def _count_all(folded: Column, terms: list[str]) -> Column:
    """Sum of occurrences over the terms; a repeated term counts each time."""
    total = F.lit(0)
    for term in terms:
        total = total + t.occurrences(folded, F.lit(term))
    return total


def page_statistics(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Per document: body matches over all pages, any full hit, first page number.

    Only integers are aggregated, so the hash aggregate combines map-side and
    shuffles one short row per document and task, whatever a document's size.
    """
    scanned = pages.select("document_id", "page_number", t.fold(F.col("text")).alias("_f"))
    return scanned.groupBy("document_id").agg(
        F.sum(_count_all(F.col("_f"), terms)).cast("long").alias("body_match_count"),
        F.max(F.when(t.contains_all(F.col("_f"), terms), 1).otherwise(0)).alias("_any_hit"),
        F.min("page_number").alias("_first_page"),
    )


def _shape(rows: DataFrame, terms: list[str], radius: int) -> DataFrame:
    """Result columns; ``_body`` rows get a marked snippet, others a plain preview."""
    nothing = F.array().cast("array<string>")
    every = F.array(*[F.lit(term) for term in terms]) if terms else nothing
    active = F.when(F.col("_body"), every).otherwise(nothing)
    shown = t.with_snippet(rows, "text", active, radius)
    return (
        shown.withColumn("highlights", t.highlight_ranges(F.col("snippet"), active))
        .withColumn("match_kind", t.match_kind(F.col("_body"), F.col("title_rank")))
        .withColumn("result_id", t.result_id(F.col("document_id"), F.col("page_id"), F.col("_body")))
        .select(*RESULT_COLUMNS)
    )


def rank_order() -> list[Column]:
    """Result order: title rank, body matches, recency, document, page."""
    return [
        F.col("title_rank"),
        F.col("body_match_count").desc(),
        F.col("updated_at").desc(),
        F.col("document_id").cast("string"),
        F.col("page_number"),
    ]


def search(
    documents: DataFrame,
    pages: DataFrame,
    query: str,
    limit: int | None = None,
    radius: int = t.CONTEXT_RADIUS,
    ranked: bool = False,
) -> DataFrame:
    """Pages holding every term, and documents matched by title alone.

    A page matches when it holds all terms itself. Documents rank by title
    match, then by matches summed over all their pages, then by recency. With
    ``limit`` the order is a top-k (no global sort). ``ranked`` adds the 0-based
    ``position`` of each result; without a limit it comes from a range partitioning
    of the results by :func:`rank_order`, never from one task.
    """
    literal = t.parse_terms(query)
    terms = [t.fold_literal(term) for term in literal]
    docs = documents.select("document_id", "title", "document_type", "updated_at").withColumn(
        "title_rank", t.title_rank(F.col("title"), query)
    )
    slim = pages.select("document_id", "page_id", "page_number", "text")
    no_page = {
        "page_id": F.lit(None).cast(pages.schema["page_id"].dataType),
        "page_number": F.lit(None).cast(pages.schema["page_number"].dataType),
        "text": F.lit(""),
        "_body": F.lit(False),
    }
    if not terms:
        nothing = _shape(docs.filter(F.lit(False)).withColumns({"body_match_count": F.lit(0), **no_page}), terms, radius)
        return nothing.withColumn("position", F.lit(None).cast("long")) if ranked else nothing

    # One row per matching document. It is written to the checkpoint folder, so the
    # full text scan behind it runs once although three branches read the result.
    kept = cut(
        docs.join(page_statistics(slim, terms), "document_id", "left")
        .withColumn("body_match_count", F.coalesce(F.col("body_match_count"), F.lit(0).cast("long")))
        .withColumn("_any_hit", F.coalesce(F.col("_any_hit"), F.lit(0)))
        .filter("_any_hit = 1 OR title_rank < 2")
    )
    small = is_small(kept)
    side = F.broadcast(kept) if small else kept
    full = t.page_matches(F.col("text"), terms)
    if small:
        # Pages of documents without a full hit are dropped by the join before their text
        # is folded; naming a column of each side keeps the test above the join.
        body = slim.join(side, "document_id").filter(F.when(F.col("_any_hit") == 1, full))
    else:
        # The selective literal filter runs in the scan stage, before any exchange.
        body = slim.filter(full).join(side.filter("_any_hit = 1"), "document_id")
    body = body.withColumn("_body", F.lit(True))
    # Documents matched by title alone show their first page, if they have one.
    lone = kept.filter("_any_hit = 0")
    lone = F.broadcast(lone) if small or is_small(lone) else lone
    first = slim.withColumn("_body", F.lit(False)).join(
        lone.withColumnRenamed("_first_page", "page_number"),
        ["document_id", "page_number"],
    )
    bare = kept.filter("_any_hit = 0 AND _first_page IS NULL").withColumns(no_page)
    carried = [
        "document_id", "title", "document_type", "updated_at", "title_rank", "body_match_count",
        "page_id", "page_number", "text", "_body",
    ]
    rows = body.select(*carried).unionByName(first.select(*carried)).unionByName(bare.select(*carried))
    if limit is None:
        shaped = _shape(rows, terms, radius)
        return with_global_index(cut(shaped), rank_order(), "position") if ranked else shaped
    # The top k is written first (k rows); otherwise the optimiser moves the snippet
    # expressions below the limit, which costs the top-k operator and builds them for all.
    best = cut(rows.orderBy(*rank_order()).limit(limit))
    shaped = _shape(best, terms, radius)
    if ranked:  # k rows, which the top-k had in one task already
        shaped = shaped.withColumn("position", F.row_number().over(Window.orderBy(*rank_order())).cast("long") - 1)
    return shaped.orderBy(*rank_order())


def open_result_pages(results: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Page each result opens on: its number clamped into the document."""
    counted = documents.select("document_id", "page_count")
    wanted = results.join(counted, "document_id").withColumn(
        "page_number", clamp_page(F.coalesce(F.col("page_number"), F.lit(1)), F.col("page_count"))
    )
    return wanted.join(
        pages.select("document_id", "page_number", F.col("page_id").alias("open_page_id")),
        ["document_id", "page_number"],
    )


def attach_documents(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Join results to current documents; a missing document stays, flagged."""
    side = documents.withColumn("_present", F.lit(True))
    return (
        results.join(side, "document_id", "left")
        .withColumn("available", F.coalesce(F.col("_present"), F.lit(False)))
        .drop("_present")
    )
