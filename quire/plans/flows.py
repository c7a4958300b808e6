"""End-to-end flows: search over edited pages, responses to sources, pages to text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import hooks, ingest, jobs, library, markdown, parts, search
from ..runtime import cut, written


def search_library(
    documents: DataFrame, pages: DataFrame, edits: DataFrame, query: str, limit: int | None = None
) -> DataFrame:
    """Search what the user sees now: pages with their newest edits laid over."""
    current, text = library.edit_text(documents, pages, edits)
    return search.search(current, text, query, limit)


def recognize_library(
    images: DataFrame, recognizer: Callable[[bytes], list[dict]], key: str = "page_id"
) -> DataFrame:
    """Image bytes to page text: recognise, clean, order, compose."""
    return hooks.recognize_pages(images, recognizer, key)


def responses_to_sources(responses: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """OCR responses to one Markdown source per job.

    Returns (sources, page mismatches, quarantined responses). Jobs whose page
    count differs from their manifest (job_id, page_count) are reported and left
    out of the sources. Parsed responses are written once and read three times.
    """
    parsed, quarantine = ingest.parse_responses(responses, "job_id")
    pages = cut(ingest.ocr_pages(parsed, "job_id"))
    # of the responses, not of their pages: a response without pages is a mismatch too
    known = manifests.join(parsed.select("job_id").distinct(), "job_id", "left_semi")
    wrong = jobs.page_mismatches(known, pages.join(known, "job_id", "left_semi"))
    complete = pages.join(known, "job_id", "left_semi").join(wrong.select("job_id"), "job_id", "left_anti")
    sources = jobs.assemble_markdown(complete.withColumnRenamed("markdown", "final_markdown"))
    return sources, wrong, quarantine


def publish_sources(sources: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """HTML text, LaTeX text and uncertain-mark count, one row per source (doc_id[, part], markdown).

    ``files`` lists (doc_id, path) of existing figures. Sources in parts are written once for the renderings that read
    them, and put together again afterwards.
    """
    if parts.PART in sources.columns:
        sources = written(sources)
    html, latex = markdown.to_html(sources, files), markdown.to_latex(sources)
    if parts.PART in sources.columns:
        html, latex = parts.whole(html, ["doc_id"], "html"), parts.whole(latex, ["doc_id"], "latex")
    return (
        html.join(latex, "doc_id")
        .join(markdown.uncertain_counts(sources), "doc_id")
        .select("doc_id", "html", "latex", "uncertain_count")
    )
