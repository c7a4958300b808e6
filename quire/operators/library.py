"""Library relations: documents, pages, blocks, their listing and their upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import image_directory
from ..functions.names import sanitize_title
from ..functions.text import ELLIPSIS, NEWLINES, PREVIEW_LENGTH, WHITESPACE, trim_all
from ..runtime import broadcast_if_small
from .ordered import with_global_index, with_group_index

# Listing texts.
NO_TEXT = "No text recognized."
WAITING = "Waiting for text recognition…"
ONE_PAGE, MANY_PAGES = "1 page", " pages"

#: Pages per part wherever the pages of one document are gathered into one value.
PART_PAGES = 4096


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.col("created_at").desc(), F.col("document_id"))


def find_document(documents: DataFrame, document_id) -> DataFrame:
    """Point lookup: the equality reaches the scan as a pushed filter."""
    return documents.filter(F.col("document_id") == F.lit(document_id)).limit(1)


def flatten_library(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Search relation: one row per document and page, documents without pages kept."""
    side = pages.select("document_id", "page_id", "page_number", "text")
    return documents.select("document_id", "title", "document_type", "updated_at").join(
        side, "document_id", "left"
    )


def nest_pages(flat: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """Nested export: pages of a document as an ordered array.

    A document is emitted in parts of ``part_pages`` page numbers, so no array
    outgrows a task; ordinary documents are a single part 0.
    """
    page = F.struct("page_number", "page_id", "text")
    part = F.floor((F.col("page_number") - 1) / part_pages).cast("int")
    kept = F.filter(F.array_sort(F.collect_list(page)), lambda p: p["page_id"].isNotNull())
    return (
        flat.withColumn("part", F.coalesce(part, F.lit(0)))
        .groupBy("document_id", "title", "document_type", "updated_at", "part")
        .agg(kept.alias("pages"))
    )


def is_empty(documents: DataFrame) -> DataFrame:
    return documents.agg((F.count("*") == 0).alias("library_is_empty"))


def first_pages(pages: DataFrame) -> DataFrame:
    """Lowest-numbered page per document; only that one row per group is shuffled."""
    window = Window.partitionBy("document_id").orderBy("page_number", "page_id")
    return pages.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def document_previews(pages: DataFrame, length: int = PREVIEW_LENGTH) -> DataFrame:
    """(document_id, preview): leading text of all pages of a document.

    Every page between the first and the last non-blank one adds at least one
    character (its separator), so ``length + 2`` pages settle the result. The
    ranked filter keeps that many per task before the exchange, which bounds
    each group however many pages a document has.
    """
    need = length + 2
    edge = F.lit(WHITESPACE + NEWLINES)
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    # Longer texts cannot show more than the cut. What an edge page shows is trimmed, so both forms
    # of its beginning are kept; the whole text goes no further than its scan.
    slim = pages.select(
        "document_id", "page_number", (trim_all(F.col("text")) == "").alias("_blank"),
        F.substring(text, 1, length + 1).alias("_text"),
        F.substring(F.ltrim(text, edge), 1, length + 1).alias("_opened"),
        F.substring(F.rtrim(text, edge), 1, length + 1).alias("_closed"),
        F.substring(F.btrim(text, edge), 1, length + 1).alias("_only"),
    )
    spans = slim.filter("not _blank").groupBy("document_id").agg(
        F.min("page_number").alias("_from"), F.max("page_number").alias("_to")
    )
    window = Window.partitionBy("document_id").orderBy("page_number")
    first, last = F.col("page_number") == F.col("_from"), F.col("page_number") == F.col("_to")
    shown = F.when(first & last, F.col("_only")).when(first, F.col("_opened")).when(last, F.col("_closed")).otherwise(F.col("_text"))
    lead = (
        slim.join(spans, "document_id")
        .filter(F.col("page_number").between(F.col("_from"), F.col("_to")))
        .select("document_id", "page_number", shown.alias("_lead"))
        .withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") <= need)
        .groupBy("document_id")
        .agg(F.expr("listagg(_lead, ' ') within group (order by page_number)").alias("_joined"))
    )
    cut = F.when(
        F.length("_joined") > length, F.concat(F.substring("_joined", 1, length), F.lit(ELLIPSIS))
    ).otherwise(F.col("_joined"))
    return lead.select("document_id", cut.alias("preview"))


def listing_rows(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Listing: page label and one line of status, error or preview text."""
    counts = pages.groupBy("document_id").agg(F.count("*").alias("page_count"))
    count = F.coalesce(F.col("page_count"), F.lit(0).cast("long"))
    waiting = F.when(
        F.col("processing_status") == "completed", NO_TEXT
    ).otherwise(WAITING)
    line = (
        F.when(
            (F.col("processing_status") == "failed") & F.col("processing_error").isNotNull(),
            F.col("processing_error"),
        )
        .when(F.coalesce(F.col("preview"), F.lit("")) == "", waiting)
        .otherwise(F.col("preview"))
    )
    return (
        documents.join(counts, "document_id", "left")
        .join(document_previews(pages), "document_id", "left")
        .select(
            "document_id",
            "title",
            F.when(count == 1, ONE_PAGE).otherwise(F.concat(count.cast("string"), F.lit(MANY_PAGES))).alias(
                "page_label"
            ),
            line.alias("detail_line"),
        )
    )


def traverse(documents: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents with their pages and blocks, along the foreign keys."""
    return documents.join(pages, "document_id").join(blocks, "page_id")


def cascade_delete(
    documents: DataFrame, pages: DataFrame, blocks: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining documents, pages and blocks after deleting ``doomed`` document ids."""
    keys = broadcast_if_small(doomed.select("document_id"))
    gone_pages = pages.join(keys, "document_id", "left_semi").select("page_id")
    return (
        documents.join(keys, "document_id", "left_anti"),
        pages.join(keys, "document_id", "left_anti"),
        blocks.join(gone_pages, "page_id", "left_anti"),
    )


def files_to_remove(documents: DataFrame, pages: DataFrame, doomed: DataFrame, existing: DataFrame) -> DataFrame:
    """(directory, file_name) of deleted documents that are still on disk.

    ``existing`` lists (directory, file_name). Names already gone are skipped.
    """
    dead = documents.join(broadcast_if_small(doomed.select("document_id")), "document_id", "left_semi")
    sources = dead.select(F.lit("Sources").alias("directory"), F.col("local_file_name").alias("file_name"))
    images = pages.join(dead.select("document_id", "document_type"), "document_id").select(
        image_directory(F.col("document_type")).alias("directory"),
        F.col("image_file_name").alias("file_name"),
    )
    names = sources.unionByName(images).filter("file_name IS NOT NULL").distinct()
    return names.join(existing.select("directory", "file_name"), ["directory", "file_name"], "left_semi")


def delete_positions(documents: DataFrame, positions: DataFrame) -> DataFrame:
    """Remaining documents after deleting 0-based ``position`` values of the listing.

    Positions outside the listing are ignored.
    """
    order = [F.col("created_at").desc(), F.col("document_id")]
    placed = with_global_index(documents, order, "position")
    return placed.join(broadcast_if_small(positions.select("position")), "position", "left_anti").drop("position")


def replace_children(current: DataFrame, fresh: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """Replace the child rows of ``touched`` keys by ``fresh`` ones; others stay."""
    keys = broadcast_if_small(touched.select(key).distinct())
    return current.join(keys, key, "left_anti").unionByName(fresh)


def replace_document_pages(
    pages: DataFrame, blocks: DataFrame, new_pages: DataFrame, new_blocks: DataFrame, touched: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Replace all pages, and the blocks under them, of re-recognised documents."""
    keys = broadcast_if_small(touched.select("document_id").distinct())
    old = pages.join(keys, "document_id", "left_semi").select("page_id")
    return (
        pages.join(keys, "document_id", "left_anti").unionByName(new_pages),
        blocks.join(old, "page_id", "left_anti").unionByName(new_blocks),
    )


def rename(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (document_id, new_title, changed_at); a title empty after cleaning is a no-op.

    The latest change of a document wins; of several at one time, the first title in order.
    """
    window = Window.partitionBy("document_id").orderBy(F.col("changed_at").desc(), F.col("_title"))
    clean = (
        changes.select("document_id", sanitize_title(F.col("new_title")).alias("_title"), "changed_at")
        .filter("_title <> ''")
        .withColumn("_n", F.row_number().over(window))
        .filter("_n = 1")
        .drop("_n")
    )
    return (
        documents.join(clean, "document_id", "left")
        .withColumn("title", F.coalesce("_title", "title"))
        .withColumn("updated_at", F.coalesce("changed_at", "updated_at"))
        .drop("_title", "changed_at")
    )


def edit_text(documents: DataFrame, pages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply (page_id, new_text, changed_at) to pages; their documents become newer.

    The latest edit of a page wins. Returns (documents, pages).
    """
    window = Window.partitionBy("page_id").orderBy(F.col("changed_at").desc(), F.col("new_text"))
    last = edits.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
    edited = (
        pages.join(last.select("page_id", "new_text"), "page_id", "left")
        .withColumn("text", F.coalesce("new_text", "text"))
        .drop("new_text")
    )
    times = (
        pages.select("page_id", "document_id")
        .join(last.select("page_id", "changed_at"), "page_id")
        .groupBy("document_id")
        .agg(F.max("changed_at").alias("_changed"))
    )
    touched = (
        documents.join(times, "document_id", "left")
        .withColumn("updated_at", F.greatest("_changed", "updated_at"))
        .drop("_changed")
    )
    return touched, edited


def finish_processing(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Lifecycle after a run: (document_id, outcome, error_text).

    ``completed`` rows get full progress and no error, ``failed`` rows the error
    text and no progress, ``cancelled`` rows leave; others are unchanged. Of several
    outcomes of a document, cancelled comes before failed and failed before completed.
    """
    place = F.array_position(F.array(*map(F.lit, ("cancelled", "failed", "completed"))), F.col("outcome"))
    first = Window.partitionBy("document_id").orderBy(F.when(place > 0, place).otherwise(9), "error_text")
    outcomes = outcomes.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    outcome = F.coalesce(F.col("outcome"), F.lit(""))
    return (
        documents.join(outcomes, "document_id", "left")
        .filter(outcome != "cancelled")
        .withColumn(
            "processing_progress",
            F.when(outcome == "completed", 1.0).when(outcome == "failed", 0.0).otherwise(F.col("processing_progress")),
        )
        .withColumn(
            "processing_error",
            F.when(outcome == "completed", F.lit(None))
            .when(outcome == "failed", F.col("error_text"))
            .otherwise(F.col("processing_error")),
        )
        .withColumn(
            "processing_status",
            F.when(outcome.isin("completed", "failed"), outcome).otherwise(F.col("processing_status")),
        )
        .drop("outcome", "error_text")
    )


def renumber(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Dense 0-based position per group; hot groups are spread over range slices."""
    return with_group_index(rows, keys, [F.col(o) for o in order], out)
