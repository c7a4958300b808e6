"""Titles, file names and path keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import document_type_name, file_extension
from .text import BLANK_RUN, trim_all, trim_blank

# Title length and characters, file-name and path formats, stamps.
TITLE_LENGTH = 80
_TITLE_ILLEGAL = r'[/\\:*?"<>|\n\t\r]'
SOURCE_PREFIX = "doc_"
PAGE_IMAGE = "page_%s_%04d.jpg"
PAGE_SOURCE = "pages/page-%03d.jpg"
REFINEMENT_CACHE = "refinement-page-%03d.json"
OVERVIEW_CACHE = "vision-page-%03d-overview.json"
CROP_CACHE = "vision-page-%03d-crop-%03d.json"
HISTORY_STAMP = "yyyyMMdd-HHmmss-SSS"
DATED_TITLE = "yyyy-MM-dd HH:mm"


def sanitize_title(raw: Column, length: int = TITLE_LENGTH) -> Column:
    """Illegal characters to spaces, runs collapsed, cut and trimmed."""
    flat = trim_blank(F.regexp_replace(F.regexp_replace(raw, _TITLE_ILLEGAL, " "), BLANK_RUN, " "))
    return trim_blank(F.substring(flat, 1, length))


def title_from_file_name(file_name: Column, document_type: Column, created_at: Column) -> Column:
    """Title of an imported file, or a dated fallback when nothing is left."""
    base = F.regexp_replace(file_name, r"(?<=[^/])\.[^./\s]+$", "")
    clean = F.nullif(sanitize_title(base), F.lit(""))
    dated = F.concat(
        document_type_name(document_type), F.lit(" "), F.date_format(created_at, DATED_TITLE)
    )
    return F.coalesce(clean, dated)


def source_file_name(document_id: Column, document_type: Column) -> Column:
    return F.concat(
        F.lit(SOURCE_PREFIX), F.lower(document_id.cast("string")), F.lit("."), file_extension(document_type)
    )


def page_image_name(document_id: Column, page_number: Column) -> Column:
    number = F.greatest(page_number, F.lit(0)).cast("int")
    return F.format_string(PAGE_IMAGE, F.lower(document_id.cast("string")), number)


def page_source_path(page_index: Column) -> Column:
    return F.format_string(PAGE_SOURCE, (page_index + 1).cast("int"))


def refinement_cache_path(page_index: Column) -> Column:
    return F.format_string(REFINEMENT_CACHE, (page_index + 1).cast("int"))


def vision_cache_path(page_index: Column, kind: Column, crop_index: Column) -> Column:
    """Cache file of one request; the crop index matters for crops only."""
    page = (page_index + 1).cast("int")
    return F.when(
        kind == "overview", F.format_string(OVERVIEW_CACHE, page)
    ).otherwise(
        F.format_string(CROP_CACHE, page, (crop_index + 1).cast("int"))
    )


def history_stamp(at: Column) -> Column:
    """UTC stamp with milliseconds; the session time zone must be UTC."""
    return F.date_format(at, HISTORY_STAMP)


def default_job_title(title: Column, created_at: Column, prefix: str = "Notes") -> Column:
    dated = F.concat(F.lit(prefix + " "), F.date_format(created_at, "d MMM yyyy 'at' HH:mm"))
    return F.coalesce(F.nullif(trim_all(title), F.lit("")), dated)


def archive_path(path: Column) -> Column:
    """Forward slashes only, without empty, current or parent components."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def natural_key(path: Column) -> Column:
    """Sort key in which digit runs of any length compare by value and case is ignored.

    A run becomes the number of its digits without leading zeros, ten places wide, and those digits.
    """
    pieces = F.regexp_extract_all(F.lower(path), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def keyed(piece: Column) -> Column:
        digits = F.ltrim(piece, F.lit("0"))
        return F.when(piece.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(piece)

    return F.array_join(F.transform(pieces, keyed), "")


def is_safe_path(path: Column) -> Column:
    return ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit(".."))


def is_exportable(path: Column, excluded_names: list[str]) -> Column:
    """Artifact filter: visible, not excluded, never a key file, never a parent path."""
    name = F.element_at(F.split(path, "/"), -1)
    hidden = path.rlike(r"(^|/)\.[^./]")
    keep = ~hidden & ~F.contains(F.lower(path), F.lit("providerkeys")) & ~F.contains(path, F.lit(".."))
    return keep & ~name.isin(excluded_names) if excluded_names else keep
