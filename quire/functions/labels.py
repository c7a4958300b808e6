"""Enumerations stored as strings, their labels, and the error taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stored enumeration strings, labels, progress points and messages.
DOCUMENT_TYPES = {"camera": "Camera", "photo": "Photo", "pdf": "PDF"}
FILE_EXTENSIONS = {"camera": "jpg", "photo": "jpg", "pdf": "pdf"}
PROCESSING_STATUSES = {
    "pending": "Pending",
    "processing": "Processing",
    "completed": "Completed",
    "failed": "Failed",
}
IMPORT_STAGES = {
    "preparingFile": "Preparing file",
    "renderingPages": "Rendering pages",
    "recognizingText": "Recognizing text",
    "savingResults": "Saving results",
    "complete": "Complete",
}
JOB_STAGES = {
    "draft": "Draft",
    "preparing": "Preparing pages",
    "baseOCR": "Base OCR",
    "refining": "Vision correction",
    "rendering": "Building documents",
    "complete": "Complete",
    "failed": "Needs attention",
    "cancelled": "Paused",
}
STAGE_PROGRESS = {
    "draft": 0.0,
    "preparing": 0.12,
    "baseOCR": 0.32,
    "refining": 0.62,
    "rendering": 0.86,
    "complete": 1.0,
    "failed": 0.0,
    "cancelled": 0.0,
}
#: kind -> (message, recovery); %s takes the detail, {app} the application name.
ERRORS = {
    "cameraUnavailable": (
        "The camera is not available on this device.",
        "Use Import Photo or Import PDF instead. The Simulator has no camera.",
    ),
    "cameraPermissionDenied": (
        "{app} does not have permission to use the camera.",
        "Enable camera access in Settings, then try again.",
    ),
    "photoLoadFailed": (
        "That photo could not be loaded.",
        "Pick a JPEG, PNG, or HEIC image and try again.",
    ),
    "unsupportedImageFormat": (
        "That image format is not supported.",
        "Pick a JPEG, PNG, or HEIC image and try again.",
    ),
    "pdfOpenFailed": (
        "“%s” could not be opened as a PDF.",
        "Try a different PDF, or re-export this one.",
    ),
    "pdfDamaged": (
        "“%s” looks damaged or has no readable pages.",
        "Try a different PDF, or re-export this one.",
    ),
    "pdfPageRenderFailed": (
        "Page %s could not be rendered.",
        "Run OCR again from the library, or re-import the document.",
    ),
    "fileCopyFailed": (
        "The file could not be copied into {app}.",
        "Free up some storage space and try again.",
    ),
    "fileWriteFailed": (
        "The file could not be saved.",
        "Free up some storage space and try again.",
    ),
    "fileMissing": (
        "“%s” is missing from local storage.",
        "Delete this document and import it again.",
    ),
    "fileDeleteFailed": (
        "Some local files could not be deleted.",
        "The entry was removed from your library. Some files may remain on disk.",
    ),
    "ocrRequestFailed": ("Text recognition failed.", "Run OCR again from the library."),
    "noTextRecognized": (
        "No text was recognized on this page.",
        "Try a sharper image, or type the text in manually.",
    ),
    "persistenceSaveFailed": (
        "Your changes could not be saved.",
        "Try again. If it keeps happening, restart the app.",
    ),
    "processingCancelled": ("Processing was cancelled.", None),
}


def _lookup(table: dict, key: Column, default=None) -> Column:
    mapping = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    found = F.try_element_at(mapping, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def decode_type(raw: Column) -> Column:
    return F.when(raw.isin(list(DOCUMENT_TYPES)), raw).otherwise("photo")


def decode_status(raw: Column) -> Column:
    return F.when(raw.isin(list(PROCESSING_STATUSES)), raw).otherwise("pending")


def document_type_name(document_type: Column) -> Column:
    return _lookup(DOCUMENT_TYPES, document_type)


def status_name(status: Column) -> Column:
    return _lookup(PROCESSING_STATUSES, status)


def import_stage_name(stage: Column) -> Column:
    return _lookup(IMPORT_STAGES, stage)


def job_stage_name(stage: Column) -> Column:
    return _lookup(JOB_STAGES, stage)


def stage_progress(stage: Column) -> Column:
    return _lookup(STAGE_PROGRESS, stage)


def file_extension(document_type: Column) -> Column:
    return _lookup(FILE_EXTENSIONS, document_type)


def is_image_based(document_type: Column) -> Column:
    return document_type != "pdf"


def image_directory(document_type: Column) -> Column:
    """Folder holding a page's image: renders for PDFs, originals otherwise."""
    return F.when(document_type == "pdf", "Pages").otherwise("Sources")


def error_taxonomy(spark: SparkSession, app_name: str = "the library") -> DataFrame:
    """The closed table of error kinds as a (constant-size) dimension frame."""
    rows = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(message.replace("{app}", app_name)).alias("message"),
            F.lit(recovery).cast("string").alias("recovery"),
        )
        for kind, (message, recovery) in ERRORS.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def describe_errors(failures: DataFrame, app_name: str = "the library") -> DataFrame:
    """Add ``message``, ``recovery`` and the stored one-line text to failure rows.

    Expects ``kind`` and ``detail``. The taxonomy is a 15-row constant, so the
    broadcast cannot grow with the data.
    """
    taxonomy = error_taxonomy(failures.sparkSession, app_name)
    detail = F.coalesce(F.col("detail"), F.lit(""))
    return (
        failures.join(F.broadcast(taxonomy), "kind", "left")
        .withColumn("message", F.replace(F.col("message"), F.lit("%s"), detail))
        .withColumn("stored_text", F.concat_ws(" ", "message", "recovery"))
    )
