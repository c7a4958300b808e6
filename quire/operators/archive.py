"""Archive manifest of job artifacts: order, checksums, running size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import archive_path, is_exportable, natural_key
from .ordered import Ordered, per_group

# Size limit and header bytes per stored entry.
ARCHIVE_CAP = 250 * 1024 * 1024
LOCAL_HEADER, CENTRAL_HEADER = 30, 46


def archive_manifest(files: DataFrame, excluded: list[str], cap: int = ARCHIVE_CAP) -> DataFrame:
    """Entries of each job's archive in natural path order.

    ``files``: job_id, path, content. Adds checksum, size, 0-based entry number,
    running archive size with headers, and whether the cap is passed there. The
    content itself is dropped before anything is shuffled.
    """
    name_bytes = F.octet_length(F.encode("archive_path", "UTF-8"))
    entries = (
        files.filter(is_exportable(F.col("path"), excluded))
        .withColumn("archive_path", archive_path(F.col("path")))
        .withColumn("size", F.length("content").cast("long"))
        .withColumn("crc32", F.crc32("content"))
        .withColumn("_key", natural_key(F.col("archive_path")))
        .withColumn("_bytes", F.col("size") + LOCAL_HEADER + CENTRAL_HEADER + 2 * name_bytes)
        .select("job_id", "archive_path", "size", "crc32", "_key", "_bytes")
    )
    order = [F.col("_key"), F.col("archive_path")]

    def compute(rows: DataFrame, slices: int) -> DataFrame:
        return Ordered(rows, ["job_id"], order, slices).index("entry").running_sum(
            F.col("_bytes"), "running_bytes"
        ).done()

    return (
        per_group(entries, ["job_id"], compute)
        .withColumn("over_cap", F.col("running_bytes") > cap)
        .drop("_key", "_bytes")
    )


def oversized_jobs(manifest: DataFrame) -> DataFrame:
    """Jobs whose archive would pass the cap."""
    return manifest.groupBy("job_id").agg(
        F.max("running_bytes").alias("archive_bytes"), F.bool_or("over_cap").alias("too_large")
    )
