"""Sinks: write-once, replace, nested JSON, text artifacts, edit history."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.jobs import edit_history, write_once
from ..operators.ordered import SLICE, slice_rows
from ..runtime import BUCKET, BUCKETS, broadcast_if_small, bucket_of, cut

#: Size of a packed file at which the next one begins.
FILE_BYTES = 64 << 20
#: Bytes of packed texts that one task sorts and writes, in as many files as they need.
SLICE_BYTES = 32 << 20
#: Slices of packed texts for a shuffle partition, where files are small.
SLICES_PER_CORE = 2
#: Rows of text artifacts, a folder each, that one task writes.
TASK_FOLDERS = 2_000


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows below a path; None only where the path does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_once(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Append rows whose key is not stored yet; earlier rows always win.

    ``arrived_at`` decides between rows of one batch. Repeating a batch after a
    failure adds nothing, which makes the sink idempotent. Rows stand in folders
    by bucket of their key: of the stored rows only the keys are read, and only
    in buckets in which the batch has a key. ``read_once`` reads the sink.
    """
    bucketed = rows.withColumn(BUCKET, bucket_of(keys, buckets))
    stored = read_or_none(rows.sparkSession, path)
    existing = bucketed.limit(0)
    if stored is not None:
        touched = [row[0] for row in bucketed.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        existing = stored.select(*keys, BUCKET).filter(F.col(BUCKET).isin(touched))
    fresh = write_once(existing, bucketed, [BUCKET, *keys])
    fresh.repartition(buckets, BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


def read_once(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a write-once sink."""
    return spark.read.parquet(path).drop(BUCKET)


def replace(rows: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Replace a table, or only the partitions that occur in ``rows``."""
    writer = rows.write.mode("overwrite")
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)


def write_nested_json(rows: DataFrame, path: str) -> None:
    """One JSON object per row with ISO-8601 UTC times."""
    rows.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").json(path)


def write_text_artifacts(rows: DataFrame, path: str, key: str = "job_id", text: str = "text") -> None:
    """One folder per key holding its text.

    A folder costs far more than the few bytes in it, so rows are dealt to tasks by their number, whatever their size, and
    every task puts its own folders in place. A job that fails may leave some of them, but no ``_SUCCESS`` file.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(width, math.ceil(rows.count() / TASK_FOLDERS))
    dealt = rows.select(key, F.col(text).alias("value")).repartition(tasks, key)
    (
        dealt.write.mode("overwrite").partitionBy(key).option("lineSep", "\n")
        .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    )


def write_packed(
    rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], text: str = "text", separator: str = "\n",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Texts of all keys in few files of about ``file_bytes``, with an index; ``readers.read_packed`` gives them back.

    A key's texts stand in ``order`` (unique within the key), joined by ``separator``, streamed through a sort: neither
    a key nor a file is ever one value, and a key with a third of all rows is spread over many files. The index has a
    row per key and file it stands in: (keys, ``_slice``, ``_file``, ``_from``, ``_bytes``); a key's rows in order of
    slice and file are its pieces. Null texts count as empty.
    """
    gap = len(separator.encode())
    columns = [*keys, *order]
    body = rows.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    size = (F.octet_length("_text") + gap).cast("long")
    total = body.agg(F.sum(size)).first()[0] or 0
    # a slice has as many files as it needs: tasks do not grow in number with small files
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, min(math.ceil(total / file_bytes), max(SLICES_PER_CORE * width, math.ceil(total / SLICE_BYTES))))
    ranged = slice_rows(body, columns, [], slices)
    # where each text stands in its slice, and in which of the slice's files
    window = Window.partitionBy(SLICE).orderBy(*columns, "_size").rowsBetween(Window.unboundedPreceding, -1)

    def in_files(texts: DataFrame) -> DataFrame:
        # a slice must stay one task, and a small one is not put together with others; equal keys stay in one file
        at = F.coalesce(F.sum("_size").over(window), F.lit(0).cast("long"))
        sized = texts.repartition(slices, SLICE).withColumn("_at", at)
        least = F.min("_at").over(Window.partitionBy(SLICE, *columns))
        return sized.withColumn("_file", F.floor(least / file_bytes).cast("int"))

    placed = cut(in_files(ranged.select(SLICE, *columns, size.alias("_size"))))
    files = placed.groupBy(SLICE, "_file").agg(F.min("_at").alias("_start"))
    last = F.max_by("_size", "_at") + F.max("_at")
    index = (
        placed.join(broadcast_if_small(files), [SLICE, "_file"])
        .groupBy(*keys, SLICE, "_file")
        .agg((F.min("_at") - F.min("_start")).alias("_from"), (last - F.min("_at")).alias("_bytes"))
    )
    # the separator behind a key's very last text is not part of it
    ends = Window.partitionBy(*keys).orderBy(SLICE, "_file")
    behind = F.lead(F.lit(1)).over(ends).isNull()
    index.withColumn("_bytes", F.when(behind, F.col("_bytes") - gap).otherwise(F.col("_bytes"))).write.mode("overwrite").parquet(f"{path}/index")
    texts = in_files(ranged.withColumn("_size", size))
    (
        texts.sortWithinPartitions(SLICE, "_file", "_at").select(SLICE, "_file", F.col("_text").alias("value"))
        .write.mode("overwrite").partitionBy(SLICE, "_file").option("lineSep", separator).text(f"{path}/data")
    )


def apply_edits(current: DataFrame, edits: DataFrame, history_path: str, source_path: str) -> None:
    """Append the replaced texts to history, then replace the current sources."""
    history, updated = edit_history(current, edits)
    history.write.mode("append").parquet(history_path)
    updated.write.mode("overwrite").parquet(source_path)
