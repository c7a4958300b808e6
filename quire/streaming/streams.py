"""Streaming operators.

Each takes a streaming frame (event time as TIMESTAMP) and returns either a
streaming frame or a ``foreachBatch`` function, so the caller picks sink,
trigger and checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paging import completion
from ..operators.jobs import DEADLINE_SECONDS, deadline_slot, finish_state
from ..operators.ordered import Ordered, per_group
from ..runtime import BUCKETS
from ..sources.sinks import append_once
from .versions import append, current, fold

QUIET = "200 milliseconds"


def with_time(rows: DataFrame, ts: str, delay: str, key: str) -> DataFrame:
    """Rows with a watermark. A row without a key only tells the time: it moves the watermark on and goes no further.

    Such a row, sent when a source is quiet or has ended, lets everything older be settled.
    """
    # the event time in the test keeps it behind the watermark, which would not see the row otherwise
    return rows.withWatermark(ts, delay).filter(F.when(F.col(ts).isNotNull(), F.col(key).isNotNull()))


def debounce(queries: DataFrame, key: str, quiet: str = QUIET, delay: str | None = None) -> DataFrame:
    """Last query of each burst: emitted once ``quiet`` passes without another.

    ``queries``: key, ts, query. A stream in append mode emits a burst when the
    watermark (``delay`` behind the newest row) has passed its end; a row with a
    null key tells the time (:func:`with_time`), so a last one settles all bursts.
    Rows more than ``delay`` late are not seen. On a batch frame bursts are found
    with ordered scans, which spread a hot key.
    """
    last = [F.max_by("query", F.struct("ts", "query")).alias("query"), F.count("*").alias("keystrokes")]
    if not queries.isStreaming:
        return _debounce_batch(queries, key, quiet, last)
    rows = with_time(queries, "ts", delay, key) if delay else queries
    burst = F.session_window("ts", quiet)
    return (
        rows.groupBy(key, burst.alias("burst"))
        .agg(*last)
        .select(
            key, F.col("burst.start").alias("started_at"), F.col("burst.end").alias("settled_at"), "query", "keystrokes"
        )
    )


def _debounce_batch(queries: DataFrame, key: str, quiet: str, last: list) -> DataFrame:
    def number(rows: DataFrame, slices: int) -> DataFrame:
        scan = Ordered(rows, [key], [F.col("ts"), F.col("query")], slices).lag({"_before": "ts"})
        near = F.col("ts") <= F.col("_before") + F.expr(f"INTERVAL {quiet}")
        return scan.running_sum(F.when(near, 0).otherwise(1), "_burst").done()

    return (
        per_group(queries.select(key, "ts", "query"), [key], number)
        .groupBy(key, "_burst")
        .agg(
            F.min("ts").alias("started_at"), (F.max("ts") + F.expr(f"INTERVAL {quiet}")).alias("settled_at"), *last
        )
        .drop("_burst")
    )


def arrivals(pages: DataFrame, page: str | None = None) -> DataFrame:
    """Running number of pages per document (update mode); with ``page`` each is counted once, however often it comes.

    The count is combined map-side before the state store sees it.
    """
    rows = pages if page is None else pages.dropDuplicates(["document_id", page])
    return rows.groupBy("document_id").agg(F.count("*").alias("done"))


def keep_arrivals(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch writer of changed counts (update mode): only the buckets of changed documents are written again."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("document_id").agg(F.max("done").alias("done"))  # a count only grows

    def write(batch: DataFrame, epoch: int) -> None:
        fold(batch.select("document_id", "done"), epoch, path, ["document_id"], merge, buckets)

    return write


def with_completion(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """Completed share of each document from its static page count."""
    return counts.join(documents.select("document_id", "page_count"), "document_id").withColumn(
        "progress", completion(F.col("done"), F.col("page_count"))
    )


def within_deadline(
    starts: DataFrame, results: DataFrame, delay: str = "10 minutes", seconds: int = DEADLINE_SECONDS
) -> DataFrame:
    """Results that finish within ``seconds`` of their batch start.

    Watermarks on both sides and the interval bound let the join drop its state.
    Time slots in the join key spread a batch id that has very many rows.
    """
    slot = deadline_slot(F.col("started_at"), seconds)
    left = (
        starts.withWatermark("started_at", delay).withColumn("_slot", F.explode(F.array(slot, slot + 1))).alias("s")
    )
    right = (
        results.withWatermark("finished_at", delay)
        .withColumn("_slot", deadline_slot(F.col("finished_at"), seconds))
        .alias("r")
    )
    on = (
        (F.col("s.batch_id") == F.col("r.batch_id"))
        & (F.col("s._slot") == F.col("r._slot"))
        & (F.col("r.finished_at") >= F.col("s.started_at"))
        & (F.col("r.finished_at") <= F.col("s.started_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    )
    return left.join(right, on).drop(F.col("r.batch_id"), F.col("r._slot"), F.col("s._slot"))


def leftovers(
    planned: DataFrame, results: DataFrame, item: str, delay: str = "10 minutes", seconds: int = DEADLINE_SECONDS
) -> DataFrame:
    """Planned items (batch_id, ``item``, started_at) without a result in time, once their deadline has passed.

    Results: batch_id, ``item``, finished_at. An outer join by equality on batch and item: a batch of any size is spread
    over its items, and both sides leave the state when the watermarks pass. On either side a row without a batch only
    tells the time, so a last one on each lets every planned item be decided.
    """
    left = planned.select("batch_id", item, "started_at").withWatermark("started_at", delay).alias("s")
    right = results.select("batch_id", item, "finished_at").withWatermark("finished_at", delay).alias("r")
    # null-safe: otherwise rows that only tell the time would be dropped in front of the watermark
    on = (
        F.col("s.batch_id").eqNullSafe(F.col("r.batch_id"))
        & F.col(f"s.{item}").eqNullSafe(F.col(f"r.{item}"))
        & (F.col("r.finished_at") >= F.col("s.started_at"))
        & (F.col("r.finished_at") <= F.col("s.started_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    )
    late = left.join(right, on, "left_outer").filter(F.col("r.finished_at").isNull()).select("s.batch_id", f"s.{item}", "s.started_at")
    return late.filter(F.when(F.col("started_at").isNotNull(), F.col("batch_id").isNotNull()))


def first_results(results: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Each request result once, within the watermark of its event time."""
    return results.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(keys)


def save_once(path: str, keys: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch writer that never stores a key twice, also when a batch is repeated; only touched key buckets are looked at."""

    def write(batch: DataFrame, epoch: int) -> None:
        append_once(batch, path, keys, buckets)

    return write


def current_version(spark: SparkSession, path: str) -> DataFrame:
    """Newest version of a table that a stream keeps up to date."""
    return current(spark, path)


#: What an update says of its job, and when; the count keeps its own time, as later updates may come without one.
UPDATE_COLUMNS = ["at", "seq", "stage", "failure_message", "stage_progress", "stage_detail"]


def fold_states(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch writer folding stage updates into one current row per job; :func:`current_states` reads it.

    A batch is reduced to one row per job before it meets the stored states, so
    a job sending most of the updates costs no more than any other. Only buckets
    of jobs with updates are read and written; a repeated epoch changes nothing.
    """

    def merge(rows: DataFrame) -> DataFrame:
        counted = F.when(F.col("counted_at").isNotNull(), F.struct("counted_at", "counted_seq"))
        reduced = rows.groupBy("job_id").agg(
            F.max_by(F.struct(*UPDATE_COLUMNS), F.struct(*UPDATE_COLUMNS[:2])).alias("_update"),
            F.max_by(F.struct("uncertain_count", "counted_at", "counted_seq"), counted).alias("_count"),
        )
        return reduced.select("job_id", "_update.*", "_count.*")

    def write(batch: DataFrame, epoch: int) -> None:
        given = F.col("uncertain_count").isNotNull()
        rows = batch.select(
            "job_id", *UPDATE_COLUMNS, "uncertain_count",
            F.when(given, F.col("at")).alias("counted_at"), F.when(given, F.col("seq")).alias("counted_seq"),
        )
        fold(rows, epoch, path, ["job_id"], merge, buckets)

    return write


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """Current state of each job, as ``jobs.current_state`` gives it."""
    return finish_state(current(spark, path).drop("counted_at", "counted_seq"))


def log_edits(path: str, most_deltas: int = 20) -> Callable[[DataFrame, int], None]:
    """Batch writer of page edits: a delta per epoch, compacted into a snapshot of the newest edit per page.

    Readers overlay the newest edit of each page (see ``library.edit_text``), so
    an edit is visible to the next search without rewriting the page table.
    """

    def newest(rows: DataFrame) -> DataFrame:
        window = Window.partitionBy("page_id").orderBy(F.col("changed_at").desc(), F.col("new_text"))
        return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")

    def write(batch: DataFrame, epoch: int) -> None:
        append(batch, epoch, path, newest, most_deltas)

    return write
