"""Bookkeeping of multi-stage jobs: plans, caches, resume, evidence, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paging
from ..functions.geometry import plan_crops
from ..functions.names import REFINEMENT_CACHE, history_stamp, vision_cache_path
from ..functions.text import trim_all
from ..runtime import spread
from .ordered import Ordered, per_group, same_keys
from .parts import PART, several_parts, sums_before

# Page separator, evidence headings, crop label, history path, deadline.
PAGE_BREAK = '\n\n<div class="page-break"></div>\n\n'
OVERVIEW_HEADING = "## Complete-page overview\n"
CROPS_HEADING = "\n\n## High-resolution crops\n"
LEGACY_HEADING = "\n\n## Legacy OCR draft\n"
CROP_LABEL = "### Crop %d/%d, top to bottom\n"
HISTORY_PREFIX, HISTORY_SUFFIX = "edits/history-", ".md"
DEADLINE_SECONDS = 210

#: Pages per part when a job's pages are gathered into one value.
PART_PAGES = 4096

REQUEST_KEYS = ["job_id", "page_index", "kind", "crop_index"]


def plan_requests(pages: DataFrame) -> DataFrame:
    """Work list per page: one overview and 3 to 6 crops, with cache paths.

    Expects job_id, page_index, width, height.
    """
    overview = pages.select(
        "job_id", "page_index", F.lit("overview").alias("kind"), F.lit(-1).alias("crop_index")
    )
    crops = plan_crops(pages).select("job_id", "page_index", F.lit("crop").alias("kind"), "crop_index")
    work = overview.unionByName(crops)
    return work.withColumn(
        "cache_path", vision_cache_path(F.col("page_index"), F.col("kind"), F.col("crop_index"))
    )


def pending_work(expected: DataFrame, cached: DataFrame, keys: Sequence[str] = REQUEST_KEYS) -> DataFrame:
    """Expected requests without a saved result."""
    return expected.join(cached.select(*keys), list(keys), "left_anti")


def reusable_work(expected: DataFrame, cached: DataFrame, keys: Sequence[str] = REQUEST_KEYS) -> DataFrame:
    """Expected requests that have a saved result."""
    return expected.join(cached.select(*keys), list(keys), "left_semi")


def batch_completeness(expected: DataFrame, cached: DataFrame, keys: Sequence[str] = REQUEST_KEYS) -> DataFrame:
    """(completed, total) requests per job page; a page is ready when both agree."""
    done = cached.select(*keys).distinct().withColumn("_done", F.lit(True))
    return (
        expected.join(done, list(keys), "left")
        .groupBy("job_id", "page_index")
        .agg(F.count_if(F.col("_done")).alias("completed"), F.count("*").alias("total"))
        .withColumn("ready", F.col("completed") == F.col("total"))
    )


def write_once(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to append so that existing keys win and each new key is saved once."""
    window = Window.partitionBy(*keys).orderBy("arrived_at")
    first = incoming.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")
    return first.join(existing.select(*keys), list(keys), "left_anti")


def effective_source(jobs: DataFrame, edited: DataFrame, machine: DataFrame) -> DataFrame:
    """Edited text when there is one, else the machine text, else empty."""
    return (
        jobs.join(edited.select("job_id", F.col("source").alias("_edited")), "job_id", "left")
        .join(machine.select("job_id", F.col("source").alias("_machine")), "job_id", "left")
        .withColumn("source", F.coalesce("_edited", "_machine", F.lit("")))
        .drop("_edited", "_machine")
    )


def edit_history(current: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history rows to append, new current sources) for (job_id, source, edited_at).

    Blank edits are rejected. The edits of a job follow each other by time, then text: each
    sends the text before it to history with its own stamp, and the last one is current.
    A job with most of the edits is spread over slices.
    """
    clean = edits.select("job_id", "edited_at", trim_all(F.col("source")).alias("source")).filter("source <> ''")
    order = [F.col("edited_at"), F.col("source")]
    turns = per_group(
        clean, ["job_id"], lambda rows, slices: Ordered(rows, ["job_id"], order, slices).lag({"_before": "source"}).done()
    )
    old = current.select("job_id", F.col("source").alias("_old"))
    history = (
        turns.join(old, "job_id", "left")
        .withColumn("_replaced", F.coalesce("_before", "_old"))
        .filter("_replaced is not null")
        .select(
            "job_id",
            F.concat(F.lit(HISTORY_PREFIX), history_stamp(F.col("edited_at")), F.lit(HISTORY_SUFFIX)).alias("path"),
            F.col("_replaced").alias("source"),
        )
    )
    last = clean.groupBy("job_id").agg(F.max_by("source", F.struct("edited_at", "source")).alias("source"))
    kept = current.select("job_id", "source").join(last.select("job_id"), "job_id", "left_anti")
    return history, kept.unionByName(last)


def page_mismatches(manifests: DataFrame, pages: DataFrame) -> DataFrame:
    """Jobs whose pages are not exactly 0 … page_count-1.

    ``manifests``: job_id, page_count. ``pages``: job_id, page_index.
    """
    counted = pages.groupBy("job_id").agg(
        F.count("*").alias("actual"),
        F.min("page_index").alias("first_index"),
        F.max("page_index").alias("last_index"),
        F.count_distinct("page_index").alias("_different"),
    )
    actual = F.coalesce("actual", F.lit(0).cast("long"))
    wrong = (
        (actual != F.coalesce("page_count", F.lit(-1)))
        | (F.coalesce("_different", actual) != actual)
        | (F.coalesce("first_index", F.lit(0)) != 0)
        | (F.coalesce("last_index", actual - 1) != actual - 1)
    )
    return (
        manifests.join(counted, "job_id", "full_outer")
        .withColumn("actual", actual)
        .filter(wrong)
        .select("job_id", F.col("page_count").alias("expected"), "actual", "first_index", "last_index")
    )


def cached_page_mismatches(cached: DataFrame) -> DataFrame:
    """Saved pages whose own index is not that of their place: (job_id, path, expected, actual).

    ``cached``: job_id, path (as ``names.refinement_cache_path`` names it), page_index (as the saved page says; null where
    it says none). Files of another name are none of these pages. A row-local check: nothing is shuffled.
    """
    prefix, suffix = REFINEMENT_CACHE.split("%03d")
    number = F.regexp_extract("path", rf"(?:\A|/)\Q{prefix}\E([0-9]+)\Q{suffix}\E\z", 1)
    expected = F.when(number != "", number.cast("int") - 1)
    return (
        cached.select("job_id", "path", expected.alias("expected"), F.col("page_index").alias("actual"))
        .filter(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col("actual")))
    )


def join_refinements(ocr_pages: DataFrame, refinements: DataFrame) -> DataFrame:
    """OCR page next to its refinement by page index; one-sided pages are flagged."""
    return ocr_pages.join(refinements, ["job_id", "page_index"], "full_outer").withColumn(
        "matched", F.col("markdown").isNotNull() & F.col("final_markdown").isNotNull()
    )


def assemble_markdown(pages: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """Pages of a job joined by page-break markers, in page order.

    Emits parts of ``part_pages`` pages; join parts with the same marker for the
    whole (``parts.whole``). Ordinary jobs are a single part 0.
    """
    marker = PAGE_BREAK.replace("\n", "\\n")
    return (
        pages.withColumn(PART, F.floor(F.col("page_index") / part_pages).cast("int"))
        .groupBy("job_id", PART)
        .agg(F.expr(f"listagg(final_markdown, '{marker}') within group (order by page_index)").alias("markdown"))
    )


def split_pages(sources: DataFrame, part_pages: int | None = None) -> DataFrame:
    """Assembled source back to pages at its page-break lines.

    Where sources have a ``part``, pages are numbered on from the parts before; with ``part_pages`` a part begins at
    its own page number, as it was assembled.
    """
    breaks = r"(?:\A|(?<=\n))[\t\p{Zs}]*+(?:<div class=\"page-break\"></div>|<!-- page-break -->)[\t\p{Zs}]*+(?=\r?\n|\z)"
    texts = F.split("markdown", breaks)
    if PART not in sources.columns:
        rows = sources.withColumn("_before", F.lit(0))
    elif part_pages:
        rows = sources.withColumn("_before", F.col(PART) * part_pages)
    else:
        rows = sums_before(sources, ["job_id"], {"_before": F.size(texts)}, several_parts(sources, ["job_id"]))
    return rows.select("job_id", "_before", F.posexplode(texts).alias("page_index", "_text")).select(
        "job_id", (F.col("_before") + F.col("page_index")).cast("int").alias("page_index"), trim_all(F.col("_text")).alias("markdown")
    )


def merge_evidence(
    overviews: DataFrame, crops: DataFrame, legacy: DataFrame, instructions: str = ""
) -> DataFrame:
    """Evidence text per page: overview, labelled crops in order, older OCR draft.

    ``instructions`` go in front and are the caller's. A page has at most six
    crops by plan, which bounds the gathered text.
    """
    keys = ["job_id", "page_index"]
    total = F.count("*").over(Window.partitionBy(*keys))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("crop_index"))
    labelled = crops.withColumn("_of", total).withColumn("_nth", nth).withColumn(
        "_label",
        F.concat(
            F.format_string(CROP_LABEL, F.col("_nth"), F.col("_of")), F.col("transcript")
        ),
    )
    joined = labelled.groupBy(*keys).agg(
        F.expr("listagg(_label, '\\n\\n') within group (order by _nth)").alias("_crops")
    )
    evidence = F.concat(
        F.lit(instructions),
        F.lit(OVERVIEW_HEADING), F.col("overview"),
        F.lit(CROPS_HEADING), F.coalesce("_crops", F.lit("")),
        F.lit(LEGACY_HEADING), F.coalesce("legacy", F.lit("")),
    )
    return (
        overviews.join(joined, keys, "left").join(legacy, keys, "left").select(*keys, evidence.alias("evidence"))
    )


def page_evidence(overviews: DataFrame, crops: DataFrame, merges: DataFrame) -> DataFrame:
    """Nested evidence record per page; crops become an ordered array."""
    keys = ["job_id", "page_index"]
    entry = F.struct(F.col("crop_index").alias("index"), "transcript", "usage")
    gathered = crops.groupBy(*keys).agg(F.array_sort(F.collect_list(entry), _by_index).alias("crops"))
    return (
        overviews.join(gathered, keys, "left")
        .join(merges, keys)
        .select(*keys, "overview", "crops", F.col("merge_text").alias("final_markdown"))
    )


def _by_index(a: Column, b: Column) -> Column:
    return F.when(a["index"] < b["index"], -1).when(a["index"] > b["index"], 1).otherwise(0)


def job_records(evidence: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """Nested record per job (and part of ``part_pages`` pages); ``parts.whole_array`` puts them together."""
    page = F.struct("page_index", "overview", "crops", "final_markdown")
    return (
        evidence.withColumn(PART, F.floor(F.col("page_index") / part_pages).cast("int"))
        .groupBy("job_id", PART)
        .agg(F.sort_array(F.collect_list(page)).alias("pages"))
    )


def record_lines(evidence: DataFrame) -> DataFrame:
    """(job_id, page_index, json): one record per job as JSON text in pieces of a page.

    The pieces of a job in page order, joined by commas, are ``{"job_id":…,"pages":[…]}``. Written with
    ``sinks.write_packed`` a record of any number of pages is one stretch of a file and never one value.
    """
    page = F.to_json(F.struct("page_index", "overview", "crops", "final_markdown"))
    ends = evidence.groupBy("job_id").agg(F.min("page_index").alias("_first"), F.max("page_index").alias("_last"))
    # one row per job: the head and the foot of its record
    rows = evidence.select("job_id", "page_index", page.alias("_json")).alias("a").join(ends.alias("b"), same_keys(["job_id"]))
    rows = rows.select("a.*", "_first", "_last")
    named = F.to_json(F.struct("job_id"))
    opened = F.when(F.col("job_id").isNull(), F.lit("{")).otherwise(F.concat(F.substring(named, F.lit(1), F.length(named) - 1), F.lit(",")))
    head = F.concat(opened, F.lit('"pages":['))
    text = F.concat(
        F.when(F.col("page_index") == F.col("_first"), head).otherwise(""), F.col("_json"),
        F.when(F.col("page_index") == F.col("_last"), F.lit("]}")).otherwise(""),
    )
    return rows.select("job_id", "page_index", text.alias("json"))


def current_state(updates: DataFrame) -> DataFrame:
    """Fold stage updates to the current state of each job.

    Stage, failure message, progress and detail always follow the latest update,
    even to null; the uncertain count keeps its latest given value. Latest rows
    are selected with a ranked filter that keeps one row per task and job, so a
    job with very many updates never gathers in one place.
    """
    window = Window.partitionBy("job_id").orderBy(F.col("at").desc(), F.col("seq").desc())
    latest = updates.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n", "uncertain_count")
    counted = (
        updates.filter("uncertain_count IS NOT NULL")
        .withColumn("_n", F.row_number().over(window))
        .filter("_n = 1")
        .select("job_id", "uncertain_count")
    )
    return finish_state(latest.join(counted, "job_id", "left"))


def finish_state(latest: DataFrame) -> DataFrame:
    """Newest updates with their latest counts, as states to show."""
    progress = paging.clamp_unit(F.col("stage_progress"))
    return (
        latest.withColumn("uncertain_count", F.coalesce("uncertain_count", F.lit(0)))
        .withColumn("stage_progress", progress)
        .withColumn("displayed_progress", paging.displayed_progress(F.col("stage_progress"), F.col("stage")))
        .withColumnRenamed("at", "updated_at")
        .drop("seq")
    )


def latest_manifests(manifests: DataFrame) -> DataFrame:
    """Newest manifest per job."""
    window = Window.partitionBy("job_id").orderBy(F.col("updated_at").desc(), F.col("seq").desc())
    return manifests.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def retry_plan(calls: DataFrame) -> DataFrame:
    """Classify a call log: retryable or not, and the delay before the next try."""
    retry = paging.is_retryable(F.col("status"), F.col("attempt"))
    return calls.withColumn("retryable", retry).withColumn(
        "delay_seconds", F.when(retry, paging.retry_delay(F.col("attempt"), F.col("retry_after")))
    )


def deadline_slot(at: Column, seconds: int) -> Column:
    """Number of the deadline-long time slot an instant falls into."""
    return F.floor(F.unix_micros(at) / (seconds * 1_000_000)).cast("long")


def split_by_deadline(starts: DataFrame, results: DataFrame, seconds: int = DEADLINE_SECONDS) -> DataFrame:
    """Results in time for their batch: within ``seconds`` of its start.

    A result can only belong to a start in its own or the slot before, so the
    join runs on (batch, slot): a batch id with very many rows is spread over
    its slots and never pairs all its starts with all its results.
    """
    slot = deadline_slot(F.col("started_at"), seconds)
    begun = starts.withColumn("_slot", F.explode(F.array(slot, slot + 1)))
    limit = F.col("started_at") + F.make_interval(secs=F.lit(seconds))
    return (
        results.withColumn("_slot", deadline_slot(F.col("finished_at"), seconds))
        .join(begun, ["batch_id", "_slot"])
        .filter((F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= limit))
        .drop("_slot")
    )


def deadline_leftovers(planned: DataFrame, results: DataFrame, item: str, seconds: int = DEADLINE_SECONDS) -> DataFrame:
    """Planned items (batch_id, ``item``, started_at) without a result in time, ready to be planned again.

    Items are matched by equality on batch and item, so a batch of any size is spread over its items. Only rows that
    can meet are sorted, in as many partitions as shuffles have.
    """
    limit = F.col("p.started_at") + F.make_interval(secs=F.lit(seconds))
    met = (
        (F.col("p.batch_id") == F.col("r.batch_id"))
        & (F.col(f"p.{item}") == F.col(f"r.{item}"))
        & (F.col("r.finished_at") >= F.col("p.started_at"))
        & (F.col("r.finished_at") <= limit)
    )
    timed = spread(results.select("batch_id", item, "finished_at").dropna(), "batch_id", item)
    return spread(planned, "batch_id", item).alias("p").join(timed.alias("r"), met, "left_anti")


def deadline_progress(planned: DataFrame, leftovers: DataFrame) -> DataFrame:
    """(batch_id, completed, total) after the deadline."""
    rows = planned.select("batch_id", F.lit(0).alias("_left")).unionByName(leftovers.select("batch_id", F.lit(1).alias("_left")))
    total = F.count_if(F.col("_left") == 0)
    return rows.groupBy("batch_id").agg((total - F.sum("_left")).alias("completed"), total.alias("total"))
