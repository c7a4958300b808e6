"""Streams: driver tables replayed through Structured Streaming, in several turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import library
from quire.runtime import written
from quire.sources import sinks
from quire.streaming import streams

from . import relations as r
from .file_queries import scratch


class Feed:
    """A table that arrives in turns as files, each turn later than the one before, and the stream that reads them."""

    def __init__(self, spark, name: str, rows, by: str, turns: int = 3):
        marks = [i / turns for i in range(1, turns)]
        limits = rows.agg(F.percentile_approx(F.col(by).cast("double"), marks).alias("m")).first()["m"]
        at, bounds = F.col(by).cast("double"), [None, *limits, None]
        self.rows, self.folder, self.spark = rows, scratch(spark, name), spark
        self.add(rows.limit(0))  # a stream needs its folder
        self.turns = [
            (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
            for low, high in zip(bounds, bounds[1:])
        ]

    def send(self, turn: int) -> None:
        self.add(self.rows.filter(self.turns[turn]))

    def add(self, rows) -> None:
        rows.write.mode("append").parquet(self.folder)

    def tell(self, column: str, at: str) -> None:
        """A row that only tells the time."""
        values = [F.lit(at).cast("timestamp") if f.name == column else F.lit(None).cast(f.dataType) for f in self.rows.schema]
        self.add(self.spark.range(1).select(*[v.alias(f.name) for v, f in zip(values, self.rows.schema)]))

    def stream(self):
        return self.spark.readStream.schema(self.rows.schema).parquet(self.folder)


#: Later than every row of the tables, and the whole run of a stream that has ended.
CLOSING = "2100-01-01 00:00:00"


def drain(writer, progress: str) -> None:
    """Run a stream over what has arrived since its last run."""
    writer.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def run_turns(feeds, start, turns: int = 3, close=None) -> None:
    """Let the feeds arrive turn by turn, running the stream after each; ``close`` feeds the last run."""
    for turn in range(turns):
        for feed in feeds:
            feed.send(turn)
        start()
    if close:
        close()
        start()


def _event_feed(spark, sf_dir, name: str, rows=None, by: str = "ts"):
    return Feed(spark, name, r.events(spark, sf_dir) if rows is None else rows, by)


def _typed(events):
    return events.select("user_id", "ts", F.col("event_type").alias("query"))


def debounced_queries(spark, sf_dir):
    """Bursts separated by three quiet hours, as a stream in append mode; a last row that tells the time settles all."""
    feed = _event_feed(spark, sf_dir, "typed", _typed(r.events(spark, sf_dir)))
    stream = streams.debounce(feed.stream(), "user_id", "3 hours", "1 hour")
    out, progress = scratch(spark, "debounce"), scratch(spark, "debounce-progress")
    run_turns(
        [feed], lambda: drain(stream.writeStream.outputMode("append").format("parquet").option("path", out), progress),
        close=lambda: feed.tell("ts", CLOSING),
    )
    return spark.read.schema(stream.schema).parquet(out)


def debounced_batch(spark, sf_dir):
    """The same operator on a batch frame, with the default quiet time."""
    return streams.debounce(_typed(r.events(spark, sf_dir)), "user_id")


def streamed_job_states(spark, sf_dir):
    """Updates in the order of their ids, in three epochs, then all of them again under a renewed checkpoint."""
    from .job_queries import stage_updates

    path = scratch(spark, "states")
    feed = _event_feed(spark, sf_dir, "updates", by="event_id")
    progress = scratch(spark, "states-progress")
    updates = stage_updates(feed.stream())
    run_turns([feed], lambda: drain(updates.writeStream.foreachBatch(streams.fold_states(path)), progress))
    drain(updates.writeStream.foreachBatch(streams.fold_states(path)), scratch(spark, "states-again"))
    return streams.current_states(spark, path)


def page_arrivals(spark, sf_dir):
    """Orders arrive as pages of their customer, a third of them twice; the expected count is static."""
    pages = r.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_id"))
    documents = r.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 9 + 6).cast("int").alias("page_count")
    )
    feed = Feed(spark, "arriving", pages, "page_id")
    path, progress = scratch(spark, "arrivals"), scratch(spark, "arrivals-progress")
    counts = streams.arrivals(feed.stream(), "page_id")
    run_turns(
        [feed], lambda: drain(counts.writeStream.outputMode("update").foreachBatch(streams.keep_arrivals(path)), progress),
        close=lambda: feed.send(0),
    )
    return streams.with_completion(streams.current_version(spark, path), documents).select("document_id", "done", "page_count", "progress")


def streamed_deadline(spark, sf_dir):
    events = r.events(spark, sf_dir)
    starts = _event_feed(spark, sf_dir, "starts", events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("batch_id"), F.col("ts").alias("started_at"), F.col("event_id").alias("start_id")
    ), "started_at")
    results = _event_feed(spark, sf_dir, "results", events.filter("event_type <> 'purchase'").select(
        F.col("user_id").alias("batch_id"), F.col("ts").alias("finished_at"), "event_id"
    ), "finished_at")
    joined = streams.within_deadline(starts.stream(), results.stream()).select("batch_id", "start_id", "event_id")
    out, progress = scratch(spark, "deadline"), scratch(spark, "deadline-progress")
    run_turns([starts, results], lambda: drain(joined.writeStream.format("parquet").option("path", out), progress))
    return spark.read.schema(joined.schema).parquet(out)


def streamed_deadline_leftovers(spark, sf_dir):
    """Order lines planned with their order and not received within a month, by an outer join of two streams."""
    from .job_queries import MONTH, shipping

    planned, results = shipping(spark, sf_dir)
    planned = written(planned)  # joined once, read for the turns' limits and by each turn
    plans, found = Feed(spark, "planned", planned, "started_at"), Feed(spark, "received", results, "finished_at")
    late = streams.leftovers(plans.stream(), found.stream(), "line", "1 day", MONTH).select("batch_id", "line")
    out, progress = scratch(spark, "leftovers"), scratch(spark, "leftovers-progress")

    def close():
        plans.tell("started_at", CLOSING)
        found.tell("finished_at", CLOSING)

    run_turns([plans, found], lambda: drain(late.writeStream.format("parquet").option("path", out), progress), close=close)
    return spark.read.schema(late.schema).parquet(out)


def streamed_first_results(spark, sf_dir):
    """Each request key once: deduplicated in the stream and saved once, also by a stream that begins anew."""
    rows = r.events(spark, sf_dir).select("user_id", "event_type", F.col("ts").alias("arrived_at"))
    feed = _event_feed(spark, sf_dir, "requests", rows, "arrived_at")
    first = streams.first_results(feed.stream(), ["user_id", "event_type"], "60 days")
    path, progress = scratch(spark, "first"), scratch(spark, "first-progress")
    save = streams.save_once(path, ["user_id", "event_type"])
    run_turns([feed], lambda: drain(first.writeStream.foreachBatch(save), progress))
    drain(first.writeStream.foreachBatch(save), scratch(spark, "first-again"))
    return sinks.read_once(spark, path).select("user_id", "event_type")


def streamed_edits(spark, sf_dir):
    """Edits logged by a stream and laid over the pages by the reader; the checkpoint is renewed on the way."""
    edits = r.events(spark, sf_dir).select(
        F.concat_ws("-", "user_id", (F.col("event_id") % 5)).alias("page_id"),
        F.concat_ws(" ", F.lit("corrected by hand"), "event_id").alias("new_text"),
        F.col("ts").alias("changed_at"),
    )
    feed = Feed(spark, "edits", edits, "changed_at")
    path, progress = scratch(spark, "edit-log"), [scratch(spark, "edit-progress")]
    log = streams.log_edits(path, most_deltas=2)
    run_turns(
        [feed], lambda: drain(feed.stream().writeStream.foreachBatch(log), progress[0]),
        close=lambda: progress.__setitem__(0, scratch(spark, "edit-again")),
    )
    newest = streams.current_version(spark, path)
    documents, pages = library.edit_text(r.chat_documents(spark, sf_dir), r.chat_pages(spark, sf_dir), newest)
    return pages.join(documents.select("document_id", "updated_at"), "document_id").select("page_id", "text", "updated_at")


QUERIES = {
    f.__name__: f
    for f in (
        debounced_queries, debounced_batch, streamed_job_states, page_arrivals, streamed_deadline, streamed_deadline_leftovers,
        streamed_first_results, streamed_edits,
    )
}

_BURSTS = """
WITH f AS (SELECT user_id, ts, event_type, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL {0} AS near FROM events),
g AS (SELECT *, count(*) FILTER (near IS NOT true) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM f),
s AS (SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL {0} AS settled_at, arg_max(event_type, ts) AS query,
             count(*) AS keystrokes FROM g GROUP BY user_id, burst)
SELECT * FROM s"""


def _oracle() -> dict:
    from . import job_queries, library_queries

    return {
        "debounced_queries": _BURSTS.format("3 HOUR"),
        "debounced_batch": _BURSTS.format("200 MILLISECOND"),
        "streamed_job_states": job_queries.ORACLE["job_states"],
        "page_arrivals": "SELECT o_custkey AS document_id, count(*) AS done, CAST(o_custkey % 9 + 6 AS INTEGER) AS page_count, "
        "least(count(*), o_custkey % 9 + 6) / CAST(o_custkey % 9 + 6 AS DOUBLE) AS progress FROM orders "
        "WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey",
        "streamed_deadline": job_queries.ORACLE["deadline_results"],
        "streamed_deadline_leftovers": job_queries.ORACLE["deadline_leftovers"],
        "streamed_first_results": "SELECT DISTINCT user_id, event_type FROM events",
        "streamed_edits": library_queries.ORACLE["edit_page_text"],
    }


ORACLE = _oracle()
