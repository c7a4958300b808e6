"""Response ingestion and job bookkeeping over tables derived from the driver data."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.names import refinement_cache_path, vision_cache_path
from quire.operators import ingest, jobs, parts
from quire.runtime import spread
from quire.sources import readers, sinks

from . import relations as r
from .file_queries import scratch

# --- OCR responses: one per web page, a response page per paragraph -----------------------


def _image(name_field: str | None, name: str | None, prefix: str, payload):
    """JSON text of one image member."""
    members = [] if name_field is None else [F.lit(f'"{name_field}":"{name}",')]
    return F.concat(F.lit("{"), *members, F.lit(f'"image_base64":"{prefix}base64,'), payload, F.lit('"}'))


def ocr_responses(spark, sf_dir):
    """Bodies as JSON text; some broken, some without pages."""
    rows = r.table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")

    def page(paragraph, i):
        payload = F.base64(F.encode(F.concat(F.lit("fig "), i.cast("string")), "UTF-8"))
        images = F.array(
            _image("id", "img-0.jpeg", "data:image/jpeg;", payload),
            F.when((F.col("page_id") % 4 == 0) & (i % 2 == 0), _image("id", "img-0-jpeg-2", "data:image/jpeg;", payload))
            .otherwise(none),
            F.when(i % 2 == 0, _image("id", "img-0.jpeg", "data:image/jpg;", payload)).otherwise(none),
            F.when(i % 3 == 1, _image("name", "../fig one", "data:image/gif;", payload)).otherwise(none),
            F.when(i % 3 == 2, F.concat(F.lit('{"id":7,"base64":"'), payload, F.lit('"}'))).otherwise(none),
            F.when(i % 5 == 4, F.lit('{"id":"bad","base64":"abc"}')).otherwise(none),
        )
        text = F.to_json(F.struct(F.concat(F.lit("See img-0.jpeg in "), paragraph).alias("markdown")))
        return F.concat(
            F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"images":['),
            F.array_join(F.filter(images, lambda x: x.isNotNull()), ","), F.lit("]}"),
        )

    paragraphs = F.split("html", "<p>")
    body = F.concat(F.lit('{"pages":['), F.array_join(F.transform(paragraphs, page), ","), F.lit("]}"))
    return rows.select(
        F.col("page_id").alias("job_id"),
        F.when(F.col("page_id") % 10 == 9, F.lit('{"pages": oops'))
        .when(F.col("page_id") % 10 == 8, F.lit('{"result": []}'))
        .otherwise(body).alias("body"),
    )


def ocr_assets(spark, sf_dir):
    parsed, _ = ingest.parse_responses(ocr_responses(spark, sf_dir), "job_id")
    return ingest.ocr_assets(parsed, "job_id").select(
        "job_id", "page_index", "image_index", "original_name", "local_name", F.hex("data").alias("data_hex")
    )


def ocr_pages(spark, sf_dir):
    parsed, _ = ingest.parse_responses(ocr_responses(spark, sf_dir), "job_id")
    return ingest.ocr_pages(parsed, "job_id")


def ocr_quarantine(spark, sf_dir):
    return ingest.parse_responses(ocr_responses(spark, sf_dir), "job_id")[1]


_SQL_PARAGRAPHS = """
para AS (SELECT page_id AS job_id, string_split(html, '<p>') AS ps FROM pages WHERE page_id % 10 NOT IN (8, 9)),
par AS (SELECT job_id, CAST(unnest(range(len(ps))) AS INTEGER) AS i, unnest(ps) AS text FROM para),
raw AS (
  SELECT job_id, i, text, list_filter([
    {'n': 'img-0.jpeg', 's': 'img-0-jpeg', 'e': 'jpg', 'u': 1, 'ok': true},
    CASE WHEN job_id % 4 = 0 AND i % 2 = 0 THEN {'n': 'img-0-jpeg-2', 's': 'img-0-jpeg-2', 'e': 'jpg', 'u': 1, 'ok': true} END,
    CASE WHEN i % 2 = 0 THEN {'n': 'img-0.jpeg', 's': 'img-0-jpeg', 'e': 'jpg',
                              'u': CASE WHEN job_id % 4 = 0 THEN 3 ELSE 2 END, 'ok': true} END,
    CASE WHEN i % 3 = 1 THEN {'n': '../fig one', 's': 'fig-one', 'e': 'gif', 'u': 1, 'ok': true} END,
    CASE WHEN i % 3 = 2 THEN {'n': '', 's': '', 'e': 'png', 'u': 1, 'ok': true} END,
    CASE WHEN i % 5 = 4 THEN {'n': 'bad', 's': 'bad', 'e': 'png', 'u': 1, 'ok': false} END],
    lambda x: x IS NOT NULL) AS images FROM par),
img AS (SELECT job_id, i, CAST(unnest(range(len(images))) AS INTEGER) AS k, unnest(images) AS g FROM raw),
asset AS (
  SELECT job_id, i AS page_index, k AS image_index,
         CASE WHEN g.n = '' THEN 'figure-' || (k + 1) ELSE g.n END AS original_name,
         printf('page-%03d-%s%s.%s', i + 1, CASE WHEN g.s = '' THEN 'figure-' || (k + 1) ELSE g.s END,
                CASE WHEN g.u > 1 THEN '-' || g.u ELSE '' END, g.e) AS local_name,
         hex(encode('fig ' || i)) AS data_hex
  FROM img WHERE g.ok)"""

SQL_OCR_PAGES = f"""
WITH {_SQL_PARAGRAPHS},
link AS (SELECT job_id, page_index, string_agg(
           CASE WHEN image_index > 0 THEN chr(10) || chr(10) || '![Extracted figure](assets/' || local_name || ')' ELSE '' END,
           '' ORDER BY image_index) AS extra FROM asset GROUP BY ALL)
SELECT link.job_id, page_index, trim(replace('See img-0.jpeg in ' || text, 'img-0.jpeg',
         'assets/' || printf('page-%03d-img-0-jpeg.jpg', page_index + 1)) || extra, chr(10) || ' ') AS markdown
FROM link JOIN par ON par.job_id = link.job_id AND par.i = link.page_index"""

# --- chat completions: one per conversation turn ------------------------------------------


def completion_responses(spark, sf_dir):
    rows = r.table(spark, sf_dir, "conversations")
    content = F.when(F.col("turn") % 5 == 3, F.lit(" \n ")).otherwise(F.concat(F.lit("\n"), "text", F.lit(" ")))
    choices = F.array(F.struct(F.struct(content.alias("content")).alias("message")))
    usage = F.when(
        F.col("role") != "system",
        F.struct(
            F.col("conv_id").alias("prompt_tokens"),
            F.when(F.col("turn") > 0, F.col("turn")).alias("completion_tokens"),
            (F.col("conv_id") + F.col("turn")).alias("total_tokens"),
        ),
    )
    body = F.to_json(F.struct(choices.alias("choices"), usage.alias("usage")))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("conv_id") % 9 == 4, F.substring(body, F.lit(1), F.length(body) - 5)).otherwise(body).alias("body"),
    )


def completions(spark, sf_dir):
    good, _ = ingest.parse_completions(completion_responses(spark, sf_dir))
    return good.select("conv_id", "turn", "text", "usage.prompt_tokens", "usage.completion_tokens", "usage.total_tokens")


def completion_quarantine(spark, sf_dir):
    _, bad = ingest.parse_completions(completion_responses(spark, sf_dir))
    return bad.select("conv_id", "turn", "body")


# --- recogniser output --------------------------------------------------------------------


def clean_observations(spark, sf_dir):
    """Observations per document: its lines, with two candidates each."""
    rows = r.table(spark, sf_dir, "documents")
    observed = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.array(
                F.struct(F.concat(F.lit(" "), line).alias("text"), F.lit(0.9).alias("confidence")),
                F.struct(F.lit("worse").alias("text"), F.lit(0.1).alias("confidence")),
            ).alias("candidates"),
            (i / 100.0).alias("x"), F.lit(0.5).alias("y"), F.lit(0.1).alias("w"), F.lit(0.05).alias("h"),
        ),
    )
    found = ingest.clean_observations(rows.select("doc_id", observed.alias("observations")), ["doc_id"])
    return found.select("doc_id", "reading_order", "text", "confidence")


def best_candidates(spark, sf_dir):
    """Order lines compete as readings of their order; the best discount wins."""
    rows = r.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block_id"),
        F.col("l_discount").alias("confidence"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("candidate_index"),
    )
    return ingest.best_candidates(rows, ["block_id"]).select("block_id", "confidence", "candidate_index")


def language_negotiation(spark, sf_dir):
    rows = r.table(spark, sf_dir, "documents")
    requested = F.array(F.lit("en"), F.lit("zh"), F.col("lang"), F.lit("fr"))
    supported = (
        F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>"))
        .when(F.col("doc_id") % 4 == 1, F.array(F.lit("ja"), F.lit("ko")))
        .otherwise(F.array(F.lit("fr"), F.lit("de"), F.lit("en")))
    )
    return rows.select("doc_id", F.array_join(ingest.negotiate_languages(requested, supported), ",").alias("languages"))


# --- job plans, caches and records: a job per customer, a page per order ------------------


def job_pages(spark, sf_dir):
    """Pages are numbered per job by the listing order of orders."""
    from quire.operators.library import renumber

    rows = r.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"), "o_orderkey",
        (F.col("o_totalprice") % 3000).cast("int").alias("width"), F.lit(1500).alias("height"),
        "o_orderpriority", "o_orderstatus", "o_orderdate",
    )
    return renumber(rows, ["job_id"], ["o_orderkey"], "page_index")


SQL_JOBS = """
job_pages AS (
  SELECT o_custkey AS job_id, o_orderkey, CAST(trunc(o_totalprice % 3000) AS INTEGER) AS width, 1500 AS height,
         o_orderpriority, o_orderstatus, o_orderdate,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page_index
  FROM orders),
crop AS (
  SELECT *, CASE WHEN width > 0 THEN CAST(least(6, greatest(3, ceil(greatest(width, height) / least(width, height) * 2)))
                 AS INTEGER) ELSE 3 END AS n FROM job_pages),
work AS (
  SELECT job_id, page_index, 'overview' AS kind, -1 AS crop_index, o_orderkey FROM job_pages
  UNION ALL
  SELECT job_id, page_index, 'crop', CAST(unnest(range(n)) AS INTEGER), o_orderkey FROM crop),
cached AS (SELECT job_id, page_index, kind, crop_index FROM work WHERE (o_orderkey + crop_index) % 3 <> 0)"""


def _work(spark, sf_dir):
    """(expected requests, saved results); about a third of the results is missing."""
    pages = job_pages(spark, sf_dir)
    expected = jobs.plan_requests(pages)
    saved = expected.join(pages.select("job_id", "page_index", "o_orderkey"), ["job_id", "page_index"]).filter(
        (F.col("o_orderkey") + F.col("crop_index")) % 3 != 0
    )
    return expected, saved.select(*jobs.REQUEST_KEYS)


def request_plan(spark, sf_dir):
    return _work(spark, sf_dir)[0]


def pending_requests(spark, sf_dir):
    return jobs.pending_work(*_work(spark, sf_dir)).select(*jobs.REQUEST_KEYS)


def reusable_requests(spark, sf_dir):
    return jobs.reusable_work(*_work(spark, sf_dir)).select(*jobs.REQUEST_KEYS)


def batch_completeness(spark, sf_dir):
    return jobs.batch_completeness(*_work(spark, sf_dir))


def write_once(spark, sf_dir):
    """Results arrive as events; a key saved earlier (low keys) wins."""
    arrivals = r.events(spark, sf_dir).select(
        (F.col("event_id") % 3000).alias("key"), F.col("ts").alias("arrived_at"), "value"
    )
    existing = r.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 5).alias("key"))
    return jobs.write_once(existing, arrivals, ["key"])


def effective_source(spark, sf_dir):
    base = r.table(spark, sf_dir, "orders")
    edited = base.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("edited "), "o_orderpriority").alias("source")
    )
    machine = base.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("job_id"), F.concat(F.lit("machine "), "o_orderpriority").alias("source")
    )
    return jobs.effective_source(base.select(F.col("o_orderkey").alias("job_id")), edited, machine)


def _edits(spark, sf_dir):
    base = r.table(spark, sf_dir, "orders")
    current = base.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("source")
    )
    edits = base.filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderkey") % 6 == 0, " \n").otherwise(F.concat(F.lit("\n by hand "), "o_orderstatus")).alias("source"),
        F.col("o_orderdate").cast("timestamp").alias("edited_at"),
    )
    return current, edits


def edit_history(spark, sf_dir):
    return jobs.edit_history(*_edits(spark, sf_dir))[0]


def edited_sources(spark, sf_dir):
    return jobs.edit_history(*_edits(spark, sf_dir))[1]


def page_mismatches(spark, sf_dir):
    """Expected counts come from the account, actual pages from orders."""
    manifests = r.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"), (F.col("c_custkey") % 5 + 8).cast("int").alias("page_count")
    )
    return jobs.page_mismatches(manifests, job_pages(spark, sf_dir).select("job_id", "page_index"))


def cached_page_mismatches(spark, sf_dir):
    """Pages saved under their place; some say another index, some none, and other files lie next to them."""
    page, order = F.col("page_index"), F.col("o_orderkey")
    path = F.when(order % 11 == 5, vision_cache_path(page, F.lit("overview"), F.lit(0))).otherwise(refinement_cache_path(page))
    own = F.when(order % 7 == 3, page + 1).when(order % 13 != 4, page)
    saved = job_pages(spark, sf_dir).select("job_id", path.alias("path"), own.cast("int").alias("page_index"))
    return jobs.cached_page_mismatches(saved)


def refinement_join(spark, sf_dir):
    pages = job_pages(spark, sf_dir)
    ocr = pages.select("job_id", "page_index", F.col("o_orderpriority").alias("markdown"))
    refined = pages.select(
        "job_id", (F.col("page_index") + 1).alias("page_index"), F.col("o_orderstatus").alias("final_markdown")
    )
    return jobs.join_refinements(ocr, refined)


def _chat_job_pages(spark, sf_dir):
    return r.chat_pages(spark, sf_dir).select(
        F.col("document_id").alias("job_id"), (F.col("page_number") - 1).alias("page_index"),
        F.col("text").alias("final_markdown"),
    )


def assembled_markdown(spark, sf_dir):
    return jobs.assemble_markdown(_chat_job_pages(spark, sf_dir))


def split_assembled(spark, sf_dir):
    """Assembling and splitting again gives the pages back."""
    return jobs.split_pages(assembled_markdown(spark, sf_dir))


def assembled_in_parts(spark, sf_dir):
    """Parts of two pages, put together: the same whole sources."""
    cut_up = jobs.assemble_markdown(_chat_job_pages(spark, sf_dir), part_pages=2)
    return parts.whole(cut_up, ["job_id"], "markdown", jobs.PAGE_BREAK)


def split_in_parts(spark, sf_dir):
    """Pages found in parts of two pages are numbered on from part to part."""
    return jobs.split_pages(jobs.assemble_markdown(_chat_job_pages(spark, sf_dir), part_pages=2))


def packed_sources(spark, sf_dir):
    """Pages streamed into packed files, a source one stretch after another, and read back by the index."""
    path = scratch(spark, "packed")
    sinks.write_packed(
        _chat_job_pages(spark, sf_dir), path, ["job_id"], ["page_index"], "final_markdown", jobs.PAGE_BREAK, file_bytes=20_000
    )
    return parts.whole(readers.read_packed(spark, path), ["job_id"], "text")


def merge_evidence(spark, sf_dir):
    pages = job_pages(spark, sf_dir)
    overview = pages.select("job_id", "page_index", F.col("o_orderpriority").alias("overview"))
    crops = jobs.plan_requests(pages).filter("kind = 'crop'").select(
        "job_id", "page_index", "crop_index", F.concat(F.lit("text "), "crop_index").alias("transcript")
    )
    legacy = pages.filter("o_orderstatus = 'F'").select("job_id", "page_index", F.lit("draft").alias("legacy"))
    return jobs.merge_evidence(overview, crops, legacy)


def _evidence(spark, sf_dir):
    pages = job_pages(spark, sf_dir)
    overview = pages.select("job_id", "page_index", F.col("o_orderpriority").alias("overview"))
    crops = jobs.plan_requests(pages).filter("kind = 'crop'").select(
        "job_id", "page_index", "crop_index", F.concat(F.lit("t"), "crop_index").alias("transcript"),
        F.when(F.col("crop_index") > 0, F.struct(F.col("crop_index").alias("total_tokens"))).alias("usage"),
    )
    merged = pages.select("job_id", "page_index", F.col("o_orderstatus").alias("merge_text"))
    return jobs.page_evidence(overview, crops, merged)


def page_evidence(spark, sf_dir):
    """Nested record per page, as JSON text."""
    return _evidence(spark, sf_dir).select("job_id", "page_index", F.to_json("crops").alias("crops"), "final_markdown")


def job_records(spark, sf_dir):
    """Nested record per job, as the JSON text of its pages."""
    return jobs.job_records(_evidence(spark, sf_dir)).select("job_id", "part", F.to_json("pages").alias("pages"))


def records_in_parts(spark, sf_dir):
    """Records in parts of two pages, put together."""
    cut_up = jobs.job_records(_evidence(spark, sf_dir), part_pages=2)
    return parts.whole_array(cut_up, ["job_id"], "pages").select("job_id", F.to_json("pages").alias("pages"))


def packed_records(spark, sf_dir):
    """Records as JSON text in packed files, read back whole."""
    path = scratch(spark, "records")
    sinks.write_packed(jobs.record_lines(_evidence(spark, sf_dir)), path, ["job_id"], ["page_index"], "json", ",", file_bytes=200_000)
    return parts.whole(readers.read_packed(spark, path), ["job_id"], "text")


def _updates(spark, sf_dir):
    return stage_updates(r.events(spark, sf_dir))


def stage_updates(rows):
    """Stage updates of one job per user; details, progress and counts come and go."""
    stages = F.array(*[F.lit(s) for s in ("preparing", "baseOCR", "refining", "rendering", "complete", "failed")])
    return rows.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"),
        F.element_at(stages, (F.col("event_id") % 6 + 1).cast("int")).alias("stage"),
        F.when(F.col("event_id") % 6 == 5, F.col("event_type")).alias("failure_message"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100).alias("uncertain_count"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") / 50.0 - 0.2).alias("stage_progress"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("stage_detail"),
    )


def job_states(spark, sf_dir):
    return jobs.current_state(_updates(spark, sf_dir))


def latest_manifests(spark, sf_dir):
    manifests = _updates(spark, sf_dir).select("job_id", "seq", F.col("at").alias("updated_at"), "stage")
    return jobs.latest_manifests(manifests).orderBy(F.col("updated_at").desc())


def deadline_results(spark, sf_dir):
    """A batch starts with each purchase of a user; later events of that user are results."""
    rows = r.events(spark, sf_dir)
    starts = rows.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("batch_id"), F.col("ts").alias("started_at"), F.col("event_id").alias("start_id")
    )
    results = rows.filter("event_type <> 'purchase'").select(
        F.col("user_id").alias("batch_id"), F.col("ts").alias("finished_at"), "event_id"
    )
    return jobs.split_by_deadline(starts, results).select("batch_id", "start_id", "event_id")


MONTH = 30 * 24 * 3600


def shipping(spark, sf_dir):
    """An order plans its lines; a line has its result when it is received."""
    lines = r.table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "batch_id", "l_linenumber": "line"})
    orders = r.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    planned = spread(lines.select("batch_id", "line"), "batch_id").join(spread(orders, "batch_id"), "batch_id")
    return planned, lines.select("batch_id", "line", F.col("l_shipdate").cast("timestamp").alias("finished_at"))


def deadline_leftovers(spark, sf_dir):
    planned, results = shipping(spark, sf_dir)
    return jobs.deadline_leftovers(planned, results, "line", MONTH).select("batch_id", "line")


def deadline_progress(spark, sf_dir):
    planned, results = shipping(spark, sf_dir)
    return jobs.deadline_progress(planned, jobs.deadline_leftovers(planned, results, "line", MONTH))


_SHIPPED = """WITH k AS (
  SELECT l_orderkey AS batch_id, l_linenumber AS line, o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), s AS (
  SELECT *, EXISTS (SELECT 1 FROM k r WHERE r.batch_id = k.batch_id AND r.line = k.line
    AND r.l_shipdate >= k.o_orderdate AND r.l_shipdate <= k.o_orderdate + INTERVAL 30 DAY) AS in_time FROM k)"""
_JOBS = f"WITH {SQL_JOBS}"
_REQ = "job_id, page_index, kind, crop_index"
_ASSEMBLED = (
    "SELECT conv_id AS job_id, string_agg(text, chr(10) || chr(10) || '<div class=\"page-break\"></div>' || chr(10) || chr(10) "
    "ORDER BY turn) AS {} FROM conversations GROUP BY 1"
)
_CHAT_PAGES = "SELECT conv_id AS job_id, CAST(turn AS INTEGER) AS page_index, trim(text, chr(10) || ' ') AS markdown FROM conversations"
_CROPS = (
    "g AS (SELECT job_id, page_index, '[' || string_agg('{\"index\":' || i || "
    "',\"transcript\":\"t' || i || '\"' || CASE WHEN i > 0 THEN ',\"usage\":{\"total_tokens\":' || i || '}' ELSE '' END || "
    "'}', ',' ORDER BY i) || ']' AS crops FROM (SELECT job_id, page_index, n, unnest(range(n)) AS i FROM crop) GROUP BY ALL)"
)
_RECORDS = (
    f"{_JOBS}, {_CROPS}, p AS (SELECT job_id, page_index, '{{\"page_index\":' || page_index || ',\"overview\":\"' || o_orderpriority || "
    "'\",\"crops\":' || crops || ',\"final_markdown\":\"' || o_orderstatus || '\"}' AS page FROM job_pages JOIN g USING (job_id, page_index))"
)
_UPDATES = """
WITH s AS (
  SELECT user_id AS job_id, event_id AS seq, ts AS updated_at,
         ['preparing','baseOCR','refining','rendering','complete','failed'][CAST(event_id % 6 + 1 AS INTEGER)] AS stage,
         CASE WHEN event_id % 6 = 5 THEN event_type END AS failure_message,
         CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS uncertain_count,
         CASE WHEN event_id % 4 <> 0 THEN least(greatest(value / CAST(50 AS DOUBLE) - CAST(0.2 AS DOUBLE), 0), 1) END
           AS stage_progress,
         CASE WHEN event_id % 2 = 0 THEN props END AS stage_detail
  FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, seq DESC) AS n FROM s),
u AS (SELECT job_id, arg_max(uncertain_count, updated_at) FILTER (uncertain_count IS NOT NULL) AS uncertain_count
      FROM s GROUP BY 1)"""
_PROGRESS = (
    "CASE stage WHEN 'preparing' THEN 0.12 WHEN 'baseOCR' THEN 0.32 WHEN 'refining' THEN 0.62 "
    "WHEN 'rendering' THEN 0.86 WHEN 'complete' THEN 1 ELSE 0 END"
)

QUERIES = {
    f.__name__: f
    for f in (
        ocr_assets, ocr_pages, ocr_quarantine, completions, completion_quarantine, clean_observations, best_candidates,
        language_negotiation, request_plan, pending_requests, reusable_requests, batch_completeness, write_once,
        effective_source, edit_history, edited_sources, page_mismatches, cached_page_mismatches, refinement_join, assembled_markdown,
        split_assembled, assembled_in_parts, split_in_parts, packed_sources, records_in_parts, packed_records, merge_evidence, page_evidence, job_records, job_states, latest_manifests, deadline_results, deadline_leftovers, deadline_progress,
    )
}

ORACLE = {
    "ocr_assets": f"WITH {_SQL_PARAGRAPHS} SELECT * FROM asset",
    "ocr_pages": SQL_OCR_PAGES,
    "ocr_quarantine": "SELECT page_id AS job_id, CASE WHEN page_id % 10 = 9 THEN '{\"pages\": oops' "
    "ELSE '{\"result\": []}' END AS body FROM pages WHERE page_id % 10 IN (8, 9)",
    "completions": "SELECT conv_id, turn, trim(text, chr(10) || ' ') AS text, "
    "CAST(CASE WHEN role <> 'system' THEN conv_id END AS INTEGER) AS prompt_tokens, "
    "CAST(CASE WHEN role <> 'system' AND turn > 0 THEN turn END AS INTEGER) AS completion_tokens, "
    "CAST(CASE WHEN role <> 'system' THEN conv_id + turn END AS INTEGER) AS total_tokens "
    "FROM conversations WHERE conv_id % 9 <> 4 AND turn % 5 <> 3",
    "completion_quarantine": """
WITH c AS (SELECT conv_id, turn, '{"choices":[{"message":{"content":' || to_json(CASE WHEN turn % 5 = 3 THEN ' ' || chr(10) || ' '
    ELSE chr(10) || text || ' ' END) || '}}]' || CASE WHEN role <> 'system' THEN ',"usage":{"prompt_tokens":' || conv_id
    || CASE WHEN turn > 0 THEN ',"completion_tokens":' || turn ELSE '' END || ',"total_tokens":' || (conv_id + turn) || '}' ELSE '' END
    || '}' AS body FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 9 = 4 THEN left(body, length(body) - 5) ELSE body END AS body
FROM c WHERE conv_id % 9 = 4 OR turn % 5 = 3""",
    "clean_observations": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS reading_order, unnest(ls) AS raw FROM l),
c AS (SELECT doc_id, reading_order, regexp_replace(raw, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g') AS text FROM u)
SELECT doc_id, reading_order, text, CAST(0.9 AS DOUBLE) AS confidence FROM c WHERE text <> ''""",
    "best_candidates": "WITH c AS (SELECT l_orderkey AS block_id, l_discount AS confidence, "
    "CAST(l_linenumber * 1000000000::BIGINT + l_partkey * 10000 + l_suppkey AS BIGINT) AS candidate_index FROM lineitem), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY confidence DESC, candidate_index) AS n FROM c) "
    "SELECT block_id, confidence, candidate_index FROM n WHERE n = 1",
    "language_negotiation": "WITH x AS (SELECT doc_id, ['en', 'zh', lang, 'fr'] AS req, CASE WHEN doc_id % 4 = 0 THEN [] "
    "WHEN doc_id % 4 = 1 THEN ['ja', 'ko'] ELSE ['fr', 'de', 'en'] END AS sup FROM documents), "
    "y AS (SELECT *, list_filter(req, lambda l: list_contains(sup, l)) AS use FROM x) "
    "SELECT doc_id, array_to_string(CASE WHEN len(sup) = 0 THEN req WHEN len(use) > 0 THEN use ELSE sup[1:1] END, ',') "
    "AS languages FROM y",
    "request_plan": f"{_JOBS} SELECT {_REQ}, CASE WHEN kind = 'overview' THEN printf('vision-page-%03d-overview.json', "
    "page_index + 1) ELSE printf('vision-page-%03d-crop-%03d.json', page_index + 1, crop_index + 1) END AS cache_path "
    "FROM work",
    "pending_requests": f"{_JOBS} SELECT {_REQ} FROM work EXCEPT SELECT {_REQ} FROM cached",
    "reusable_requests": f"{_JOBS} SELECT {_REQ} FROM work INTERSECT SELECT {_REQ} FROM cached",
    "batch_completeness": f"{_JOBS} SELECT job_id, page_index, count(*) FILTER ((o_orderkey + crop_index) % 3 <> 0) "
    "AS completed, count(*) AS total, count(*) FILTER ((o_orderkey + crop_index) % 3 <> 0) = count(*) AS ready "
    "FROM work GROUP BY job_id, page_index",
    "write_once": "SELECT event_id % 3000 AS key, min(ts) AS arrived_at, arg_min(value, ts) AS value FROM events "
    "GROUP BY 1 HAVING key NOT IN (SELECT s_suppkey * 5 FROM supplier)",
    "effective_source": "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'edited ' || o_orderpriority "
    "WHEN 'P' THEN '' ELSE 'machine ' || o_orderpriority END AS source FROM orders",
    "edit_history": "SELECT o_orderkey AS job_id, 'edits/history-' || strftime(o_orderdate, '%Y%m%d-%H%M%S-%g') || '.md' "
    "AS path, o_orderpriority AS source FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0",
    "edited_sources": "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 "
    "THEN 'by hand ' || o_orderstatus ELSE o_orderpriority END AS source FROM orders "
    "WHERE o_orderstatus <> 'P' OR (o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0)",
    "page_mismatches": "WITH a AS (SELECT o_custkey AS job_id, count(*) AS actual FROM orders GROUP BY 1), "
    "m AS (SELECT c_custkey AS job_id, CAST(c_custkey % 5 + 8 AS INTEGER) AS expected FROM customer) "
    "SELECT job_id, expected, coalesce(actual, 0) AS actual, CASE WHEN actual > 0 THEN 0 END AS first_index, "
    "CAST(actual - 1 AS INTEGER) AS last_index FROM m FULL JOIN a USING (job_id) "
    "WHERE coalesce(actual, 0) IS DISTINCT FROM expected",
    "cached_page_mismatches": f"{_JOBS}, c AS (SELECT job_id, page_index AS expected, CAST(CASE WHEN o_orderkey % 7 = 3 THEN page_index + 1 "
    "WHEN o_orderkey % 13 <> 4 THEN page_index END AS INTEGER) AS actual, printf('refinement-page-%03d.json', page_index + 1) AS path "
    "FROM job_pages WHERE o_orderkey % 11 <> 5) SELECT job_id, path, expected, actual FROM c WHERE expected IS DISTINCT FROM actual",
    "refinement_join": f"{_JOBS}, a AS (SELECT job_id, page_index, o_orderpriority AS markdown FROM job_pages), "
    "b AS (SELECT job_id, page_index + 1 AS page_index, o_orderstatus AS final_markdown FROM job_pages) "
    "SELECT job_id, CAST(page_index AS INTEGER) AS page_index, markdown, final_markdown, "
    "markdown IS NOT NULL AND final_markdown IS NOT NULL AS matched FROM a FULL JOIN b USING (job_id, page_index)",
    "assembled_markdown": f"SELECT job_id, 0 AS part, markdown FROM ({_ASSEMBLED.format('markdown')})",
    "assembled_in_parts": _ASSEMBLED.format("markdown"),
    "packed_sources": _ASSEMBLED.format("text"),
    "split_assembled": _CHAT_PAGES,
    "split_in_parts": _CHAT_PAGES,
    "merge_evidence": f"{_JOBS}, g AS (SELECT job_id, page_index, string_agg('### Crop ' || (i + 1) || '/' || n || "
    "', top to bottom' || chr(10) || 'text ' || i, chr(10) || chr(10) ORDER BY i) AS crops "
    "FROM (SELECT job_id, page_index, n, unnest(range(n)) AS i FROM crop) GROUP BY ALL) "
    "SELECT job_id, page_index, '## Complete-page overview' || chr(10) || o_orderpriority || chr(10) || chr(10) || "
    "'## High-resolution crops' || chr(10) || crops || chr(10) || chr(10) || '## Legacy OCR draft' || chr(10) || "
    "CASE WHEN o_orderstatus = 'F' THEN 'draft' ELSE '' END AS evidence FROM job_pages JOIN g USING (job_id, page_index)",
    "page_evidence": f"{_JOBS}, {_CROPS} SELECT job_id, page_index, crops, o_orderstatus AS final_markdown "
    "FROM job_pages JOIN g USING (job_id, page_index)",
    "job_records": f"{_RECORDS} SELECT job_id, 0 AS part, '[' || string_agg(page, ',' ORDER BY page_index) || ']' AS pages FROM p GROUP BY 1",
    "records_in_parts": f"{_RECORDS} SELECT job_id, '[' || string_agg(page, ',' ORDER BY page_index) || ']' AS pages FROM p GROUP BY 1",
    "packed_records": f"{_RECORDS} SELECT job_id, '{{\"job_id\":' || job_id || ',\"pages\":[' || string_agg(page, ',' ORDER BY page_index) "
    "|| ']}' AS text FROM p GROUP BY 1",
    "job_states": f"{_UPDATES} SELECT n.job_id, n.updated_at, stage, failure_message, stage_progress, stage_detail, "
    f"coalesce(u.uncertain_count, 0) AS uncertain_count, coalesce(stage_progress, CAST({_PROGRESS} AS DOUBLE)) "
    "AS displayed_progress FROM n JOIN u USING (job_id) WHERE n = 1",
    "latest_manifests": f"{_UPDATES} SELECT job_id, seq, updated_at, stage FROM n WHERE n = 1 ORDER BY updated_at DESC",
    "deadline_results": "SELECT s.user_id AS batch_id, s.event_id AS start_id, e.event_id FROM events s JOIN events e "
    "ON s.user_id = e.user_id AND s.event_type = 'purchase' AND e.event_type <> 'purchase' "
    "AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 210 SECOND",
    "deadline_leftovers": f"{_SHIPPED} SELECT batch_id, line FROM s WHERE NOT in_time",
    "deadline_progress": f"{_SHIPPED} SELECT batch_id, count(*) FILTER (in_time) AS completed, count(*) AS total FROM s GROUP BY 1",
}
