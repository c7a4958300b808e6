"""Files, sinks, statistics, archives and hooks over tables derived from the driver data."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from quire.operators import archive, hooks, stats
from quire.operators.ingest import clean_observations
from quire.runtime import ensure_checkpoint_dir
from quire.sources import readers, sinks

from . import relations as r


def scratch(spark, name: str) -> str:
    """A fresh folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _manifest_texts(spark, sf_dir):
    """A manifest per supplier; some broken, some of an older form."""
    rows = r.table(spark, sf_dir, "supplier")
    key, at = F.col("s_suppkey"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s_suppkey") * 3607 % 500_009)
    stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    page = lambda i: F.struct(
        F.concat_ws("-", key, F.lit(str(i))).alias("id"), F.lit(i).alias("index"),
        F.lit(f"pages/page-00{i + 1}.jpg").alias("sourcePath"), F.lit(0).alias("pixelWidth"), F.lit(0).alias("pixelHeight"),
    )
    body = F.to_json(
        F.struct(
            F.lit(1).alias("version"), key.cast("string").alias("id"), F.col("s_name").alias("title"),
            F.lit("baseOCR").alias("stage"), F.date_format(at, stamp).alias("createdAt"),
            F.date_format(at, stamp).alias("updatedAt"), F.array(page(0), page(1)).alias("pages"),
            (key % 4).cast("int").alias("uncertainCount"), F.lit("local").alias("rendererDescription"),
            F.when(key % 3 == 0, F.lit(0.5)).alias("stageProgress"), F.when(key % 3 == 0, F.lit("page 1")).alias("stageDetail"),
        )
    )
    pretty = F.replace(body, F.lit(","), F.lit(",\n"))
    text = F.when(key % 11 == 5, F.substring(pretty, 1, 60)).when(key % 11 == 6, F.lit('{"version":1}')).otherwise(pretty)
    return rows.select(key.alias("job_id"), text.alias("text"))


def _manifest_rows(found):
    return found.select(
        "id", "title", "stage", "updatedAt", F.size("pages").alias("page_count"),
        F.element_at("pages", 2)["sourcePath"].alias("second_page"), "uncertainCount", "failureMessage",
        "stageProgress", "stageDetail",
    )


def job_manifests(spark, sf_dir):
    """Manifest files, each in its own folder, written and read back; unreadable ones are skipped."""
    path = scratch(spark, "manifests")
    sinks.write_text_artifacts(_manifest_texts(spark, sf_dir), path)
    return _manifest_rows(readers.list_jobs(readers.read_manifests(spark, path, "*.txt")))


def packed_manifests(spark, sf_dir):
    """The same manifests in few packed files with an index instead of a folder each."""
    path = scratch(spark, "packed-manifests")
    sinks.write_packed(_manifest_texts(spark, sf_dir), path, ["job_id"], [], file_bytes=20_000)
    return _manifest_rows(readers.list_jobs(readers.parse_manifests(readers.read_packed(spark, path))))


def packed_artifacts(spark, sf_dir):
    """Document texts in packed files; of them, those of even documents are read by their keys."""
    path = scratch(spark, "packed-artifacts")
    rows = r.table(spark, sf_dir, "documents").select("doc_id", "text")
    sinks.write_packed(rows, path, ["doc_id"], [], file_bytes=200_000)
    return readers.read_packed(spark, path, rows.select("doc_id").filter("doc_id % 2 = 0")).select("doc_id", "text")


def _artifact_files(spark, sf_dir):
    """Artifacts of a job per document source; some names must not be exported."""
    key = F.col("doc_id").cast("string")
    name = (
        F.when(F.col("doc_id") % 17 == 3, F.concat(F.lit("ProviderKeys-"), key, F.lit(".plist")))
        .when(F.col("doc_id") % 17 == 5, F.concat(F.lit(".hidden/"), key))
        .when(F.col("doc_id") % 17 == 7, F.concat(F.lit("x/../"), key))
        .when(F.col("doc_id") % 17 == 9, F.concat(F.lit("a"), key, F.lit("/artifacts.zip")))
        .otherwise(F.concat(F.lit("./assets\\Page "), key, F.lit(".md")))
    )
    return r.table(spark, sf_dir, "documents").select(
        F.col("source").alias("job_id"), name.alias("path"), F.encode("text", "UTF-8").alias("content")
    )


def archive_manifest(spark, sf_dir):
    return archive.archive_manifest(_artifact_files(spark, sf_dir), ["artifacts.zip"], cap=60_000).drop("crc32")


def archive_checksums(spark, sf_dir):
    """Entries with their CRC-32."""
    return archive.archive_manifest(_artifact_files(spark, sf_dir), ["artifacts.zip"])


def oversized_jobs(spark, sf_dir):
    manifest = archive.archive_manifest(_artifact_files(spark, sf_dir), ["artifacts.zip"], cap=60_000)
    return archive.oversized_jobs(manifest)


def _bins(spark, sf_dir):
    rows = r.table(spark, sf_dir, "events")
    return rows.select("event_type", "user_id", F.least(F.floor("value"), F.lit(255)).cast("int").alias("bin"))


def value_histogram(spark, sf_dir):
    return stats.histogram(_bins(spark, sf_dir), ["event_type"])


def otsu_thresholds(spark, sf_dir):
    return stats.otsu_threshold(stats.histogram(_bins(spark, sf_dir), ["user_id"]), ["user_id"])


def binary_files(spark, sf_dir):
    """Page texts written as artifacts and read back as binary files."""
    path = scratch(spark, "artifacts")
    rows = r.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("job_id"), F.col("s_name").alias("text"))
    sinks.write_text_artifacts(rows, path)
    files = readers.read_binary(spark, path, "*.txt")
    return files.select(
        F.regexp_extract("path", r"job_id=(\d+)/", 1).cast("long").alias("job_id"), "length",
        F.decode("content", "UTF-8").alias("text"),
    )


def file_listing(spark, sf_dir):
    """Suppliers whose artifact exists on disk, found without reading contents."""
    path = scratch(spark, "listing")
    rows = r.table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("job_id"), F.col("s_name").alias("text")
    )
    sinks.write_text_artifacts(rows, path)
    present = readers.list_files(spark, path, "*.txt").select(
        F.regexp_extract("path", r"job_id=(\d+)/", 1).cast("long").alias("s_suppkey")
    )
    return r.table(spark, sf_dir, "supplier").join(present, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


def write_once_sink(spark, sf_dir):
    """Two overlapping batches saved; the first value of a key stays."""
    path = scratch(spark, "once")
    rows = r.events(spark, sf_dir).select(
        (F.col("event_id") % 2500).alias("key"), F.col("ts").alias("arrived_at"), "event_id"
    )
    sinks.append_once(rows.filter("event_id < 2000"), path, ["key"])
    sinks.append_once(rows, path, ["key"])
    sinks.append_once(rows, path, ["key"])
    return sinks.read_once(spark, path).select("key", "event_id")


def replace_sink(spark, sf_dir):
    """One partition replaced, the others kept."""
    path = scratch(spark, "replace")
    rows = r.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sinks.replace(rows, path, ["o_orderstatus"])
    sinks.replace(rows.filter("o_orderstatus = 'F'").withColumn("o_custkey", -F.col("o_custkey")), path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus")


def nested_json_sink(spark, sf_dir):
    """Job records written as JSON lines and read back as text members."""
    path = scratch(spark, "records")
    rows = r.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("createdAt"),
        F.array(F.struct(F.lit(0).alias("pageIndex"), F.col("o_orderpriority").alias("finalMarkdown"))).alias("pages"),
    )
    sinks.write_nested_json(rows, path)
    text = spark.read.text(path).select(F.col("value").alias("line"))
    return text.select(
        F.get_json_object("line", "$.job_id").cast("long").alias("job_id"),
        F.get_json_object("line", "$.createdAt").alias("created_at"),
        F.get_json_object("line", "$.pages[0].finalMarkdown").alias("markdown"),
    )


def edit_history_sink(spark, sf_dir):
    """History rows appended by a rebuild, read back from disk."""
    history, current = scratch(spark, "history"), scratch(spark, "sources")
    base = r.table(spark, sf_dir, "orders")
    sources = base.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("source"))
    edits = base.filter("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("job_id"), F.lit(" edited ").alias("source"),
        F.col("o_orderdate").cast("timestamp").alias("edited_at"),
    )
    sinks.apply_edits(sources, edits, history, current)
    kept = spark.read.parquet(history).select("job_id", F.lit("history").alias("place"), "source")
    return kept.unionByName(spark.read.parquet(current).select("job_id", F.lit("current").alias("place"), "source"))


def line_recognizer():
    """Stand-in recogniser: each text line is a block, placed top to bottom in turns of three."""

    def recognize(content: bytes) -> list[dict]:
        return [
            {
                "candidates": [{"text": line, "confidence": 0.9}],
                "x": (i % 3) * 0.3, "y": 1.0 - (i // 3) * 0.25, "w": 0.2, "h": 0.125,
            }
            for i, line in enumerate(content.decode("utf-8").split("\n"))
        ]

    return recognize


def _images(spark, sf_dir):
    return r.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))


def recognized_blocks(spark, sf_dir):
    found = hooks.recognize(_images(spark, sf_dir), line_recognizer(), "doc_id")
    return clean_observations(found, ["doc_id"]).select("doc_id", "reading_order", "text", "x", "y")


def recognized_pages(spark, sf_dir):
    return hooks.recognize_pages(_images(spark, sf_dir), line_recognizer(), "doc_id").select(
        "doc_id", "part", "page_text", "block_count"
    )


def custom_order(spark, sf_dir):
    """Blocks ordered by a user's key: right to left by their right edge."""
    rows = r.blocks(spark, sf_dir)
    ordered = hooks.order_by_key(rows, ["page_id"], r.ORDINAL, lambda batch: -(batch["x"] + batch["w"]))
    return ordered.select("page_id", *r.ORDINAL, "reading_order")


def custom_page_order(spark, sf_dir):
    """Blocks ordered by a user function over a whole page: widest first."""
    rows = r.blocks(spark, sf_dir)
    ordered = hooks.order_with(
        rows, ["page_id"], r.ORDINAL, lambda page: np.argsort(-page["w"].to_numpy(), kind="stable")
    )
    return ordered.select("page_id", *r.ORDINAL, "reading_order")


QUERIES = {
    f.__name__: f
    for f in (
        job_manifests, packed_manifests, packed_artifacts, archive_manifest, archive_checksums, oversized_jobs, value_histogram, otsu_thresholds, binary_files,
        file_listing, write_once_sink, replace_sink, nested_json_sink, edit_history_sink, recognized_blocks,
        recognized_pages, custom_order, custom_page_order,
    )
}

_FILES = r"""
WITH f AS (SELECT source AS job_id, text, CASE doc_id % 17 WHEN 3 THEN 'ProviderKeys-' || doc_id || '.plist'
    WHEN 5 THEN '.hidden/' || doc_id WHEN 7 THEN 'x/../' || doc_id WHEN 9 THEN 'a' || doc_id || '/artifacts.zip'
    ELSE './assets\Page ' || doc_id || '.md' END AS path, doc_id FROM documents),
k AS (SELECT job_id, doc_id, 'assets/Page ' || doc_id || '.md' AS archive_path, CAST(octet_length(encode(text)) AS BIGINT) AS size
      FROM f WHERE doc_id % 17 NOT IN (3, 5, 7, 9)),
m AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS entry,
             sum(size + 76 + 2 * length(archive_path)) OVER w AS running FROM k
      WINDOW w AS (PARTITION BY job_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING))"""

_OTSU = """
WITH b AS (SELECT user_id, CAST(least(floor(value), 255) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, sum(CAST(bin * n AS DOUBLE)) OVER (PARTITION BY user_id) AS s,
             sum(n) OVER u AS bw, sum(CAST(bin * n AS DOUBLE)) OVER u AS bs FROM b
      WINDOW u AS (PARTITION BY user_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN total > bw THEN CAST(bw AS DOUBLE) * CAST(total - bw AS DOUBLE)
                     * pow(bs / bw - (s - bs) / (total - bw), 2) END AS variance FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY variance DESC NULLS LAST, bin) AS rn FROM v)
SELECT user_id, CAST(total AS BIGINT) AS total,
       CAST(least(235, greatest(95, CASE WHEN variance IS NULL THEN 180 ELSE bin END + 8)) AS INTEGER) AS threshold
FROM r WHERE rn = 1"""

_LINES = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS i, unnest(ls) AS raw FROM l),
c AS (SELECT doc_id, i, regexp_replace(raw, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g') AS text FROM u)"""

_MANIFESTS = (
    "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS title, 'baseOCR' AS stage, "
    "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(s_suppkey * 3607 % 500009) AS \"updatedAt\", 2 AS page_count, "
    "'pages/page-002.jpg' AS second_page, CAST(s_suppkey % 4 AS INTEGER) AS \"uncertainCount\", "
    "CAST(NULL AS VARCHAR) AS \"failureMessage\", CASE WHEN s_suppkey % 3 = 0 THEN CAST(0.5 AS DOUBLE) END AS \"stageProgress\", "
    "CASE WHEN s_suppkey % 3 = 0 THEN 'page 1' END AS \"stageDetail\" FROM supplier WHERE s_suppkey % 11 NOT IN (5, 6)"
)

ORACLE = {
    "job_manifests": _MANIFESTS,
    "packed_manifests": _MANIFESTS,
    "packed_artifacts": "SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0",
    "archive_manifest": f"{_FILES} SELECT job_id, archive_path, size, entry, CAST(running AS BIGINT) AS running_bytes, "
    "running > 60000 AS over_cap FROM m",
    "archive_checksums": f"""{_FILES},
tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0],
          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(16) t(i))),
b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents),
n AS (SELECT doc_id, flatten(list_transform(b,
        lambda p: [strpos('0123456789ABCDEF', p[2]) - 1, strpos('0123456789ABCDEF', p[1]) - 1])) AS n FROM b),
sums AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, n),
           lambda c, d: xor(c >> 4, tab[(xor(c, d) & 15) + 1])), 4294967295) AS crc32 FROM n, tab)
SELECT job_id, archive_path, size, CAST(crc32 AS BIGINT) AS crc32, entry, CAST(running AS BIGINT) AS running_bytes,
       running > 262144000 AS over_cap FROM m JOIN sums USING (doc_id)""",
    "oversized_jobs": f"{_FILES} SELECT job_id, CAST(max(running) AS BIGINT) AS archive_bytes, max(running) > 60000 "
    "AS too_large FROM m GROUP BY 1",
    "value_histogram": "SELECT event_type, CAST(least(floor(value), 255) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY ALL",
    "otsu_thresholds": _OTSU,
    "binary_files": "SELECT s_suppkey AS job_id, CAST(length(s_name) + 1 AS BIGINT) AS length, s_name || chr(10) AS text "
    "FROM supplier",
    "file_listing": "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0",
    "write_once_sink": "WITH a AS (SELECT event_id % 2500 AS key, event_id, ts FROM events) "
    "SELECT key, coalesce(arg_min(event_id, ts) FILTER (event_id < 2000), arg_min(event_id, ts)) AS event_id FROM a GROUP BY 1",
    "replace_sink": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_custkey ELSE o_custkey END AS o_custkey, "
    "o_orderstatus FROM orders",
    "nested_json_sink": "SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at, "
    "o_orderpriority AS markdown FROM orders",
    "edit_history_sink": "SELECT o_orderkey AS job_id, 'history' AS place, o_orderpriority AS source FROM orders "
    "WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'current', CASE WHEN o_orderstatus = 'O' THEN 'edited' "
    "ELSE o_orderpriority END FROM orders",
    "recognized_blocks": f"{_LINES} SELECT doc_id, i AS reading_order, text, (i % 3) * CAST(0.3 AS DOUBLE) AS x, "
    "CAST(1 AS DOUBLE) - (i // 3) * CAST(0.25 AS DOUBLE) AS y FROM c WHERE text <> ''",
    # Rows of three stay on one visual line; the middle block spans the gutter, so no page splits
    # unless only outer blocks are left. Lines never overlap vertically.
    "recognized_pages": f"""{_LINES},
k AS (SELECT doc_id, i, text, CASE i % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'l' ELSE 'r' END AS side FROM c WHERE text <> ''),
s AS (SELECT doc_id, count(*) FILTER (side = 'l') >= 2 AND count(*) FILTER (side = 'r') >= 2 AS two, count(*) AS n FROM k GROUP BY 1),
o AS (SELECT k.*, n, CASE WHEN two AND side = 'r' THEN 1 ELSE 0 END AS col FROM k JOIN s USING (doc_id)),
g AS (SELECT doc_id, n, col, i // 3 AS row, string_agg(text, ' ' ORDER BY i) AS line FROM o GROUP BY ALL)
SELECT doc_id, 0 AS part, string_agg(line, chr(10) ORDER BY col, row) AS page_text, any_value(n) AS block_count
FROM g GROUP BY doc_id""",
    "custom_order": f"WITH {r.SQL_BLOCKS} SELECT page_id, {', '.join(r.ORDINAL)}, CAST(row_number() OVER (PARTITION BY page_id "
    f"ORDER BY -(x + w), {', '.join(r.ORDINAL)}) - 1 AS INTEGER) AS reading_order FROM blocks",
    "custom_page_order": f"WITH {r.SQL_BLOCKS} SELECT page_id, {', '.join(r.ORDINAL)}, CAST(row_number() OVER (PARTITION BY page_id "
    f"ORDER BY w DESC, {', '.join(r.ORDINAL)}) - 1 AS INTEGER) AS reading_order FROM blocks",
}
