"""Library listing, traversal, deletion, replacement, record changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import labels
from quire.operators import layout, library, parts

from . import relations as r



def _doomed(documents):
    """Customers in debt are deleted."""
    return documents.filter("processing_status = 'failed'").select("document_id")


def library_listing(spark, sf_dir):
    return library.newest_first(r.library_documents(spark, sf_dir)).select(
        "document_id", "title",
        labels.decode_type(F.col("document_type")).alias("document_type"),
        labels.decode_status(F.col("processing_status")).alias("processing_status"), "created_at",
    )


def library_point_lookup(spark, sf_dir):
    return library.find_document(r.library_documents(spark, sf_dir), 42).select("document_id", "title")


def library_flattened(spark, sf_dir):
    documents = r.library_documents(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    return library.flatten_library(documents, r.library_pages(spark, sf_dir))


def _nested_text(nested, *more):
    """Arrays of pages rendered to text for the comparison."""
    pages = F.transform(F.col("pages"), lambda p: F.concat_ws("=", p["page_number"].cast("string"), p["text"]))
    return nested.select("document_id", *more, F.size("pages").alias("n_pages"), F.array_join(pages, "|").alias("pages_text"))


def library_nested(spark, sf_dir):
    """Nested export."""
    flat = library.flatten_library(r.chat_documents(spark, sf_dir), r.chat_pages(spark, sf_dir))
    return _nested_text(library.nest_pages(flat), "part")


def nested_in_parts(spark, sf_dir):
    """Parts of two pages, put together."""
    flat = library.flatten_library(r.chat_documents(spark, sf_dir), r.chat_pages(spark, sf_dir))
    keys = ["document_id", "title", "document_type", "updated_at"]
    return _nested_text(parts.whole_array(library.nest_pages(flat, part_pages=2), keys, "pages"))


def library_count(spark, sf_dir):
    documents = r.library_documents(spark, sf_dir)
    return documents.agg(F.count("*").alias("document_count"), (F.count("*") == 0).alias("library_is_empty"))


def blocks_per_page(spark, sf_dir):
    return r.blocks(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("block_count"))


def first_pages(spark, sf_dir):
    return library.first_pages(r.library_pages(spark, sf_dir)).select("document_id", "page_id", "page_number")


def document_previews(spark, sf_dir):
    return library.document_previews(r.chat_pages(spark, sf_dir))


def listing_rows(spark, sf_dir):
    return library.listing_rows(r.library_documents(spark, sf_dir), r.library_pages(spark, sf_dir))


def library_traversal(spark, sf_dir):
    joined = library.traverse(
        r.library_documents(spark, sf_dir).select("document_id", "title"),
        r.library_pages(spark, sf_dir).select("document_id", "page_id", "page_number"),
        r.blocks(spark, sf_dir).select("page_id", "x", "y"),
    )
    return joined.groupBy("document_id", "title").agg(
        F.count("*").alias("block_count"), F.max("x").alias("max_x"), F.min("y").alias("min_y"),
        F.max("page_number").alias("last_page"),
    )


def cascade_delete(spark, sf_dir):
    """Every remaining row by its key."""
    documents, pages = r.library_documents(spark, sf_dir), r.library_pages(spark, sf_dir)
    left = library.cascade_delete(documents, pages, r.blocks(spark, sf_dir), _doomed(documents))
    keys = [["document_id"], ["page_id", "document_id"], ["page_id", *r.ORDINAL[:-1], "text"]]
    rows = [
        rows.select(F.lit(name).alias("relation"), F.concat_ws("-", *key).alias("key"))
        for name, rows, key in zip(["documents", "pages", "blocks"], left, keys, strict=True)
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def files_to_remove(spark, sf_dir):
    documents, pages = r.library_documents(spark, sf_dir), r.library_pages(spark, sf_dir)
    existing = (
        pages.filter("image_file_name NOT LIKE '%7.jpg'")
        .select(F.explode(F.array(F.lit("Pages"), F.lit("Sources"))).alias("directory"),
                F.col("image_file_name").alias("file_name"))
        .unionByName(documents.select(F.lit("Sources").alias("directory"), F.col("local_file_name").alias("file_name")))
    )
    return library.files_to_remove(documents, pages, _doomed(documents), existing)


def delete_positions(spark, sf_dir):
    """Positions to delete are the supplier keys, some of them beyond the listing."""
    positions = r.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("position"))
    return library.delete_positions(r.library_documents(spark, sf_dir), positions).select("document_id")


def pages_in_order(spark, sf_dir):
    """Dense position of each page in its document, by page number."""
    return library.renumber(r.library_pages(spark, sf_dir), ["document_id"], ["page_number"], "position").select(
        "document_id", "page_id", "position"
    )


def replace_page_blocks(spark, sf_dir):
    """Pages of open orders are re-recognised with one block each."""
    blocks = r.blocks(spark, sf_dir).select("page_id", "text", "x", "y")
    touched = r.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("page_id")
    )
    fresh = touched.select("page_id", F.lit("fresh result").alias("text"), F.lit(0.1).alias("x"), F.lit(0.2).alias("y"))
    return library.replace_children(blocks, fresh, "page_id", touched)


def replace_document_pages(spark, sf_dir):
    """PDF documents get one new page with one block."""
    documents = r.library_documents(spark, sf_dir)
    touched = documents.filter("document_type = 'pdf'").select("document_id")
    new_pages = touched.select("document_id", (-F.col("document_id")).alias("page_id"), F.lit(1).alias("page_number"))
    new_blocks = new_pages.select("page_id", F.lit("fresh").alias("text"))
    pages, blocks = library.replace_document_pages(
        r.library_pages(spark, sf_dir).select("document_id", "page_id", "page_number"),
        r.blocks(spark, sf_dir).select("page_id", "text"), new_pages, new_blocks, touched,
    )
    counts = blocks.groupBy("page_id").agg(F.count("*").alias("block_count"))
    return pages.join(counts, "page_id", "left").select("document_id", "page_id", "page_number", "block_count")


def rename_documents(spark, sf_dir):
    """New titles from part names; some clean to nothing and change nothing."""
    documents = r.library_documents(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    changes = r.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("document_id"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("  New/"), "p_name", F.lit("\t: "), "p_brand"))
        .otherwise(" / ").alias("new_title"),
        F.timestamp_seconds(F.lit(1_800_000_000) + F.col("p_size")).alias("changed_at"),
    )
    return library.rename(documents, changes).select("document_id", "title", "updated_at")


def edit_page_text(spark, sf_dir):
    """Each event edits one page of the conversations; the last edit of a page wins."""
    edits = r.events(spark, sf_dir).select(
        F.concat_ws("-", "user_id", (F.col("event_id") % 5)).alias("page_id"),
        F.concat_ws(" ", F.lit("corrected by hand"), "event_id").alias("new_text"),
        F.col("ts").alias("changed_at"),
    )
    documents, pages = library.edit_text(r.chat_documents(spark, sf_dir), r.chat_pages(spark, sf_dir), edits)
    return pages.join(documents.select("document_id", "updated_at"), "document_id").select(
        "page_id", "text", "updated_at"
    )


def finish_processing(spark, sf_dir):
    documents = r.library_documents(spark, sf_dir).withColumn("processing_progress", F.lit(0.25))
    outcomes = r.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("document_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "cancelled").when(F.col("c_acctbal") < 1000, "failed")
        .when(F.col("c_acctbal") < 6000, "completed").alias("outcome"),
        F.concat(F.lit("bad "), "c_name").alias("error_text"),
    )
    return library.finish_processing(documents, outcomes).select(
        "document_id", "processing_status", "processing_progress", "processing_error"
    )


def error_messages(spark, sf_dir):
    """Every event is a failure whose kind comes from its key; the detail from its type."""
    kinds = list(labels.ERRORS)
    failures = r.events(spark, sf_dir).select(
        "event_id",
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % len(kinds) + 1).cast("int")).alias("kind"),
        F.col("event_type").alias("detail"),
    )
    return labels.describe_errors(failures).select("event_id", "message", "recovery", "stored_text")


def enum_labels(spark, sf_dir):
    rows = r.library_documents(spark, sf_dir)
    kind, status = labels.decode_type(F.col("document_type")), labels.decode_status(F.col("processing_status"))
    return rows.select(
        "document_id", kind.alias("document_type"), status.alias("status"),
        labels.document_type_name(kind).alias("type_name"), labels.status_name(status).alias("status_name"),
        labels.file_extension(kind).alias("extension"), labels.is_image_based(kind).alias("image_based"),
        labels.image_directory(kind).alias("directory"),
    )


def stored_block_order(spark, sf_dir):
    """Blocks of a page in stored order, made dense again after gaps."""
    stored = r.blocks(spark, sf_dir).withColumn("reading_order", F.col("l_linenumber") * 10)
    return layout.reindex(stored, ["page_id"], r.ORDINAL[1:]).select("page_id", *r.ORDINAL, "reading_order")


def _sql_case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _sql_errors() -> str:
    rows = ", ".join(
        "('{}', '{}', {})".format(
            kind,
            message.replace("{app}", "the library").replace("'", "''"),
            "NULL" if recovery is None else "'" + recovery.replace("'", "''") + "'",
        )
        for kind, (message, recovery) in labels.ERRORS.items()
    )
    names = ", ".join(f"'{kind}'" for kind in labels.ERRORS)
    return f"""
WITH tax(kind, message, recovery) AS (VALUES {rows}),
f AS (SELECT event_id, event_type, [{names}][CAST(event_id % {len(labels.ERRORS)} + 1 AS INTEGER)] AS kind FROM events),
m AS (SELECT event_id, replace(message, '%s', event_type) AS message, recovery FROM f JOIN tax USING (kind))
SELECT event_id, message, recovery, concat_ws(' ', message, recovery) AS stored_text FROM m"""


_LIB = f"WITH {r.SQL_LIBRARY}"
_CHAT = f"WITH {r.SQL_CHAT}"
_TYPE = "CASE WHEN document_type IN ('camera','photo','pdf') THEN document_type ELSE 'photo' END"
_STATUS = (
    "CASE WHEN processing_status IN ('pending','processing','completed','failed') "
    "THEN processing_status ELSE 'pending' END"
)
_PREVIEW = r"""trim(replace(string_agg(text, ' ' ORDER BY page_number), chr(10), ' '))"""
_DOOM = "doomed AS (SELECT document_id FROM library_documents WHERE processing_status = 'failed')"
_ORDINALS = ", ".join(r.ORDINAL)

QUERIES = {
    f.__name__: f
    for f in (
        library_listing, library_point_lookup, library_flattened, library_nested, nested_in_parts, library_count, blocks_per_page,
        first_pages, document_previews, listing_rows, library_traversal, cascade_delete, files_to_remove,
        delete_positions, pages_in_order, replace_page_blocks, replace_document_pages, rename_documents,
        edit_page_text, finish_processing, error_messages, enum_labels, stored_block_order,
    )
}

_NESTED = (
    f"{_CHAT} SELECT document_id, CAST(count(*) AS INTEGER) AS n_pages, "
    "string_agg(page_number || '=' || text, '|' ORDER BY page_number) AS pages_text FROM chat_pages GROUP BY 1"
)

ORACLE = {
    "library_listing": f"{_LIB} SELECT document_id, title, {_TYPE} AS document_type, {_STATUS} AS processing_status, "
    "created_at FROM library_documents ORDER BY created_at DESC, document_id",
    "library_point_lookup": f"{_LIB} SELECT document_id, title FROM library_documents WHERE document_id = 42",
    "library_flattened": f"{_LIB} SELECT d.document_id, d.title, d.document_type, d.created_at AS updated_at, "
    "p.page_id, p.page_number, p.text FROM library_documents d LEFT JOIN library_pages p USING (document_id)",
    "library_nested": f"SELECT *, 0 AS part FROM ({_NESTED})",
    "nested_in_parts": _NESTED,
    "library_count": "SELECT count(*) AS document_count, count(*) = 0 AS library_is_empty FROM customer",
    "blocks_per_page": "SELECT l_orderkey AS page_id, count(*) AS block_count FROM lineitem GROUP BY 1",
    "first_pages": f"{_LIB} SELECT document_id, arg_min(page_id, page_number) AS page_id, "
    "min(page_number) AS page_number FROM library_pages GROUP BY 1",
    "document_previews": f"{_CHAT}, j AS (SELECT document_id, {_PREVIEW} AS t FROM chat_pages GROUP BY 1) "
    "SELECT document_id, CASE WHEN length(t) > 120 THEN left(t, 120) || '…' ELSE t END AS preview FROM j",
    "listing_rows": f"{_LIB}, j AS (SELECT document_id, count(*) AS n, {_PREVIEW} AS t FROM library_pages GROUP BY 1), "
    "v AS (SELECT document_id, n, CASE WHEN length(t) > 120 THEN left(t, 120) || '…' ELSE t END AS preview FROM j) "
    "SELECT document_id, title, CASE WHEN n = 1 THEN '1 page' ELSE coalesce(n, 0) || ' pages' END AS page_label, "
    "CASE WHEN processing_status = 'failed' AND processing_error IS NOT NULL THEN processing_error "
    "WHEN coalesce(preview, '') = '' THEN CASE WHEN processing_status = 'completed' THEN 'No text recognized.' "
    "ELSE 'Waiting for text recognition…' END ELSE preview END AS detail_line "
    "FROM library_documents LEFT JOIN v USING (document_id)",
    "library_traversal": f"{_LIB}, {r.SQL_BLOCKS} SELECT document_id, title, count(*) AS block_count, max(x) AS max_x, "
    "min(y) AS min_y, max(page_number) AS last_page FROM library_documents JOIN library_pages USING (document_id) "
    "JOIN blocks USING (page_id) GROUP BY document_id, title",
    "cascade_delete": f"{_LIB}, {_DOOM}, {r.SQL_BLOCKS}, gone AS (SELECT page_id FROM library_pages WHERE document_id IN (FROM doomed)) "
    "SELECT 'documents' AS relation, concat_ws('-', document_id) AS key FROM library_documents "
    "WHERE document_id NOT IN (FROM doomed) UNION ALL "
    "SELECT 'pages', concat_ws('-', page_id, document_id) FROM library_pages WHERE document_id NOT IN (FROM doomed) UNION ALL "
    "SELECT 'blocks', concat_ws('-', page_id, l_linenumber, l_partkey, l_suppkey, text) FROM blocks "
    "WHERE page_id NOT IN (FROM gone)",
    "files_to_remove": f"{_LIB}, {_DOOM}, "
    "disk AS (SELECT unnest(['Pages','Sources']) AS directory, image_file_name AS file_name FROM library_pages "
    "WHERE image_file_name NOT LIKE '%7.jpg' UNION SELECT 'Sources', local_file_name FROM library_documents), "
    "want AS (SELECT 'Sources' AS directory, local_file_name AS file_name FROM library_documents "
    "WHERE document_id IN (FROM doomed) UNION SELECT CASE WHEN document_type = 'pdf' THEN 'Pages' ELSE 'Sources' END, "
    "image_file_name FROM library_pages JOIN library_documents USING (document_id) "
    "WHERE document_id IN (FROM doomed)) SELECT directory, file_name FROM want INTERSECT SELECT * FROM disk",
    "delete_positions": f"{_LIB}, o AS (SELECT document_id, row_number() OVER (ORDER BY created_at DESC, document_id) - 1 "
    "AS position FROM library_documents) SELECT document_id FROM o "
    "WHERE position NOT IN (SELECT s_suppkey * 20 FROM supplier)",
    "pages_in_order": f"{_LIB} SELECT document_id, page_id, CAST(row_number() OVER (PARTITION BY document_id "
    "ORDER BY page_number) - 1 AS INTEGER) AS position FROM library_pages",
    "replace_page_blocks": f"WITH {r.SQL_BLOCKS}, o AS (SELECT o_orderkey AS page_id FROM orders "
    "WHERE o_orderstatus = 'O') SELECT page_id, text, x, y FROM blocks WHERE page_id NOT IN (FROM o) UNION ALL "
    "SELECT page_id, 'fresh result', CAST(0.1 AS DOUBLE), CAST(0.2 AS DOUBLE) FROM o",
    "replace_document_pages": f"{_LIB}, {r.SQL_BLOCKS}, t AS (SELECT document_id FROM library_documents "
    "WHERE document_type = 'pdf'), p AS (SELECT document_id, page_id, page_number FROM library_pages "
    "WHERE document_id NOT IN (FROM t) UNION ALL SELECT document_id, -document_id, 1 FROM t), "
    "b AS (SELECT page_id FROM blocks WHERE page_id NOT IN (SELECT page_id FROM library_pages "
    "WHERE document_id IN (FROM t)) UNION ALL SELECT -document_id FROM t), "
    "c AS (SELECT page_id, count(*) AS block_count FROM b GROUP BY 1) "
    "SELECT document_id, page_id, page_number, block_count FROM p LEFT JOIN c USING (page_id)",
    "rename_documents": f"{_LIB}, c AS (SELECT p_partkey AS document_id, "
    + r.SQL_TITLE.format("CASE WHEN p_size > 25 THEN '  New/' || p_name || chr(9) || ': ' || p_brand ELSE ' / ' END")
    + " AS t, TIMESTAMP '2027-01-15 08:00:00' + to_seconds(p_size) AS changed FROM part) "
    "SELECT d.document_id, CASE WHEN t <> '' THEN t ELSE title END AS title, "
    "CASE WHEN t <> '' THEN changed ELSE created_at END AS updated_at FROM library_documents d LEFT JOIN c USING (document_id)",
    "edit_page_text": f"{_CHAT}, e AS (SELECT user_id || '-' || (event_id % 5) AS page_id, "
    "'corrected by hand ' || event_id AS new_text, ts FROM events), "
    "l AS (SELECT page_id, arg_max(new_text, ts) AS new_text, max(ts) AS ts FROM e GROUP BY 1), "
    "p AS (SELECT page_id, document_id, coalesce(new_text, text) AS text, ts FROM chat_pages LEFT JOIN l USING (page_id)), "
    "u AS (SELECT document_id, max(ts) AS ts FROM p GROUP BY 1) "
    "SELECT page_id, p.text, greatest(u.ts, d.updated_at) AS updated_at "
    "FROM p JOIN chat_documents d USING (document_id) JOIN u USING (document_id)",
    "finish_processing": f"{_LIB}, o AS (SELECT c_custkey AS document_id, CASE WHEN c_mktsegment = 'BUILDING' "
    "THEN 'cancelled' WHEN c_acctbal < 1000 THEN 'failed' WHEN c_acctbal < 6000 THEN 'completed' ELSE '' END AS outcome, "
    "'bad ' || c_name AS error_text FROM customer) SELECT document_id, CASE WHEN outcome <> '' THEN outcome "
    "ELSE processing_status END AS processing_status, CAST(CASE outcome WHEN 'completed' THEN 1.0 WHEN 'failed' THEN 0.0 "
    "ELSE 0.25 END AS DOUBLE) AS processing_progress, CASE outcome WHEN 'completed' THEN NULL WHEN 'failed' "
    "THEN error_text ELSE processing_error END AS processing_error "
    "FROM library_documents JOIN o USING (document_id) WHERE outcome <> 'cancelled'",
    "error_messages": _sql_errors(),
    "enum_labels": f"{_LIB}, e AS (SELECT document_id, {_TYPE} AS document_type, {_STATUS} AS status "
    f"FROM library_documents) SELECT *, {_sql_case('document_type', labels.DOCUMENT_TYPES)} AS type_name, "
    f"{_sql_case('status', labels.PROCESSING_STATUSES)} AS status_name, "
    "CASE WHEN document_type = 'pdf' THEN 'pdf' ELSE 'jpg' END AS extension, document_type <> 'pdf' AS image_based, "
    "CASE WHEN document_type = 'pdf' THEN 'Pages' ELSE 'Sources' END AS directory FROM e",
    "stored_block_order": f"WITH {r.SQL_BLOCKS} SELECT page_id, {_ORDINALS}, CAST(row_number() OVER "
    f"(PARTITION BY page_id ORDER BY {_ORDINALS}) - 1 AS INTEGER) AS reading_order FROM blocks",
}
