"""Search: terms, matching, counting, ranking, snippets, highlights, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import batch_search, search

from . import relations as r
from .file_queries import scratch

FRENCH_QUERY = "Étion  QUE"
TITLE_QUERY = "the thor"
SHARED_WORD = "thanedble"


def marks(column):
    """Highlight ranges as text, so both engines compare the same scalar."""
    return F.array_join(
        F.transform(column, lambda h: F.concat_ws("-", h["start"].cast("string"), h["end"].cast("string"))), ","
    )


def _results(found):
    return found.select(
        "result_id", "document_id", "title", "document_type", "page_id", "page_number", "snippet",
        marks(F.col("highlights")).alias("highlights"), "match_kind", "title_rank",
        F.col("body_match_count").cast("long").alias("body_match_count"), "updated_at",
        F.col("position").cast("long").alias("position"),
    )


def search_top20(spark, sf_dir):
    return _results(
        search.search(r.chat_documents(spark, sf_dir), r.chat_pages(spark, sf_dir), FRENCH_QUERY, limit=20, ranked=True)
    )


def search_flagship(spark, sf_dir):
    """Top 20 pages and titles for two common words."""
    return _results(
        search.search(r.chat_documents(spark, sf_dir), r.chat_pages(spark, sf_dir), "The OF", limit=20, ranked=True)
    )


def search_all_pages(spark, sf_dir):
    return _results(search.search(r.corpus_documents(spark, sf_dir), r.corpus_pages(spark, sf_dir), TITLE_QUERY, ranked=True))


def search_title_hits(spark, sf_dir):
    """The words stand in titles and on no page; some of the documents have no pages."""
    documents = r.library_documents(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    return _results(search.search(documents, r.library_pages(spark, sf_dir), "customer building", ranked=True))


def search_blank_query(spark, sf_dir):
    return _results(search.search(r.chat_documents(spark, sf_dir), r.chat_pages(spark, sf_dir), " \n ", ranked=True))


def sql_search(documents: str, pages: str, terms: list[str], whole: str, limit: int | None = None) -> str:
    """The search semantics as plain SQL over two relations, for two terms."""
    a, b = terms
    fold, flat = r.SQL_FOLD, r.SQL_FLAT
    count = " + ".join(
        f"CAST((length(f) - length(replace(f, '{x}', ''))) / {len(x)} AS BIGINT)" for x in terms
    )
    spans = ", ".join(
        f"list_transform(list_filter(range(1, length(sf) + 1), lambda i: substr(sf, i, {len(x)}) = '{x}'), "
        f"lambda i: {{'s': i - 1, 'o': {o}, 'e': i - 1 + {len(x)}}})"
        for o, x in enumerate(terms)
    )
    tail = (
        f"ORDER BY title_rank, body_match_count DESC, updated_at DESC, CAST(document_id AS VARCHAR), page_number "
        f"LIMIT {limit}"
        if limit
        else ""
    )
    return f"""
, f AS (SELECT *, {fold.format('text')} AS f FROM {pages}),
p AS (SELECT *, contains(f, '{a}') AND contains(f, '{b}') AS hit, {count} AS cnt,
             {flat.format('text')} AS flat FROM f),
s AS (SELECT document_id, sum(cnt) AS body_match_count, bool_or(hit) AS any_hit, min(page_number) AS first_page
      FROM p GROUP BY 1),
d AS (SELECT *, CASE WHEN {fold.format('trim(title)')} = '{whole}' THEN 0
                     WHEN contains({fold.format('title')}, '{a}') AND contains({fold.format('title')}, '{b}') THEN 1
                     ELSE 2 END AS title_rank FROM {documents}),
j AS (SELECT d.*, coalesce(s.body_match_count, 0) AS body_match_count, coalesce(any_hit, false) AS any_hit, first_page
      FROM d LEFT JOIN s USING (document_id)),
m AS (SELECT j.*, p.page_id, p.page_number, p.flat, true AS body FROM j JOIN p USING (document_id) WHERE p.hit
      UNION ALL
      SELECT j.*, p.page_id, p.page_number, coalesce(p.flat, ''), false FROM j
      LEFT JOIN p ON p.document_id = j.document_id AND p.page_number = j.first_page
      WHERE NOT any_hit AND title_rank < 2),
g AS (SELECT *, {fold.format('flat')} AS ff,
             nullif(strpos({fold.format('flat')}, '{a}'), 0) AS pa, nullif(strpos({fold.format('flat')}, '{b}'), 0) AS pb
      FROM m),
h AS (SELECT *, CASE WHEN pb IS NULL OR pa <= pb THEN pa ELSE pb END AS pos,
             CASE WHEN pb IS NULL OR pa <= pb THEN {len(a)} ELSE {len(b)} END AS len FROM g),
k AS (SELECT *, greatest(pos - 1 - 48, 0) AS lo, least(pos - 1 + len + 48, length(flat)) AS hi FROM h),
n AS (SELECT *, CASE WHEN body THEN CASE WHEN lo > 0 THEN '…' ELSE '' END || substr(flat, lo + 1, hi - lo)
                       || CASE WHEN hi < length(flat) THEN '…' ELSE '' END
                     WHEN length(flat) > 120 THEN left(flat, 120) || '…' ELSE flat END AS snippet FROM k),
o AS (SELECT *, {fold.format('snippet')} AS sf FROM n)
SELECT CAST(document_id AS VARCHAR) || '#' || CASE WHEN body THEN CAST(page_id AS VARCHAR) ELSE 'title' END AS result_id,
       document_id, title, document_type, page_id, page_number, snippet,
       CASE WHEN body THEN array_to_string(list_transform(list_sort(list_concat({spans})),
            lambda x: x.s || '-' || x.e), ',') ELSE '' END AS highlights,
       CASE WHEN body THEN 'body' WHEN title_rank = 0 THEN 'title_exact' ELSE 'title_partial' END AS match_kind,
       title_rank, CAST(body_match_count AS BIGINT) AS body_match_count, updated_at,
       row_number() OVER (ORDER BY title_rank, body_match_count DESC, updated_at DESC, CAST(document_id AS VARCHAR), page_number) - 1
         AS position
FROM o {tail}"""


def _matches(found):
    return found.select(
        "query_id", "document_id", "page_number",
        F.col("page_matches").cast("long").alias("page_matches"),
        F.col("body_match_count").cast("long").alias("body_match_count"),
    )


def search_batch(spark, sf_dir):
    """Every benchmark text as one query over the whole corpus."""
    queries = r.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    return _matches(batch_search.search_batch(queries, r.corpus_pages(spark, sf_dir)))


def search_batch_shared(spark, sf_dir):
    """Two words of every benchmark text next to a long word that many documents hold, over a stored index."""
    path = scratch(spark, "index")
    batch_search.write_index(batch_search.build_index(r.corpus_pages(spark, sf_dir)), path)
    queries = r.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.substring_index("text", " ", 2), F.lit(f" {SHARED_WORD}")).alias("query")
    )
    return _matches(batch_search.search_index(queries, batch_search.read_index(spark, path)))


SQL_BATCH = f"""
WITH t AS (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[\\t-\\r\\x{{85}}\\p{{Z}}]+')) AS raw
           FROM benchmark),
u AS (SELECT query_id, {r.SQL_FOLD.format('raw')} AS term FROM t WHERE raw <> ''),
v AS (SELECT query_id, term, count(*) AS times FROM u GROUP BY ALL),
need AS (SELECT query_id, count(*) AS n FROM v GROUP BY 1),
f AS (SELECT doc_id AS document_id, {r.SQL_FOLD.format('text')} AS f FROM documents),
dt AS (SELECT DISTINCT term FROM v),
c AS (SELECT document_id, term, CAST((length(f) - length(replace(f, term, ''))) / length(term) AS BIGINT) AS hits
      FROM f JOIN dt ON contains(f, term)),
pq AS (SELECT query_id, document_id, sum(hits * times) AS page_matches, count(*) AS found
       FROM c JOIN v USING (term) GROUP BY ALL)
SELECT query_id, document_id, 1 AS page_number, CAST(page_matches AS BIGINT) AS page_matches,
       CAST(page_matches AS BIGINT) AS body_match_count
FROM pq JOIN need USING (query_id) WHERE found = n"""


def query_terms(spark, sf_dir):
    rows = r.table(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.posexplode(t.query_terms(F.col("text"))).alias("position", "term"))


SQL_TERMS = r"""
WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\t-\r\x{85}\p{Z}]+'), lambda x: x <> '') AS terms
           FROM benchmark)
SELECT item_id, CAST(unnest(range(1, len(terms) + 1)) - 1 AS INTEGER) AS position, unnest(terms) AS term FROM t"""


def occurrence_counts(spark, sf_dir):
    rows = r.table(spark, sf_dir, "documents").withColumn("f", t.fold(F.col("text")))
    return rows.select(
        "doc_id",
        t.occurrences(F.col("f"), F.lit("etion")).alias("n_etion"),
        t.occurrences(F.col("f"), F.lit("la")).alias("n_la"),
        t.contains_term(F.col("f"), F.lit("uber")).alias("has_uber"),
        t.occurrences(F.col("f"), F.lit("")).alias("n_empty"),
    )


SQL_OCCURRENCES = f"""
WITH f AS (SELECT doc_id, {r.SQL_FOLD.format('text')} AS f FROM documents)
SELECT doc_id, CAST((length(f) - length(replace(f, 'etion', ''))) / 5 AS INTEGER) AS n_etion,
       CAST((length(f) - length(replace(f, 'la', ''))) / 2 AS INTEGER) AS n_la,
       contains(f, 'uber') AS has_uber, 0 AS n_empty
FROM f"""


def highlight_offsets(spark, sf_dir):
    """All match ranges of two terms in whole page texts."""
    rows = r.chat_pages(spark, sf_dir)
    found = t.highlight_ranges(F.col("text"), F.array(F.lit("que"), F.lit("eau")))
    return rows.select("page_id", marks(found).alias("highlights"), F.size(found).alias("n_ranges"))


SQL_HIGHLIGHTS = f"""
WITH {r.SQL_CHAT},
f AS (SELECT page_id, {r.SQL_FOLD.format('text')} AS f FROM chat_pages),
l AS (SELECT page_id, list_sort(list_concat(
        list_transform(list_filter(range(1, length(f) + 1), lambda i: substr(f, i, 3) = 'que'), lambda i: {{'s': i - 1, 'o': 0}}),
        list_transform(list_filter(range(1, length(f) + 1), lambda i: substr(f, i, 3) = 'eau'), lambda i: {{'s': i - 1, 'o': 1}})
      )) AS l FROM f)
SELECT page_id, array_to_string(list_transform(l, lambda x: x.s || '-' || (x.s + 3)), ',') AS highlights,
       CAST(len(l) AS INTEGER) AS n_ranges FROM l"""


def _marked(spark, sf_dir):
    """Chat pages with a mark on every e, written as two code points on even turns and as one letter on odd ones."""
    rows = r.chat_pages(spark, sf_dir)
    two = F.replace("text", F.lit("e"), F.lit("e\u0301"))
    one = F.replace("text", F.lit("e"), F.lit("\u00e9"))
    return rows.select("page_id", F.when(F.col("page_number") % 2 == 1, two).otherwise(one).alias("text"))


def highlight_marked(spark, sf_dir):
    """Match ranges where letters carry marks: a range covers them."""
    rows = _marked(spark, sf_dir)
    found = t.highlight_ranges(F.col("text"), F.array(F.lit("que"), F.lit("ea")))
    return rows.select("page_id", marks(found).alias("highlights"), F.size(found).alias("n_ranges"))


def occurrences_marked(spark, sf_dir):
    rows = _marked(spark, sf_dir).withColumn("f", t.fold(F.col("text")))
    return rows.select("page_id", t.occurrences(F.col("f"), F.lit("que")).alias("n_que"), t.occurrences(F.col("f"), F.lit("ea")).alias("n_ea"))


_SQL_MARKED = f"""
WITH {r.SQL_CHAT},
m AS (SELECT page_id, page_number % 2 = 1 AS two, {r.SQL_FOLD.format('text')} AS f,
             CASE WHEN page_number % 2 = 1 THEN replace(text, 'e', 'e' || chr(769)) ELSE replace(text, 'e', chr(233)) END AS t
      FROM chat_pages),
k AS (SELECT *, list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) <> chr(769)) AS kept FROM m)"""
SQL_HIGHLIGHT_MARKED = f"""{_SQL_MARKED},
l AS (SELECT page_id, t, kept, list_sort(list_concat(
        list_transform(list_filter(range(1, length(f) + 1), lambda i: substr(f, i, 3) = 'que'), lambda i: {{'s': i, 'o': 0, 'n': 3}}),
        list_transform(list_filter(range(1, length(f) + 1), lambda i: substr(f, i, 2) = 'ea'), lambda i: {{'s': i, 'o': 1, 'n': 2}})
      )) AS l FROM k)
SELECT page_id, array_to_string(list_transform(l, lambda x: (kept[x.s] - 1) || '-' || (coalesce(kept[x.s + x.n], length(t) + 1) - 1)), ',')
         AS highlights, CAST(len(l) AS INTEGER) AS n_ranges FROM l"""


def page_previews(spark, sf_dir):
    rows = r.corpus_pages(spark, sf_dir)
    return rows.select(
        "document_id", t.preview(F.col("text")).alias("preview"),
        F.length(t.flatten_whitespace(F.col("text"))).alias("flat_length"),
    )


SQL_PREVIEWS = f"""
WITH f AS (SELECT doc_id AS document_id, {r.SQL_FLAT.format('text')} AS flat FROM documents)
SELECT document_id, CASE WHEN length(flat) > 120 THEN left(flat, 120) || '…' ELSE flat END AS preview,
       CAST(length(flat) AS INTEGER) AS flat_length FROM f"""


def results_with_documents(spark, sf_dir):
    """Results joined to the documents that still exist (PDFs were removed meanwhile)."""
    found = search.search(r.chat_documents(spark, sf_dir), r.chat_pages(spark, sf_dir), "que eau")
    current = r.chat_documents(spark, sf_dir).filter("document_type <> 'pdf'")
    joined = search.attach_documents(
        found.select("result_id", "document_id"),
        current.select("document_id", F.col("title").alias("current_title")),
    )
    return joined.select("result_id", "document_id", "current_title", "available")


SQL_RESULTS_DOCS = f"""
WITH {r.SQL_CHAT},
f AS (SELECT *, {r.SQL_FOLD.format('text')} AS f FROM chat_pages),
hit AS (SELECT * FROM f WHERE contains(f, 'que') AND contains(f, 'eau')),
titled AS (SELECT document_id FROM chat_documents
           WHERE contains({r.SQL_FOLD.format('title')}, 'que') AND contains({r.SQL_FOLD.format('title')}, 'eau')
             AND document_id NOT IN (SELECT document_id FROM hit)),
res AS (SELECT document_id || '#' || page_id AS result_id, document_id FROM hit
        UNION ALL SELECT document_id || '#title', document_id FROM titled)
SELECT result_id, res.document_id, c.title AS current_title, c.document_id IS NOT NULL AS available
FROM res LEFT JOIN (SELECT * FROM chat_documents WHERE document_type <> 'pdf') c USING (document_id)"""


def open_result_pages(spark, sf_dir):
    pages = r.chat_pages(spark, sf_dir)
    documents = r.chat_documents(spark, sf_dir).join(
        pages.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count")), "document_id"
    )
    found = search.search(r.chat_documents(spark, sf_dir), pages, "que eau")
    wanted = found.select("result_id", "document_id", (F.col("page_number") + 2).alias("page_number"))
    return search.open_result_pages(wanted, documents, pages).select(
        "result_id", "page_number", "open_page_id"
    )


SQL_OPEN_PAGES = f"""
WITH {r.SQL_CHAT},
f AS (SELECT *, {r.SQL_FOLD.format('text')} AS f FROM chat_pages),
hit AS (SELECT * FROM f WHERE contains(f, 'que') AND contains(f, 'eau')),
titled AS (SELECT document_id FROM chat_documents
           WHERE contains({r.SQL_FOLD.format('title')}, 'que') AND contains({r.SQL_FOLD.format('title')}, 'eau')
             AND document_id NOT IN (SELECT document_id FROM hit)),
res AS (SELECT document_id || '#' || page_id AS result_id, document_id, page_number FROM hit
        UNION ALL SELECT document_id || '#title', document_id, 1 FROM titled),
n AS (SELECT document_id, count(*) AS page_count FROM chat_pages GROUP BY 1),
c AS (SELECT result_id, res.document_id, CAST(least(greatest(page_number + 2, 1), page_count) AS INTEGER) AS page_number
      FROM res JOIN n USING (document_id))
SELECT result_id, c.page_number, p.page_id AS open_page_id
FROM c JOIN chat_pages p ON p.document_id = c.document_id AND p.page_number = c.page_number"""

QUERIES = {
    "search_flagship": search_flagship,
    "search_top20": search_top20,
    "search_all_pages": search_all_pages,
    "search_title_hits": search_title_hits,
    "search_blank_query": search_blank_query,
    "search_batch": search_batch,
    "search_batch_shared": search_batch_shared,
    "query_terms": query_terms,
    "occurrence_counts": occurrence_counts,
    "highlight_offsets": highlight_offsets,
    "highlight_marked": highlight_marked,
    "occurrences_marked": occurrences_marked,
    "page_previews": page_previews,
    "results_with_documents": results_with_documents,
    "open_result_pages": open_result_pages,
}

_CHAT = f"WITH {r.SQL_CHAT}"
ORACLE = {
    "search_flagship": _CHAT + sql_search("chat_documents", "chat_pages", ["the", "of"], "the of", 20),
    "search_top20": _CHAT + sql_search("chat_documents", "chat_pages", ["etion", "que"], "etion  que", 20),
    "search_all_pages": f"WITH {r.SQL_CORPUS}"
    + sql_search("corpus_documents", "corpus_pages", ["the", "thor"], "the thor"),
    "search_title_hits": f"WITH {r.SQL_LIBRARY}"
    + ", dated AS (SELECT *, created_at AS updated_at FROM library_documents)"
    + sql_search("dated", "library_pages", ["customer", "building"], "customer building"),
    "search_blank_query": _CHAT
    + sql_search("chat_documents", "chat_pages", ["the", "of"], "the of").replace("FROM o", "FROM o WHERE false"),
    "search_batch": SQL_BATCH,
    "search_batch_shared": SQL_BATCH.replace(
        "lower(text)", f"lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' {SHARED_WORD}')", 1
    ),
    "query_terms": SQL_TERMS,
    "occurrence_counts": SQL_OCCURRENCES,
    "highlight_offsets": SQL_HIGHLIGHTS,
    "highlight_marked": SQL_HIGHLIGHT_MARKED,
    "occurrences_marked": f"{_SQL_MARKED} SELECT page_id, CAST((length(f) - length(replace(f, 'que', ''))) / 3 AS INTEGER) AS n_que, "
    "CAST((length(f) - length(replace(f, 'ea', ''))) / 2 AS INTEGER) AS n_ea FROM k",
    "page_previews": SQL_PREVIEWS,
    "results_with_documents": SQL_RESULTS_DOCS,
    "open_result_pages": SQL_OPEN_PAGES,
}
