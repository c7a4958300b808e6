"""Many queries at once, as equi-joins over a token index instead of a query-by-page product.

A term holds no whitespace, so every match lies inside one whitespace-free
token. The index says how often a page holds a token; its distinct tokens (the
vocabulary) are far fewer than the words. Terms are matched against vocabulary
substrings by equality. Each query starts from the pages of its rarest term and
finds its other terms there by equality on (page, term); counts come from the
index as well, so the text of a page is read once, when it is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..runtime import broadcast_if_small, cut, written

#: Tokens up to this length are cut by position, longer ones by a regex scan.
WORD_LENGTH = 256
PAGE = ["document_id", "page_id"]


@dataclass
class TokenIndex:
    """``postings``: document_id, page_id, page_number, token, n. ``vocabulary``: token, pages."""

    postings: DataFrame
    vocabulary: DataFrame


def _counted_words(words: Column) -> Column:
    """(token, n) of the different words of one page: ends of equal runs of the sorted words, inside the row."""

    def runs(ordered: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: F.get(ordered, i - 1) != F.coalesce(F.get(ordered, i), F.lit("")))
        spans = lambda at: F.transform(
            at, lambda end, i: F.struct(
                F.get(ordered, end - 1).alias("token"),
                (end - F.coalesce(F.get(at, i - 1), F.lit(0))).cast("long").alias("n"),
            ),
        )
        return F.transform(F.array(ends), spans)[0]

    found = F.sort_array(F.filter(words, lambda w: w != ""))
    # bound by a lambda: sorted once a row; a sequence from 1 to 0 would run backwards
    return F.flatten(F.transform(F.filter(F.array(found), lambda a: F.size(a) > 0), runs))


def build_index(pages: DataFrame) -> TokenIndex:
    """Token index of pages (document_id, page_id, page_number, text); a page is one row with a unique key.

    Words are counted inside the row of their page, without an exchange, and per token before the next.
    """
    words = F.split(t.fold(F.col("text")), t.WHITESPACE_RUN)
    postings = written(pages.select(*PAGE, "page_number", F.inline(_counted_words(words))))
    return TokenIndex(postings, written(postings.groupBy("token").agg(F.count("*").alias("pages"))))


def write_index(index: TokenIndex, path: str) -> None:
    """Store an index; postings stand in order of tokens, so a file holds a narrow range of them."""
    index.postings.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    index.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_index(spark: SparkSession, path: str) -> TokenIndex:
    return TokenIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"))


def query_terms_table(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): folded terms of each query; ``times`` counts repeats."""
    terms = F.filter(F.transform(t.query_terms(F.col("query")), t.fold), lambda term: term != "")
    return queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def match_vocabulary(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, term): every token of the vocabulary with each term inside it.

    Every substring whose length some term has is looked up by equality, so no
    false candidate is ever produced.
    """
    distinct = terms.select("term").distinct()
    # The distinct term lengths: as many values as there are different word lengths.
    lengths = sorted(row[0] for row in distinct.select(F.length("term")).distinct().collect())
    if not lengths:
        return vocabulary.filter(F.lit(False)).withColumn("term", F.col("token"))
    size = F.length("token")
    sizes = F.array(*[F.lit(n) for n in lengths])
    # Words: every (start, size) pair, all in generated code.
    words = (
        vocabulary.filter(size <= WORD_LENGTH)
        .withColumn("_at", F.explode(F.sequence(F.lit(1), size)))
        .withColumn("_n", F.explode(sizes))
        .filter(F.col("_at") + F.col("_n") - 1 <= size)
        .select("token", F.substring(F.col("token"), F.col("_at"), F.col("_n")).alias("term"))
    )
    # Cutting by position costs the square of the length; for very long tokens
    # (scripts without spaces) a lookahead yields the same pieces in linear time.
    scans = [F.regexp_extract_all(F.col("token"), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    runs = vocabulary.filter(size > WORD_LENGTH).select("token", F.explode(F.concat(*scans)).alias("term"))
    return (
        words.unionByName(runs)
        .join(broadcast_if_small(distinct), "term")
        .select("token", "term")
        .distinct()
    )


def search_index(queries: DataFrame, index: TokenIndex) -> DataFrame:
    """Body matches of a table of queries (query_id, query).

    Returns (query_id, document_id, page_id, page_number, page_matches,
    body_match_count) for every page that holds all terms of a query. A query
    whose rarest term is rare meets few pages, however common its other terms
    are and however many queries share them.
    """
    asked = cut(query_terms_table(queries))
    # Matching is compute-heavy for its size, so it keeps the full partition count.
    width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vocabulary = index.vocabulary.repartition(width, "token")
    matched = match_vocabulary(vocabulary.select("token"), asked)
    hits = t.occurrences(F.col("token"), F.col("term")).cast("long")
    token_terms = cut(matched.withColumn("hits", hits).join(index.vocabulary, "token"))
    # The pages of a term are at most the pages of its tokens: rarest first, ties by the term itself.
    rarity = token_terms.groupBy("term").agg(F.sum("pages").alias("pages"))
    needed = asked.groupBy("query_id").agg(F.count("*").alias("_needed"))
    known = asked.join(rarity, "term")
    anchors = cut(
        known.groupBy("query_id").agg(F.count("*").alias("_known"), F.min_by("term", F.struct("pages", "term")).alias("term"))
        .join(needed, "query_id").filter(F.col("_known") == F.col("_needed")).select("query_id", "_needed", "term")
    )
    asked = asked.join(broadcast_if_small(anchors.select("query_id")), "query_id", "left_semi")
    wanted = broadcast_if_small(token_terms.select("token", "term", "hits"))

    def holding(keys: list[str], rows: DataFrame, tokens: DataFrame) -> DataFrame:
        """(keys, term, total) of index rows; summed before the exchange."""
        return rows.join(tokens, "token").groupBy(*keys, "term").agg(F.sum(F.col("n") * F.col("hits")).alias("total"))

    page = [*PAGE, "page_number"]
    anchor_terms = broadcast_if_small(anchors.select("term").distinct())
    anchor_tokens = broadcast_if_small(cut(token_terms.select("token", "term", "hits").join(anchor_terms, "term", "left_semi")))
    # One row per query and page of its rarest term.
    candidates = cut(holding(page, index.postings, anchor_tokens).drop("total").join(broadcast_if_small(anchors), "term").drop("term"))
    near = index.postings.join(broadcast_if_small(cut(candidates.select(*PAGE).distinct())), PAGE, "left_semi")
    found = cut(
        candidates.join(asked, "query_id")
        .join(holding(PAGE, near, wanted), [*PAGE, "term"])
        .groupBy("query_id", *page, "_needed")
        .agg(F.count("*").alias("_found"), F.sum(F.col("times") * F.col("total")).alias("page_matches"))
        .filter(F.col("_found") == F.col("_needed"))
        .select("query_id", *page, "page_matches")
    )
    # A document's count covers all its pages, also those without every term.
    documents = cut(found.select("query_id", "document_id").distinct())
    inside = index.postings.join(broadcast_if_small(documents.select("document_id").distinct()), "document_id", "left_semi")
    totals = (
        documents.join(asked, "query_id")
        .join(holding(["document_id"], inside, wanted), ["document_id", "term"])
        .groupBy("query_id", "document_id")
        .agg(F.sum(F.col("times") * F.col("total")).alias("body_match_count"))
    )
    return found.join(totals, ["query_id", "document_id"])


def search_batch(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """:func:`search_index` over an index built for this batch; keep the index where more batches follow."""
    return search_index(queries, build_index(pages))
