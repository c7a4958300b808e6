"""How the driver tables play the document-corpus relations, in Spark and in SQL.

Each relation has a Spark reader and a CTE text that derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import sanitize_title

TYPES = ["camera", "photo", "pdf"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (number % 3 + 1).cast("int"))


# --- conversations: a document per conversation, a page per turn ------------------------


def chat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").alias("document_id"),
        F.concat_ws("-", "conv_id", "turn").alias("page_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        "text",
    )


def chat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("turn = 0")
    return rows.select(
        F.col("conv_id").alias("document_id"),
        sanitize_title(F.col("text")).alias("title"),
        type_of(F.col("conv_id")).alias("document_type"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id")).alias("updated_at"),
    )


SQL_TITLE = (
    r"""trim(left(trim(regexp_replace(regexp_replace({0}, '[/\\:*?"<>|\n\t\r]', ' ', 'g'),"""
    r""" '[\t\p{{Zs}}]+', ' ', 'g')), 80))"""
)
SQL_FLAT = r"trim(regexp_replace({0}, '[\t-\r\x{{85}}\p{{Z}}]+', ' ', 'g'))"
SQL_FOLD = "lower(strip_accents({0}))"

SQL_CHAT = f"""
chat_pages AS (
  SELECT conv_id AS document_id, conv_id || '-' || turn AS page_id,
         CAST(turn + 1 AS INTEGER) AS page_number, text
  FROM conversations),
chat_documents AS (
  SELECT conv_id AS document_id, {SQL_TITLE.format('text')} AS title,
         ['camera','photo','pdf'][CAST(conv_id % 3 + 1 AS INTEGER)] AS document_type,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id) AS updated_at
  FROM conversations WHERE turn = 0)"""


# --- documents: single-page accented corpus ----------------------------------------------


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.col("doc_id").alias("document_id"),
        F.col("doc_id").cast("string").alias("page_id"),
        F.lit(1).alias("page_number"),
        "text",
    )


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select(
        F.col("doc_id").alias("document_id"),
        sanitize_title(F.substring_index(F.col("text"), "\n", 1)).alias("title"),
        type_of(F.col("doc_id")).alias("document_type"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).alias("updated_at"),
    )


SQL_CORPUS = f"""
corpus_pages AS (
  SELECT doc_id AS document_id, CAST(doc_id AS VARCHAR) AS page_id, 1 AS page_number, text FROM documents),
corpus_documents AS (
  SELECT doc_id AS document_id, {SQL_TITLE.format("split_part(text, chr(10), 1)")} AS title,
         ['camera','photo','pdf'][CAST(doc_id % 3 + 1 AS INTEGER)] AS document_type,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS updated_at
  FROM documents)"""


# --- lineitem: recognised text blocks, a page per order -----------------------------------

ORDINAL = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("page_id"),
        *ORDINAL,
        F.concat("l_returnflag", "l_linestatus").alias("text"),
        ((F.col("l_partkey") % 90) / F.lit(100.0)).alias("x"),
        (F.lit(1.0) - F.col("l_quantity") / F.lit(51.0)).alias("y"),
        (F.lit(0.05) + F.col("l_discount")).alias("w"),
        (F.lit(0.02) + F.col("l_tax") / F.lit(4.0)).alias("h"),
    )


SQL_BLOCKS = """
blocks AS (
  SELECT l_orderkey AS page_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         l_returnflag || l_linestatus AS text,
         (l_partkey % 90) / CAST(100.0 AS DOUBLE) AS x,
         CAST(1.0 AS DOUBLE) - l_quantity / CAST(51.0 AS DOUBLE) AS y,
         CAST(0.05 AS DOUBLE) + l_discount AS w,
         CAST(0.02 AS DOUBLE) + l_tax / CAST(4.0 AS DOUBLE) AS h
  FROM lineitem)"""


# --- customer / orders / lineitem: the three-level library --------------------------------


def library_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per customer; status and error come from the account balance."""
    rows = table(spark, sf_dir, "customer")
    balance = F.col("c_acctbal")
    return rows.select(
        F.col("c_custkey").alias("document_id"),
        F.concat("c_name", F.lit(" / "), "c_mktsegment").alias("title"),
        F.element_at(
            F.array(F.lit("camera"), F.lit("photo"), F.lit("pdf"), F.lit("fax")),
            (F.col("c_custkey") % 4 + 1).cast("int"),
        ).alias("document_type"),
        F.when(balance < 0, "failed")
        .when(balance < 2000, "processing")
        .when(balance < 4000, "queued")
        .otherwise("completed")
        .alias("processing_status"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("error of "), "c_name")).alias("processing_error"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("c_custkey") * 37 % 86400).alias("created_at"),
        F.concat(F.lit("doc_"), "c_custkey", F.lit(".pdf")).alias("local_file_name"),
    )


def library_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order; the order key orders the pages of a document."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_orderkey").alias("page_id"),
        F.col("o_custkey").alias("document_id"),
        (F.col("o_orderkey") + 1).cast("int").alias("page_number"),
        F.concat(F.lit(" "), "o_orderpriority", F.lit("\n"), F.col("o_orderstatus"), F.lit(" ")).alias("text"),
        F.concat(F.lit("page_"), "o_orderkey", F.lit(".jpg")).alias("image_file_name"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


SQL_LIBRARY = """
library_documents AS (
  SELECT c_custkey AS document_id, c_name || ' / ' || c_mktsegment AS title,
         ['camera','photo','pdf','fax'][CAST(c_custkey % 4 + 1 AS INTEGER)] AS document_type,
         CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal < 2000 THEN 'processing'
              WHEN c_acctbal < 4000 THEN 'queued' ELSE 'completed' END AS processing_status,
         CASE WHEN c_custkey % 2 = 0 THEN 'error of ' || c_name END AS processing_error,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey * 37 % 86400) AS created_at,
         'doc_' || c_custkey || '.pdf' AS local_file_name
  FROM customer),
library_pages AS (
  SELECT o_orderkey AS page_id, o_custkey AS document_id, CAST(o_orderkey + 1 AS INTEGER) AS page_number,
         ' ' || o_orderpriority || chr(10) || o_orderstatus || ' ' AS text,
         'page_' || o_orderkey || '.jpg' AS image_file_name, o_orderdate AS created_at
  FROM orders)"""


# --- pages: Markdown sources derived from web pages ---------------------------------------

_MARKDOWN_STEPS = [
    (r"<h1>", "\n# "),
    (r"<li>", "\n- "),
    (r"</h1>|</li>|</p>|<br>|</div>", "\n"),
    (r"<b>", "**"),
    (r"<[^>]*>", ""),
]


def markdown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, markdown): tags become headings, list items, bold marks and lines."""
    text = F.col("html")
    for pattern, replacement in _MARKDOWN_STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), text.alias("markdown"))


def _sql_markdown() -> str:
    text = "html"
    for pattern, replacement in _MARKDOWN_STEPS:
        quoted = replacement.replace("\n", "' || chr(10) || '")
        text = f"regexp_replace({text}, '{pattern}', '{quoted}', 'g')"
    return f"""
sources AS (SELECT page_id AS doc_id, {text} AS markdown FROM pages)"""


SQL_SOURCES = _sql_markdown()


# --- events: stage, query and arrival streams ---------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
