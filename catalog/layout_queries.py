"""Layout: columns, visual lines, reading order, page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout, parts

from . import relations as r

KEYS = ["page_id"]


def reading_order(spark, sf_dir):
    return layout.reading_order(r.blocks(spark, sf_dir), KEYS, r.ORDINAL).select(
        "page_id", *r.ORDINAL, "column_id", F.col("line_id").cast("int").alias("line_id"), "reading_order"
    )


def column_statistics(spark, sf_dir):
    return layout.column_statistics(r.blocks(spark, sf_dir), KEYS)


def visual_lines(spark, sf_dir):
    return layout.group_lines(r.blocks(spark, sf_dir), KEYS, r.ORDINAL).select(
        "page_id", *r.ORDINAL, "column_id", F.col("line_id").cast("int").alias("line_id"), "mid_y"
    )


def page_text(spark, sf_dir):
    return layout.order_and_compose(r.blocks(spark, sf_dir), KEYS, r.ORDINAL)


def page_text_in_parts(spark, sf_dir):
    """Parts of two blocks, put together."""
    cut_up = layout.order_and_compose(r.blocks(spark, sf_dir), KEYS, r.ORDINAL, part_blocks=2)
    return parts.whole(cut_up, KEYS, "page_text")


def text_line_flags(spark, sf_dir):
    """Continues-line flags along the stored (arrival) order of blocks."""
    stored = layout.reindex(
        r.blocks(spark, sf_dir).withColumn("reading_order", F.col("l_linenumber") * 10), KEYS, r.ORDINAL[1:]
    )
    return layout.line_flags(stored, KEYS).select(
        "page_id", *r.ORDINAL, "reading_order", "continues_line", F.col("text_line").cast("int").alias("text_line")
    )


SQL_ORDER = f"""{r.SQL_BLOCKS},
side AS (SELECT *, CASE WHEN x + w <= CAST(0.52 AS DOUBLE) THEN 'left'
                        WHEN x >= CAST(0.48 AS DOUBLE) THEN 'right' ELSE 'spanning' END AS side FROM blocks),
stat AS (SELECT page_id, count(*) FILTER (side = 'left') AS left_count, count(*) FILTER (side = 'right') AS right_count,
                count(*) FILTER (side = 'spanning') AS spanning_count, count(*) AS block_count FROM side GROUP BY 1),
col AS (SELECT side.*, CASE WHEN spanning_count = 0 AND left_count >= 2 AND right_count >= 2 AND side = 'right'
                            THEN 1 ELSE 0 END AS column_id, y + h / 2 AS mid_y
        FROM side JOIN stat USING (page_id)),
prev AS (SELECT *, lag(y) OVER w AS py, lag(h) OVER w AS ph FROM col
         WINDOW w AS (PARTITION BY page_id, column_id
                      ORDER BY mid_y DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
flag AS (SELECT *, CASE WHEN py IS NOT NULL AND least(y + h, py + ph) - greatest(y, py) > 0
                         AND (least(y + h, py + ph) - greatest(y, py)) / least(h, ph) >= CAST(0.35 AS DOUBLE)
                        THEN 0 ELSE 1 END AS fresh FROM prev),
lined AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id, column_id
                    ORDER BY mid_y DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice
                    ROWS UNBOUNDED PRECEDING) AS line_id FROM flag),
ordered AS (SELECT *, row_number() OVER (PARTITION BY page_id
                      ORDER BY column_id, line_id, x, mid_y DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
                      - 1 AS reading_order FROM lined)"""

SQL_FLAGS = """,
seen AS (SELECT *, lag(y) OVER w AS qy, lag(h) OVER w AS qh, lag(x) OVER w AS qx FROM {0}
         WINDOW w AS (PARTITION BY page_id ORDER BY reading_order)),
cont AS (SELECT *, coalesce(qy IS NOT NULL AND least(y + h, qy + qh) - greatest(y, qy) > 0
                   AND (least(y + h, qy + qh) - greatest(y, qy)) / least(h, qh) >= CAST(0.35 AS DOUBLE)
                   AND x >= qx, false) AS continues_line FROM seen),
runs AS (SELECT *, sum(CASE WHEN continues_line THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY reading_order
                   ROWS UNBOUNDED PRECEDING) AS text_line FROM cont)"""

_PAGE_TEXT = (
    f"WITH {SQL_ORDER}{SQL_FLAGS.format('ordered')},\n"
    "joined AS (SELECT page_id, text_line, string_agg(text, ' ' ORDER BY reading_order) AS line, count(*) AS n "
    "FROM runs GROUP BY ALL)"
)

ORDINALS = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"

QUERIES = {
    "reading_order": reading_order,
    "column_statistics": column_statistics,
    "visual_lines": visual_lines,
    "page_text": page_text,
    "page_text_in_parts": page_text_in_parts,
    "text_line_flags": text_line_flags,
}

ORACLE = {
    "reading_order": f"WITH {SQL_ORDER} SELECT page_id, {ORDINALS}, column_id, CAST(line_id AS INTEGER) AS line_id, "
    "CAST(reading_order AS INTEGER) AS reading_order FROM ordered",
    "column_statistics": f"WITH {SQL_ORDER} SELECT page_id, left_count, right_count, spanning_count, block_count, "
    "spanning_count = 0 AND left_count >= 2 AND right_count >= 2 AS two_columns FROM stat",
    "visual_lines": f"WITH {SQL_ORDER} SELECT page_id, {ORDINALS}, column_id, CAST(line_id AS INTEGER) AS line_id, "
    "mid_y FROM lined",
    "page_text": f"{_PAGE_TEXT} SELECT page_id, 0 AS part, string_agg(line, chr(10) ORDER BY text_line) AS page_text, "
    "CAST(sum(n) AS BIGINT) AS block_count FROM joined GROUP BY page_id",
    "page_text_in_parts": f"{_PAGE_TEXT} SELECT page_id, string_agg(line, chr(10) ORDER BY text_line) AS page_text FROM joined GROUP BY page_id",
    "text_line_flags": f"WITH {r.SQL_BLOCKS}, stored AS (SELECT *, row_number() OVER (PARTITION BY page_id "
    f"ORDER BY {ORDINALS}) - 1 AS reading_order FROM blocks){SQL_FLAGS.format('stored')} "
    f"SELECT page_id, {ORDINALS}, CAST(reading_order AS INTEGER) AS reading_order, continues_line, "
    "CAST(text_line AS INTEGER) AS text_line FROM runs",
}
