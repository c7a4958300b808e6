"""Names, paging arithmetic, geometry: row-local functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import labels, names, paging

from . import relations as r




def _files(spark, sf_dir):
    """File names with illegal characters, runs of blanks and an extension, from parts."""
    return r.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 5 == 0, F.lit(None))
        .when(F.col("p_partkey") % 5 == 1, " / .pdf")
        .otherwise(F.concat(F.lit("  "), "p_name", F.lit("/Notes:  "), "p_brand", F.lit(" "), "p_type", F.lit(" .pdf")))
        .alias("file_name"),
        r.type_of(F.col("p_partkey")).alias("document_type"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("p_partkey") * 61).alias("created_at"),
    )


def sanitized_titles(spark, sf_dir):
    rows = r.table(spark, sf_dir, "documents")
    return rows.select("doc_id", names.sanitize_title(F.col("text")).alias("title"))


def import_titles(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return rows.select(
        "p_partkey",
        names.title_from_file_name(F.col("file_name"), F.col("document_type"), F.col("created_at")).alias("title"),
    )


def file_names(spark, sf_dir):
    rows = r.table(spark, sf_dir, "orders")
    key = F.concat(F.lit("ORD-"), F.col("o_orderkey"))
    kind = r.type_of(F.col("o_orderkey"))
    return rows.select(
        "o_orderkey",
        names.source_file_name(key, kind).alias("source_name"),
        names.page_image_name(key, F.col("o_custkey") - 100).alias("image_name"),
        names.page_source_path(F.col("o_custkey")).alias("page_path"),
        names.refinement_cache_path(F.col("o_custkey")).alias("refinement_path"),
        names.vision_cache_path(F.col("o_custkey"), F.lit("crop"), F.col("o_orderkey") % 6).alias("crop_path"),
        names.history_stamp(F.col("o_orderdate")).alias("stamp"),
    )


def default_titles(spark, sf_dir):
    rows = r.table(spark, sf_dir, "orders")
    given = F.when(F.col("o_orderkey") % 3 == 0, "  \n ").when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit(" "), "o_orderpriority", F.lit("\n"))
    )
    return rows.select("o_orderkey", names.default_job_title(given, F.col("o_orderdate")).alias("title"))


def archive_paths(spark, sf_dir):
    """URL paths with doubled and parent components, as archive member names."""
    raw = F.concat(F.lit("./"), F.replace(F.col("url"), F.lit("/"), F.lit("\\")), F.lit("/../x//y"))
    rows = r.table(spark, sf_dir, "pages")
    return rows.select(
        "page_id", names.archive_path(raw).alias("path"), names.natural_key(F.col("url")).alias("natural_key"),
        names.is_safe_path(F.col("url")).alias("safe"), names.is_safe_path(raw).alias("raw_safe"),
    )


def page_arithmetic(spark, sf_dir):
    rows = r.table(spark, sf_dir, "lineitem")
    p, n = F.col("l_partkey").cast("int"), (F.col("l_suppkey") - 3).cast("int")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        paging.page_index(p).alias("page_index"), paging.page_number(p).alias("page_number"),
        paging.clamp_page(p, n).alias("clamped"), paging.is_valid_page(p, n).alias("valid"),
        paging.completion(p, n).alias("completion"),
        paging.refinement_progress(F.col("l_linenumber"), n, F.col("l_discount") * 20 - 0.5).alias("overall"),
    )


def displayed_progress(spark, sf_dir):
    stages = list(labels.JOB_STAGES)
    stage = F.element_at(F.array(*[F.lit(s) for s in stages]), (F.col("event_id") % 8 + 1).cast("int"))
    given = F.when(F.col("event_id") % 3 == 0, paging.clamp_unit(F.col("value") / 100.0))
    imports = list(labels.IMPORT_STAGES)
    imported = F.element_at(F.array(*[F.lit(s) for s in imports]), (F.col("event_id") % 5 + 1).cast("int"))
    return r.table(spark, sf_dir, "events").select(
        "event_id", stage.alias("stage"), labels.job_stage_name(stage).alias("stage_name"),
        labels.import_stage_name(imported).alias("import_stage_name"),
        paging.displayed_progress(given, stage).alias("displayed"),
    )


def image_rectangles(spark, sf_dir):
    size = (F.col("l_partkey") % 40 * 50).cast("double")
    rows = r.blocks(spark, sf_dir)
    rect = g.to_image_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"), size, size + 200)
    return rows.withColumn("r", rect).select(
        "page_id", *r.ORDINAL, F.col("r.x").alias("px"), F.col("r.y").alias("py"),
        F.col("r.w").alias("pw"), F.col("r.h").alias("ph"),
    )


def normalized_rectangles(spark, sf_dir):
    size = (F.col("l_partkey") % 40 * 50).cast("double")
    rows = r.blocks(spark, sf_dir)
    rect = g.to_normalized_rect(
        F.col("x") * 1000, F.col("y") * 1000, F.col("w") * 1000, F.col("h") * 1000, size, size + 200
    )
    return rows.withColumn("r", rect).select(
        "page_id", *r.ORDINAL, F.col("r.x").alias("nx"), F.col("r.y").alias("ny"),
        F.col("r.w").alias("nw"), F.col("r.h").alias("nh"),
    )


def _page_sizes(spark, sf_dir):
    """Page images sized by quantity and price of their order lines."""
    return r.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), *r.ORDINAL,
        (F.col("l_quantity") * 40).cast("int").alias("width"),
        F.floor(F.col("l_extendedprice") / 20).cast("int").alias("height"),
    )


def crop_plan(spark, sf_dir):
    planned = g.plan_crops(_page_sizes(spark, sf_dir))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    pixel = g.pixel_rect(F.col("crop_x"), F.col("crop_y"), F.col("crop_w"), F.col("crop_h"), w, h)
    return planned.withColumn("p", pixel).select(
        "page_id", *r.ORDINAL, "crop_count", "crop_index",
        F.round("crop_x", 9).alias("crop_x"), F.round("crop_y", 9).alias("crop_y"),
        F.round("crop_w", 9).alias("crop_w"), F.round("crop_h", 9).alias("crop_h"),
        F.col("p.left").alias("left_px"), F.col("p.top").alias("top_px"),
        F.col("p.width").alias("width_px"), F.col("p.height").alias("height_px"),
    )


def retry_plan(spark, sf_dir):
    from quire.operators.jobs import retry_plan as classify

    codes = F.array(*[F.lit(c) for c in (200, 400, 404, 408, 409, 425, 429, 500, 502, 503, 504)])
    calls = r.table(spark, sf_dir, "events").select(
        "event_id", F.element_at(codes, (F.col("event_id") % 11 + 1).cast("int")).alias("status"),
        (F.col("user_id") % 7).cast("int").alias("attempt"),
        F.when(F.col("event_id") % 4 == 0, F.col("value") - 5.0).alias("retry_after"),
    )
    return classify(calls)


_P = "CAST(l_partkey AS INTEGER)"
_N = "CAST(l_suppkey - 3 AS INTEGER)"
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_ORD = ", ".join(r.ORDINAL)
_D = "CAST({} AS DOUBLE)"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + " END"


QUERIES = {
    f.__name__: f
    for f in (
        sanitized_titles, import_titles, file_names, default_titles, archive_paths, page_arithmetic,
        displayed_progress, image_rectangles, normalized_rectangles, crop_plan, retry_plan,
    )
}

ORACLE = {
    "sanitized_titles": f"SELECT doc_id, {r.SQL_TITLE.format('text')} AS title FROM documents",
    "import_titles": "WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL "
    "WHEN p_partkey % 5 = 1 THEN ' / ' ELSE '  ' || p_name || '/Notes:  ' || p_brand || ' ' || p_type || ' ' END AS base, "
    "['Camera','Photo','PDF'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS kind, "
    "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey * 61) AS at_time FROM part) "
    f"SELECT p_partkey, coalesce(nullif({r.SQL_TITLE.format('base')}, ''), "
    "kind || ' ' || strftime(at_time, '%Y-%m-%d %H:%M')) AS title FROM f",
    "file_names": "SELECT o_orderkey, 'doc_ord-' || o_orderkey || '.' || ['jpg','jpg','pdf'][CAST(o_orderkey % 3 + 1 AS INTEGER)] "
    "AS source_name, printf('page_ord-%d_%04d.jpg', o_orderkey, greatest(o_custkey - 100, 0)) AS image_name, "
    "printf('pages/page-%03d.jpg', o_custkey + 1) AS page_path, "
    "printf('refinement-page-%03d.json', o_custkey + 1) AS refinement_path, "
    "printf('vision-page-%03d-crop-%03d.json', o_custkey + 1, o_orderkey % 6 + 1) AS crop_path, "
    "strftime(o_orderdate, '%Y%m%d-%H%M%S-%g') AS stamp FROM orders",
    "default_titles": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'Notes ' || "
    "strftime(o_orderdate, '%-d %b %Y at %H:%M') END AS title FROM orders",
    "archive_paths": r"""
WITH u AS (SELECT page_id, url, './' || replace(url, '/', '\') || '/../x//y' AS raw FROM pages),
n AS (SELECT *, regexp_extract_all(lower(url), '[0-9]+|[^0-9]+') AS pieces FROM u)
SELECT page_id, array_to_string(list_filter(string_split(replace(raw, '\', '/'), '/'),
         lambda x: x NOT IN ('', '.', '..')), '/') AS path,
       array_to_string(list_transform(pieces, lambda x: CASE WHEN regexp_matches(x, '^[0-9]')
         THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE x END), '') AS natural_key,
       NOT starts_with(url, '/') AND NOT contains(url, '..') AS safe, false AS raw_safe FROM n""",
    "page_arithmetic": f"SELECT {_LINE}, {_P} - 1 AS page_index, {_P} + 1 AS page_number, "
    f"CASE WHEN {_N} > 0 THEN least(greatest({_P}, 1), {_N}) END AS clamped, {_P} BETWEEN 1 AND {_N} AS valid, "
    f"CASE WHEN {_N} > 0 THEN least(greatest({_P}, 0), {_N}) / {_D.format(_N)} ELSE {_D.format('0')} END AS completion, "
    f"CAST(0.62 AS DOUBLE) + {_D.format(repr(0.86 - 0.01 - 0.62))} * ((l_linenumber + "
    f"least(greatest(l_discount * 20 - CAST(0.5 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))) / greatest({_N}, 1)) "
    "AS overall FROM lineitem",
    "displayed_progress": f"WITH e AS (SELECT event_id, {_list(labels.JOB_STAGES)}[CAST(event_id % 8 + 1 AS INTEGER)] AS stage, "
    f"{_list(labels.IMPORT_STAGES.values())}[CAST(event_id % 5 + 1 AS INTEGER)] AS import_stage_name, "
    "CASE WHEN event_id % 3 = 0 THEN least(greatest(value / CAST(100 AS DOUBLE), 0), 1) END AS given FROM events) "
    f"SELECT event_id, stage, {_case('stage', labels.JOB_STAGES)} AS stage_name, import_stage_name, "
    f"coalesce(given, CAST({_case('stage', labels.STAGE_PROGRESS)} AS DOUBLE)) AS displayed FROM e",
    "image_rectangles": f"WITH {r.SQL_BLOCKS}, s AS (SELECT *, CAST(l_partkey % 40 * 50 AS DOUBLE) AS iw, "
    "CAST(l_partkey % 40 * 50 + 200 AS DOUBLE) AS ih FROM blocks) "
    f"SELECT page_id, {_ORD}, CASE WHEN iw > 0 THEN x * iw ELSE 0 END AS px, "
    "CASE WHEN iw > 0 THEN (1 - y - h) * ih ELSE 0 END AS py, CASE WHEN iw > 0 THEN w * iw ELSE 0 END AS pw, "
    "CASE WHEN iw > 0 THEN h * ih ELSE 0 END AS ph FROM s",
    "normalized_rectangles": f"WITH {r.SQL_BLOCKS}, s AS (SELECT *, CAST(l_partkey % 40 * 50 AS DOUBLE) AS iw, "
    "CAST(l_partkey % 40 * 50 + 200 AS DOUBLE) AS ih FROM blocks) "
    f"SELECT page_id, {_ORD}, CASE WHEN iw > 0 THEN x * 1000 / iw ELSE 0 END AS nx, "
    "CASE WHEN iw > 0 THEN 1 - y * 1000 / ih - h * 1000 / ih ELSE 0 END AS ny, "
    "CASE WHEN iw > 0 THEN w * 1000 / iw ELSE 0 END AS nw, CASE WHEN iw > 0 THEN h * 1000 / ih ELSE 0 END AS nh FROM s",
    "crop_plan": f"""
WITH s AS (SELECT l_orderkey AS page_id, {_ORD}, CAST(CAST(l_quantity * 40 AS INTEGER) AS DOUBLE) AS w,
                  floor(l_extendedprice / 20) AS h FROM lineitem),
c AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN CAST(least(6, greatest(3, ceil(greatest(w, h) / least(w, h) * 2))) AS INTEGER)
                     ELSE 3 END AS crop_count FROM s),
i AS (SELECT *, CAST(unnest(range(crop_count)) AS INTEGER) AS crop_index FROM c),
l AS (SELECT *, CAST(1 AS DOUBLE) / (1 + CAST(0.8 AS DOUBLE) * (crop_count - 1)) AS len FROM i),
o AS (SELECT *, least(crop_index * (len * CAST(0.8 AS DOUBLE)), 1 - len) AS origin FROM l),
q AS (SELECT *, CASE WHEN h >= w THEN 0 ELSE origin END AS cx, CASE WHEN h >= w THEN origin ELSE 0 END AS cy,
             CASE WHEN h >= w THEN 1 ELSE len END AS cw, CASE WHEN h >= w THEN len ELSE 1 END AS ch FROM o),
p AS (SELECT *, CAST(greatest(floor(cx * w), 0) AS INTEGER) AS l1, CAST(greatest(floor(cy * h), 0) AS INTEGER) AS t1,
             CAST(least(ceil(cx * w + cw * w), w) AS INTEGER) AS r1, CAST(least(ceil(cy * h + ch * h), h) AS INTEGER) AS b1
      FROM q)
SELECT page_id, {_ORD}, crop_count, crop_index, round(cx, 9) AS crop_x, round(cy, 9) AS crop_y, round(cw, 9) AS crop_w,
       round(ch, 9) AS crop_h, l1 AS left_px, t1 AS top_px, r1 - l1 AS width_px, b1 - t1 AS height_px FROM p""",
    "retry_plan": """
WITH c AS (SELECT event_id, [200,400,404,408,409,425,429,500,502,503,504][CAST(event_id % 11 + 1 AS INTEGER)] AS status,
                  CAST(user_id % 7 AS INTEGER) AS attempt,
                  CASE WHEN event_id % 4 = 0 THEN value - CAST(5 AS DOUBLE) END AS retry_after FROM events),
k AS (SELECT *, status IN (408,409,425,429,500,502,503,504) AND attempt < 3 AS retryable FROM c)
SELECT *, CASE WHEN retryable THEN least(CASE WHEN retry_after IS NOT NULL THEN greatest(retry_after, 0) ELSE pow(2, attempt) END, 30) END AS delay_seconds
FROM k""",
}
