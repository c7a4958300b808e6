"""Ingestion of recognition and completion responses (nested JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assets import data_uri_payload, image_extension, is_base64, sanitize_asset_name
from ..functions.text import trim_all


def _member(value: Column, *names: str) -> Column:
    """First member that is present, even as JSON null; SQL null when all are absent."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{name}", "variant") for name in names])


def _is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _string(value: Column) -> Column:
    """Text of a JSON string; null for a number, null or nested value."""
    return F.when(_is_string(value), F.try_variant_get(value, "$", "string"))


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _objects(value: Column, path: str) -> Column:
    """Array member whose elements are all objects; null otherwise."""
    items = F.try_variant_get(value, path, "array<variant>")
    return F.when(F.forall(items, lambda item: F.coalesce(_is_object(item), F.lit(False))), items)


def parse_responses(responses: DataFrame, key: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split OCR responses into (parsed, quarantine).

    A response whose JSON is broken or lacks an array of page objects is
    malformed and keeps its raw body. Members are read as variants because a
    number in place of a name must not turn into text. ``parsed`` holds one row
    per response with its ``pages`` (Markdown and decodable images) and the
    ``local_names`` of the images; it is built in one pass without a shuffle.
    """
    root = responses.withColumn("_pages", _objects(F.try_parse_json(F.col(body)), "$.pages"))
    good = F.col("_pages").isNotNull()
    pages = root.filter(good).select(key, F.transform("_pages", _page).alias("pages"))
    # names begin with the number of their page, so only names of one page can be equal
    names = F.transform(
        "pages", lambda page: F.transform(F.array(F.transform(page["images"], lambda image: image["proposed"])), unique_names)[0]
    )
    return pages.withColumn("local_names", names), root.filter(~good).drop("_pages")


def _page(page: Column, page_index: Column) -> Column:
    """Markdown and usable images of one page object."""
    images = F.transform(_objects(page, "$.images"), lambda image, i: _image(image, i, page_index))
    usable = F.filter(images, lambda image: is_base64(image["payload"]))
    return F.struct(
        F.coalesce(_string(_member(page, "markdown")), F.lit("")).alias("markdown"),
        F.coalesce(usable, F.array().cast(_IMAGES)).alias("images"),
    )


_IMAGES = "array<struct<image_index:int,original_name:string,payload:string,proposed:string>>"


def _image(image: Column, image_index: Column, page_index: Column) -> Column:
    uri = _string(_member(image, "image_base64", "base64"))
    name = F.coalesce(
        _string(_member(image, "id", "name", "image_id")),
        F.concat(F.lit("figure-"), (image_index + 1).cast("string")),
    )
    proposed = F.format_string(
        "page-%03d-%s.%s", page_index + 1, sanitize_asset_name(name), image_extension(uri)
    )
    return F.struct(
        image_index.alias("image_index"), name.alias("original_name"), data_uri_payload(uri).alias("payload"),
        proposed.alias("proposed"),
    )


def unique_names(names: Column) -> Column:
    """First free name for each of an array of file names, in order.

    The first to propose a name gets it; later ones try -2, -3, … in front of the extension until a name is free. Only a
    name that was proposed itself can stand in the way of a numbered one, so the number to begin with is known from the
    earlier renames. Arrays without repeats, nearly all, are passed through.
    """

    def step(used: Column, name: Column) -> Column:
        stem = F.regexp_extract(name, r"(?s)\A(.*)\.[^.]*\z", 1)
        extension = F.substring_index(name, ".", -1)
        before = F.zip_with(used, F.slice(names, F.lit(1), F.size(used)), lambda own, asked: (asked == name) & (own != name))
        first = F.size(F.filter(before, lambda renamed: renamed)) + 2
        rivals = F.size(F.filter(names, lambda other: F.startswith(other, F.concat(stem, F.lit("-")))))
        numbered = F.transform(
            F.sequence(first, first + rivals), lambda n: F.concat(stem, F.lit("-"), n.cast("string"), F.lit("."), extension)
        )
        free = F.get(F.filter(numbered, lambda candidate: ~F.array_contains(used, candidate)), F.lit(0))
        return F.array_append(used, F.when(F.array_contains(used, name), free).otherwise(name))

    renamed = F.aggregate(names, F.array().cast("array<string>"), step)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(renamed)


def ocr_assets(parsed: DataFrame, key: str) -> DataFrame:
    """Embedded images: one row per decodable image with its local file name.

    Images without a usable payload are skipped but still count for ``figure-n``.
    """
    pages = parsed.select(key, F.posexplode("pages").alias("page_index", "_page"), "local_names")
    zipped = F.zip_with(
        F.col("_page.images"), F.get(F.col("local_names"), F.col("page_index")),
        lambda image, name: F.struct(image.alias("image"), name.alias("name")),
    )
    rows = pages.select(key, "page_index", F.explode(zipped).alias("_z"))
    return rows.select(
        key, "page_index",
        F.col("_z.image.image_index").alias("image_index"),
        F.col("_z.image.original_name").alias("original_name"),
        F.col("_z.name").alias("local_name"),
        F.try_to_binary(F.col("_z.image.payload"), F.lit("base64")).alias("data"),
    )


def link_assets(markdown: Column, images: Column, local_names: Column) -> Column:
    """Point figure links of a page at local files; append links that are missing.

    Replacement is sequential: a later name may match inside an earlier path.
    """
    pairs = F.zip_with(
        images, local_names,
        lambda image, name: F.struct(
            image["original_name"].alias("name"), F.concat(F.lit("assets/"), name).alias("path")
        ),
    )

    def step(text: Column, pair: Column) -> Column:
        swapped = F.replace(text, pair["name"], pair["path"])
        return F.transform(
            F.array(swapped),
            lambda s: F.when(F.contains(s, pair["path"]), s).otherwise(
                F.concat(s, F.lit("\n\n![Extracted figure]("), pair["path"], F.lit(")"))
            ),
        )[0]

    return trim_all(F.aggregate(pairs, markdown, step))


def ocr_pages(parsed: DataFrame, key: str) -> DataFrame:
    """(key, page_index, markdown) with figure links rewritten to local files."""
    pages = parsed.select(key, F.posexplode("pages").alias("page_index", "_page"), "local_names")
    names = F.get(F.col("local_names"), F.col("page_index"))
    return pages.select(
        key, "page_index", link_assets(F.col("_page.markdown"), F.col("_page.images"), names).alias("markdown")
    )


def parse_completions(responses: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split chat completions into (text and token usage, quarantine).

    Malformed: broken JSON, a choice without text content, token counts that are
    not whole numbers, or a first choice that is blank.
    """
    root = responses.withColumn("_root", F.try_parse_json(F.col(body)))
    choices = F.try_variant_get("_root", "$.choices", "array<variant>")
    usage = _member(F.col("_root"), "usage")
    counts = ("prompt_tokens", "completion_tokens", "total_tokens")

    def whole(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(usage, f"$.{name}", "variant"))
        return F.coalesce(kind.isin("BIGINT", "VOID"), F.lit(True))

    texts = F.transform(choices, lambda c: _string(F.try_variant_get(c, "$.message.content", "variant")))
    typed_usage = F.coalesce(_is_object(usage) | F.is_variant_null(usage), F.lit(True))
    for name in counts:
        typed_usage = typed_usage & whole(name)
    text = trim_all(F.get(texts, F.lit(0)))
    good = F.coalesce(F.forall(texts, lambda x: x.isNotNull()) & typed_usage & (text != ""), F.lit(False))
    tokens = F.struct(*[F.try_variant_get(usage, f"$.{n}", "int").alias(n) for n in counts])
    parsed = (
        root.withColumn("_good", good)
        .withColumn("text", text)
        .withColumn("usage", F.when(_is_object(usage), tokens))
    )
    return (
        parsed.filter("_good").drop("_root", "_good", body),
        parsed.filter("NOT _good").drop("_root", "_good", "text", "usage"),
    )


def clean_observations(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Recogniser output to blocks: best candidate, trimmed, empties dropped.

    ``observations`` is array<struct<candidates:array<struct<text,confidence>>,x,y,w,h>>
    with candidates best first; the original index is kept as ``reading_order``.
    """
    rows = observations.select(*keys, F.posexplode("observations").alias("reading_order", "_o"))
    best = F.get(F.col("_o.candidates"), F.lit(0))
    return rows.select(
        *keys,
        trim_all(best["text"]).alias("text"),
        best["confidence"].alias("confidence"),
        *[F.col(f"_o.{c}").alias(c) for c in ("x", "y", "w", "h")],
        "reading_order",
    ).filter("text <> ''")


def best_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Top-1 candidate per observation from flat rows (rank 0 is best)."""
    window = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), F.col("candidate_index"))
    return candidates.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def negotiate_languages(requested: Column, supported: Column) -> Column:
    """Requested languages that are supported, in request order, with fallbacks.

    All of them when support is unknown; the first supported one when none fit.
    """
    usable = F.filter(requested, lambda lang: F.array_contains(supported, lang))
    return (
        F.when(F.coalesce(F.size(supported), F.lit(0)) <= 0, requested)
        .when(F.size(usable) > 0, usable)
        .otherwise(F.slice(supported, 1, 1))
    )
