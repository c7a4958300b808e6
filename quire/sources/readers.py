"""Sources: manifests, responses, binary files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_SCHEMA = """
    version int, id string, title string, stage string, createdAt timestamp, updatedAt timestamp,
    pages array<struct<id:string, index:int, sourcePath:string, pixelWidth:int, pixelHeight:int>>,
    uncertainCount int,
    artifacts struct<markdown:string, latex:string, pdf:string, html:string, facsimileLatex:string,
                     facsimilePDF:string, facsimileHTML:string, archive:string>,
    failureMessage string, rendererDescription string, stageProgress double, stageDetail string
"""
#: Wanted keys in at most this many files are read by naming the files.
FEW_FILES = 200
#: Columns of a packed index besides the keys.
_PLACE = ("_slice", "_file", "_from", "_bytes")
#: Members a manifest must have; the others may be absent in older files.
REQUIRED = ["version", "id", "title", "stage", "createdAt", "updatedAt", "pages", "uncertainCount"]


def read_manifests(spark: SparkSession, pattern: str, below: str | None = None) -> DataFrame:
    """One row per readable manifest file; broken or incomplete ones are skipped.

    ``below``: names of the files, looked for in all folders below ``pattern``. Tasks list the folders then, where a
    pattern over folders is resolved by the driver one by one.
    """
    reader = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED")
    if below is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", below)
    rows = reader.json(pattern)
    complete = F.lit(True)
    for name in REQUIRED:
        complete = complete & F.col(name).isNotNull()
    return rows.filter(complete)


def parse_manifests(texts: DataFrame, text: str = "text") -> DataFrame:
    """Manifests from their texts, as :func:`read_manifests` reads them from files; broken or incomplete ones are skipped."""
    body = F.from_json(F.col(text), f"{MANIFEST_SCHEMA}, _corrupt_record string").alias("_manifest")
    rows = texts.select(body).select("_manifest.*").filter("_corrupt_record is null")
    complete = reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in REQUIRED])
    return rows.filter(complete).drop("_corrupt_record")


def list_jobs(manifests: DataFrame) -> DataFrame:
    """Manifests, newest update first."""
    return manifests.orderBy(F.col("updatedAt").desc(), F.col("id"))


def read_json_bodies(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, body): each response file as one JSON text."""
    return spark.read.option("wholetext", True).text(pattern).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")
    )


def read_binary(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a folder: path relative to it, length, time and content."""
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    )
    base = root.rstrip("/").split(":", 1)[-1] + "/"
    return rows.withColumn("path", F.substring_index(F.col("path"), base, -1))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """File listing; the content column is pruned, so nothing is read."""
    return read_binary(spark, root, glob).select("path", "length", "modificationTime")


def read_packed(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(keys, part, text): texts written by ``sinks.write_packed``; the parts of a key in order are its whole text.

    ``wanted`` (keys) picks keys. The index is read first; where the wanted keys stand in few files, only those are opened.
    """
    index = spark.read.parquet(f"{path}/index")
    keys = [c for c in index.columns if c not in _PLACE]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(f"{path}/data").select("content", "_slice", "_file")
    if wanted is not None:
        index = index.join(wanted.select(*keys).distinct(), keys, "left_semi")
        few = index.select("_slice", "_file").distinct().limit(FEW_FILES + 1).collect()
        if len(few) <= FEW_FILES:
            tests = [(F.col("_slice") == row[0]) & (F.col("_file") == row[1]) for row in few]
            files = files.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))
    order = Window.partitionBy(*keys).orderBy("_slice", "_file")
    place = [F.col(c).cast("int").alias(c) for c in ("_from", "_bytes")]
    entry = F.struct(*keys, (F.row_number().over(order) - 1).alias("part"), *place)
    # one row per file meets the file; what it lists is bounded by the size of a file
    listed = index.select("_slice", "_file", entry.alias("_entry")).groupBy("_slice", "_file").agg(F.collect_list("_entry").alias("_entries"))
    pieces = F.transform(
        F.array("content"),  # bound once: a file is not copied for each of its entries
        lambda content: F.transform(
            "_entries",
            lambda e: F.struct(
                *[e[k].alias(k) for k in (*keys, "part")], F.decode(F.substring(content, e["_from"] + 1, e["_bytes"]), "UTF-8").alias("text")
            ),
        ),
    )[0]
    return files.join(listed, ["_slice", "_file"]).select(F.inline(pieces))
