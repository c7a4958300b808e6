from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import labels, names, paging

ID = "5B2C4D6E-1111-2222-3333-444455556666"
AT = datetime.datetime(2024, 3, 5, 7, 8, 9, 12000)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_file_names(spark):
    assert value(spark, names.source_file_name(F.lit(ID), F.lit("pdf"))) == f"doc_{ID.lower()}.pdf"
    assert value(spark, names.source_file_name(F.lit(ID), F.lit("camera"))) == f"doc_{ID.lower()}.jpg"
    for number, padded in ((1, "0001"), (10, "0010"), (100, "0100"), (12345, "12345"), (-4, "0000")):
        got = value(spark, names.page_image_name(F.lit(ID), F.lit(number)))
        assert got == f"page_{ID.lower()}_{padded}.jpg"


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("  Meeting/Notes:  2026 ", "Meeting Notes 2026"),
        ("  a \n b\t\tc ", "a b c"),
        ("a" * 200, "a" * 80),
        (" / : ", ""),
    ],
)
def test_sanitized_titles(spark, raw, expected):
    assert value(spark, names.sanitize_title(F.lit(raw))) == expected


def test_title_length_option(spark):
    assert len(value(spark, names.sanitize_title(F.lit("a" * 200), 20))) == 20


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("  Meeting/Notes:  2026 .pdf", "Meeting Notes 2026"),
        ("scan.final.jpg", "scan.final"),
        (" / .pdf", "PDF 2024-03-05 07:08"),
        (None, "PDF 2024-03-05 07:08"),
    ],
)
def test_title_from_file_name(spark, name, expected):
    column = names.title_from_file_name(F.lit(name).cast("string"), F.lit("pdf"), F.lit(AT))
    assert value(spark, column) == expected


def test_path_rules(spark):
    assert value(spark, names.archive_path(F.lit("./a\\b//../c.md"))) == "a/b/c.md"
    assert value(spark, names.history_stamp(F.lit(AT))) == "20240305-070809-012"
    for path, safe in (("pages/a.jpg", True), ("/etc", False), ("a/../b", False)):
        assert value(spark, names.is_safe_path(F.lit(path))) is safe
    for path, kept in (
        ("document.md", True), ("assets/figure.png", True), ("x/ProviderKeys.plist", False), (".git/a", False),
        ("artifacts.zip", False), ("a/..b", False), ("./a.md", True),
    ):
        assert value(spark, names.is_exportable(F.lit(path), ["artifacts.zip"])) is kept


def test_natural_order(spark):
    paths = ["Page 10.md", "page 2.md", "page 1.md", "a" + "9" * 30, "a" + "1" + "0" * 30]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.p for r in df.orderBy(names.natural_key(F.col("p"))).collect()]
    assert got == ["a" + "9" * 30, "a" + "1" + "0" * 30, "page 1.md", "page 2.md", "Page 10.md"]


def test_page_numbers(spark):
    clamp = lambda p, n: value(spark, paging.clamp_page(F.lit(p), F.lit(n)))
    assert [clamp(p, 3) for p in (0, -7, 2, 9)] == [1, 1, 2, 3]
    assert clamp(1, 0) is None
    for done, count, share in ((0, 4, 0), (1, 4, 0.25), (4, 4, 1), (9, 4, 1), (1, 0, 0)):
        assert value(spark, paging.completion(F.lit(done), F.lit(count))) == share
    rows = spark.range(1, 51).select("id", paging.page_number(paging.page_index(F.col("id"))).alias("back")).collect()
    assert all(r.id == r.back for r in rows)


def test_progress(spark):
    assert value(spark, paging.displayed_progress(F.lit(None).cast("double"), F.lit("refining"))) == 0.62
    assert value(spark, paging.displayed_progress(F.lit(None).cast("double"), F.lit("failed"))) == 0
    assert value(spark, paging.refinement_progress(F.lit(0), F.lit(2), F.lit(1.0))) == pytest.approx(0.735)


def test_retries(spark):
    retry = lambda s, a: value(spark, paging.is_retryable(F.lit(s), F.lit(a)))
    assert retry(429, 0) and retry(503, 2) and not retry(503, 3) and not retry(404, 0)
    delay = lambda a, after: value(spark, paging.retry_delay(F.lit(a), F.lit(after).cast("double")))
    assert [delay(2, None), delay(9, None), delay(0, -3), delay(0, 99), delay(1, 7)] == [4, 30, 0, 30, 7]


def test_enumerations(spark):
    assert value(spark, labels.decode_type(F.lit("fax"))) == "photo"
    assert value(spark, labels.decode_status(F.lit(None).cast("string"))) == "pending"
    assert value(spark, labels.job_stage_name(F.lit("baseOCR"))) == "Base OCR"


def test_error_texts(spark):
    df = spark.createDataFrame([("fileMissing", "a.pdf"), ("processingCancelled", None)], "kind string, detail string")
    got = {r.kind: r.stored_text for r in labels.describe_errors(df).collect()}
    assert got["fileMissing"] == "“a.pdf” is missing from local storage. Delete this document and import it again."
    assert got["processingCancelled"] == "Processing was cancelled."
