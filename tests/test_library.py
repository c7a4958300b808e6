from __future__ import annotations

import datetime

import pytest

from quire.operators import library

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    documents = spark.createDataFrame(
        [("f", "First", "photo", T0, T0, "f.jpg"), ("s", "Second", "pdf", T0 + datetime.timedelta(1), T0, "s.pdf")],
        "document_id string, title string, document_type string, created_at timestamp, updated_at timestamp, "
        "local_file_name string",
    )
    pages = spark.createDataFrame(
        [("f", "f1", 1, "before", "f.jpg"), ("s", "s1", 1, " \n ", "s1.jpg"), ("s", "s2", 2, "特征值", "s2.jpg")],
        "document_id string, page_id string, page_number int, text string, image_file_name string",
    )
    blocks = pages.selectExpr("page_id", "explode(sequence(0L, 2L)) AS ordinal")
    return documents, pages, blocks


def doomed(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "document_id string")


def test_cascade_delete(spark, store):
    assert [x.count() for x in library.cascade_delete(*store, doomed(spark, "s"))] == [1, 1, 3]
    assert [x.count() for x in library.cascade_delete(*store, doomed(spark, "f"))] == [1, 2, 6]
    assert [x.count() for x in library.cascade_delete(*store, doomed(spark, "f", "s"))] == [0, 0, 0]


def test_delete_positions(spark, store):
    positions = spark.createDataFrame([(1,), (7,)], "position long")
    assert [r.title for r in library.delete_positions(store[0], positions).collect()] == ["Second"]


def test_files_to_remove(spark, store):
    existing = spark.createDataFrame(
        [("Sources", "s.pdf"), ("Pages", "s1.jpg"), ("Sources", "s2.jpg"), ("Sources", "f.jpg")],
        "directory string, file_name string",
    )
    gone = library.files_to_remove(store[0], store[1], doomed(spark, "s"), existing).collect()
    assert {(r.directory, r.file_name) for r in gone} == {("Sources", "s.pdf"), ("Pages", "s1.jpg")}


def test_rename(spark, store):
    changes = spark.createDataFrame(
        [("f", "  New/Title  ", T0 + datetime.timedelta(9)), ("s", " / ", T0 + datetime.timedelta(9))],
        "document_id string, new_title string, changed_at timestamp",
    )
    got = {r.document_id: (r.title, r.updated_at) for r in library.rename(store[0], changes).collect()}
    assert got == {"f": ("New Title", T0 + datetime.timedelta(9)), "s": ("Second", T0)}


def test_edit_text(spark, store):
    edits = spark.createDataFrame(
        [("f1", "typo", T0), ("f1", "corrected by hand", T0 + datetime.timedelta(3))],
        "page_id string, new_text string, changed_at timestamp",
    )
    documents, pages = library.edit_text(store[0], store[1], edits)
    assert {r.page_id: r.text for r in pages.collect()}["f1"] == "corrected by hand"
    assert {r.document_id: r.updated_at for r in documents.collect()}["f"] == T0 + datetime.timedelta(3)


def test_replace_children(spark, store):
    fresh = spark.createDataFrame([("f1", 0)], "page_id string, ordinal long")
    rows = library.replace_children(store[2], fresh, "page_id", fresh).collect()
    assert sorted((r.page_id) for r in rows) == ["f1", "s1", "s1", "s1", "s2", "s2", "s2"]


def test_nested_parts_hold_every_page(spark, store):
    flat = library.flatten_library(store[0], store[1])
    rows = library.nest_pages(flat, part_pages=1).orderBy("document_id", "part").collect()
    assert [(r.document_id, r.part, [p.page_id for p in r.pages]) for r in rows] == [
        ("f", 0, ["f1"]), ("s", 0, ["s1"]), ("s", 1, ["s2"]),
    ]


@pytest.mark.parametrize(
    "texts",
    [
        ["  a\nb ", "c"],
        ["", " ", "x" * 119, "", "y "],
        ["", "x" * 130],
        ["abc", *[" "] * 300],
        ["abc", *[" "] * 300, "z"],
        ["abc" + " " * 300],
        ["abc" + " " * 300, "z"],
        [" ", "\n"],
    ],
)
def test_previews_against_brute_force(spark, texts):
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "document_id string, page_number int, text string")
    joined = " ".join(texts).replace("\n", " ").strip()
    want = joined[:120] + "…" if len(joined) > 120 else joined
    got = library.document_previews(pages).collect()
    assert [r.preview for r in got] == ([want] if want else [])


def test_listing_rows(spark, store):
    documents = store[0].selectExpr(
        "document_id", "title", "if(document_id = 'f', 'failed', 'completed') AS processing_status",
        "if(document_id = 'f', 'broken', null) AS processing_error",
    )
    got = {r.document_id: (r.page_label, r.detail_line) for r in library.listing_rows(documents, store[1]).collect()}
    assert got == {"f": ("1 page", "broken"), "s": ("2 pages", "特征值")}
