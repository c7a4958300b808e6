from __future__ import annotations

import datetime
import json

from quire.plans import flows

T0 = datetime.datetime(2024, 1, 1)


def test_edits_are_found_and_old_text_is_not(spark):
    documents = spark.createDataFrame(
        [("d", "Notes", "pdf", T0)], "document_id string, title string, document_type string, updated_at timestamp"
    )
    pages = spark.createDataFrame([("d", "p", 1, "before")], "document_id string, page_id string, page_number int, text string")
    edits = spark.createDataFrame([("p", "corrected by hand", T0)], "page_id string, new_text string, changed_at timestamp")
    assert [r.page_id for r in flows.search_library(documents, pages, edits, "corrected").collect()] == ["p"]
    assert flows.search_library(documents, pages, edits, "before").collect() == []


def test_responses_to_sources(spark):
    bodies = [
        ("a", json.dumps({"pages": [{"markdown": "one"}, {"markdown": "# two"}]})),
        ("b", json.dumps({"pages": [{"markdown": "alone"}]})),
        ("c", "{broken"),
    ]
    responses = spark.createDataFrame(bodies, "job_id string, body string")
    manifests = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "job_id string, page_count int")
    sources, wrong, quarantine = flows.responses_to_sources(responses, manifests)
    rows = sources.collect()
    assert [r.job_id for r in rows] == ["a"] and "page-break" in rows[0].markdown
    assert [r.job_id for r in wrong.collect()] == ["b"] and [r.job_id for r in quarantine.collect()] == ["c"]
    published = flows.publish_sources(sources.selectExpr("job_id AS doc_id", "markdown")).first()
    assert '<h1 id="section-1">two</h1>' in published.html and "\\clearpage" in published.latex


def test_contract_is_complete():
    import __spark_entry__ as contract

    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries)
    import catalog

    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(queries)


def test_flagship_returns_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 20
