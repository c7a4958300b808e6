from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from quire.functions import assets
from quire.operators import ingest, jobs

T0 = datetime.datetime(2024, 1, 1)


def responses(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "job_id int, body string")


def test_ocr_pages_and_assets(spark):
    body = {
        "pages": [
            {
                "markdown": "# Page\n\n![diagram](figure one)",
                "images": [
                    {"id": "figure one", "image_base64": "data:image/png;base64,AAAA"},
                    {"id": "../second figure", "image_base64": "data:image/jpeg;base64,AAAA"},
                ],
            }
        ]
    }
    parsed, bad = ingest.parse_responses(responses(spark, body), "job_id")
    found = ingest.ocr_assets(parsed, "job_id")
    rows = found.orderBy("image_index").collect()
    assert [r.local_name for r in rows] == ["page-001-figure-one.png", "page-001-second-figure.jpg"]
    assert not any(".." in r.local_name or "/" in r.local_name for r in rows)
    text = ingest.ocr_pages(parsed, "job_id").first().markdown
    assert all(text.count(f"assets/{r.local_name}") == 1 for r in rows)
    assert bad.count() == 0


def test_malformed_responses_are_kept_apart(spark):
    parsed, bad = ingest.parse_responses(responses(spark, "{oops", {"pages": 3}, {"pages": [1]}, {"pages": []}), "job_id")
    assert [r.job_id for r in parsed.collect()] == [3]
    assert {r.job_id: r.body for r in bad.collect()}[0] == "{oops"


def test_asset_names_in_turn(spark):
    """Repeats, names that already look suffixed, odd members and undecodable payloads."""
    ids = ["a", "a-2", "a", "a", 5, None, "a-2"]
    images = [{"id": i, "base64": "AAAA"} for i in ids]
    images += [{"id": "skip"}, {"name": "n", "base64": "abc"}, {"name": "ok", "image_id": "z", "base64": "x,AA=="}]
    plain = [{"id": "b", "base64": "AAAA"}, {"id": "b", "base64": "AAAA"}]
    body = {"pages": [{"markdown": 3, "images": images}, {"images": plain}, {"markdown": "m", "images": [1]}]}
    parsed, _ = ingest.parse_responses(responses(spark, body, {"pages": [{"images": plain}]}), "job_id")
    found = ingest.ocr_assets(parsed, "job_id")
    rows = found.filter("job_id = 0").orderBy("page_index", "image_index").collect()
    assert [r.local_name for r in rows] == [
        "page-001-a.png", "page-001-a-2.png", "page-001-a-3.png", "page-001-a-4.png", "page-001-figure-5.png",
        "page-001-figure-6.png", "page-001-a-2-2.png", "page-001-ok.png", "page-002-b.png", "page-002-b-2.png",
    ]
    assert [r.local_name for r in found.filter("job_id = 1").orderBy("image_index").collect()] == [
        "page-001-b.png", "page-001-b-2.png",
    ]


def test_asset_name_rules(spark):
    df = spark.createDataFrame([("img-0.jpeg",), ("../x y//z",), ("é_特",), ("...",), ("q" * 99,)], "n string")
    got = [r.v for r in df.select(assets.sanitize_asset_name(F.col("n")).alias("v")).collect()]
    assert got == ["img-0-jpeg", "x-y-z", "é_特", "figure", "q" * 80]


def test_completions(spark):
    good = {"choices": [{"message": {"content": " hi\n"}}], "usage": {"prompt_tokens": 3, "total_tokens": None}}
    cases = [
        good,
        {"choices": [{"message": {"content": "x"}}]},
        {"choices": [{"message": {"content": "  "}}]},
        {"choices": []},
        {"choices": [{"message": {"content": 5}}]},
        {"choices": [{"message": {"content": "x"}}], "usage": {"prompt_tokens": "3"}},
        "{broken",
    ]
    ok, bad = ingest.parse_completions(responses(spark, *cases))
    rows = {r.job_id: r for r in ok.collect()}
    assert set(rows) == {0, 1} and {r.job_id for r in bad.collect()} == {2, 3, 4, 5, 6}
    assert rows[0].text == "hi" and rows[0].usage.prompt_tokens == 3 and rows[0].usage.total_tokens is None
    assert rows[1].usage is None


def test_languages(spark):
    def pick(requested, supported):
        columns = [F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in (requested, supported)]
        return spark.range(1).select(ingest.negotiate_languages(*columns).alias("v")).first().v

    assert pick(["en", "zh"], []) == ["en", "zh"]
    assert pick(["en", "zh"], ["zh", "fr", "en"]) == ["en", "zh"]
    assert pick(["en"], ["fr", "de"]) == ["fr"]


def test_resume_plan(spark):
    pages = spark.createDataFrame([("j", 0, 1600, 2200)], "job_id string, page_index int, width int, height int")
    expected = jobs.plan_requests(pages)
    assert sorted(r.cache_path for r in expected.collect()) == [
        "vision-page-001-crop-001.json", "vision-page-001-crop-002.json", "vision-page-001-crop-003.json",
        "vision-page-001-overview.json",
    ]
    cached = expected.filter("kind = 'overview' OR crop_index = 1")
    assert sorted(r.crop_index for r in jobs.pending_work(expected, cached).collect()) == [0, 2]
    assert sorted(r.crop_index for r in jobs.reusable_work(expected, cached).collect()) == [-1, 1]
    row = jobs.batch_completeness(expected, cached).first()
    assert (row.completed, row.total, row.ready) == (2, 4, False)


def test_state_rules(spark):
    rows = [
        ("j", 1, T0, "refining", None, 4, 0.5, "page 1"),
        ("j", 2, T0 + datetime.timedelta(1), "failed", "boom", None, None, None),
        ("k", 3, T0, "rendering", None, None, 7.0, None),
    ]
    schema = (
        "job_id string, seq long, at timestamp, stage string, failure_message string, uncertain_count int, "
        "stage_progress double, stage_detail string"
    )
    got = {r.job_id: r for r in jobs.current_state(spark.createDataFrame(rows, schema)).collect()}
    j, k = got["j"], got["k"]
    assert (j.stage, j.failure_message, j.uncertain_count, j.stage_detail, j.displayed_progress) == ("failed", "boom", 4, None, 0)
    assert (k.stage_progress, k.displayed_progress, k.uncertain_count) == (1.0, 1.0, 0)


def test_assemble_and_split_parts(spark):
    pages = spark.createDataFrame([("j", i, f"page {i}") for i in range(5)], "job_id string, page_index int, final_markdown string")
    parts = jobs.assemble_markdown(pages, part_pages=2).orderBy("part").collect()
    whole = jobs.PAGE_BREAK.join(r.markdown for r in parts)
    assert whole == jobs.PAGE_BREAK.join(f"page {i}" for i in range(5))
    one = spark.createDataFrame([("j", whole.replace(jobs.PAGE_BREAK, "\n <!-- page-break --> \n", 1))], "job_id string, markdown string")
    assert [r.markdown for r in jobs.split_pages(one).orderBy("page_index").collect()] == [f"page {i}" for i in range(5)]


def test_page_mismatches(spark):
    manifests = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 0)], "job_id string, page_count int")
    pages = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("x", 0)], "job_id string, page_index int")
    assert {r.job_id for r in jobs.page_mismatches(manifests, pages).collect()} == {"b", "c", "x"}


def test_effective_source(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    edited = spark.createDataFrame([("a", "edited")], "job_id string, source string")
    machine = spark.createDataFrame([("a", "machine"), ("b", "machine")], "job_id string, source string")
    got = {r.job_id: r.source for r in jobs.effective_source(ids, edited, machine).collect()}
    assert got == {"a": "edited", "b": "machine", "c": ""}


def test_repeated_edits_follow_each_other(spark):
    current = spark.createDataFrame([("a", "one"), ("b", "kept")], "job_id string, source string")
    edits = spark.sql("""select * from values ('a', 'three', timestamp '2024-01-02 00:00:00'), ('a', ' two ', timestamp '2024-01-01 00:00:00'),
        ('b', '  ', timestamp '2024-01-01 00:00:00'), ('c', 'new', timestamp '2024-01-01 00:00:00') t(job_id, source, edited_at)""")
    history, now = jobs.edit_history(current, edits)
    assert [r.source for r in history.orderBy("path").collect()] == ["one", "two"]
    assert {(r.job_id, r.source) for r in now.collect()} == {("a", "three"), ("b", "kept"), ("c", "new")}


def test_repeated_and_missing_pages_are_found(spark):
    manifests = spark.createDataFrame([("gap", 3), ("good", 2), ("none", 1)], "job_id string, page_count int")
    pages = spark.createDataFrame([("gap", 0), ("gap", 0), ("gap", 2), ("good", 0), ("good", 1)], "job_id string, page_index int")
    assert {r.job_id for r in jobs.page_mismatches(manifests, pages).collect()} == {"gap", "none"}


def test_parts_split_back_to_their_pages(spark):
    pages = spark.createDataFrame([("j", i, f"page {i}") for i in range(5)], "job_id string, page_index int, final_markdown string")
    back = jobs.split_pages(jobs.assemble_markdown(pages, part_pages=2), part_pages=2)
    assert sorted((r.page_index, r.markdown) for r in back.collect()) == [(i, f"page {i}") for i in range(5)]


def test_unique_names_against_the_rule(spark):
    import random

    def first_free(names):
        used, out = set(), []
        for name in names:
            stem, _, extension = name.rpartition(".")
            turn, candidate = 2, name
            while candidate in used:
                candidate, turn = f"{stem}-{turn}.{extension}", turn + 1
            used.add(candidate)
            out.append(candidate)
        return out

    rng = random.Random(3)
    pool = ["a.png", "a-2.png", "a-3.png", "a-2-2.png", "a.jpg", "a-2.jpg", "b.png", "a.b.png", "a-.png", "a--2.png"]
    cases = [[rng.choice(pool) for _ in range(rng.randint(0, 14))] for _ in range(300)] + [["x.png"] * 200]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, names array<string>")
    found = {r.i: r.found for r in df.select("i", ingest.unique_names(F.col("names")).alias("found")).collect()}
    assert found == {i: first_free(names) for i, names in enumerate(cases)}


def test_responses_need_no_python_worker(spark):
    df = spark.createDataFrame([(1, "{}")], "job_id int, body string")
    parsed, _ = ingest.parse_responses(df, "job_id")
    for frame in (ingest.ocr_assets(parsed, "job_id"), ingest.ocr_pages(parsed, "job_id")):
        assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_cached_pages_out_of_place(spark):
    rows = [
        ("j", "refinement-page-001.json", 0), ("j", "refinement-page-002.json", 0), ("j", "cache/refinement-page-1000.json", 999),
        ("k", "refinement-page-003.json", None), ("k", "vision-page-001-overview.json", 7), ("k", "xrefinement-page-001.json", 7),
    ]
    found = jobs.cached_page_mismatches(spark.createDataFrame(rows, "job_id string, path string, page_index int")).collect()
    assert sorted(map(tuple, found)) == [("j", "refinement-page-002.json", 1, 0), ("k", "refinement-page-003.json", 2, None)]


def test_edit_history_of_a_hot_job(spark, hot_limits):
    edits = [("a", T0 + datetime.timedelta(minutes=i), f"t{i}") for i in range(11)] + [("b", T0, "only"), ("a", T0, " ")]
    current = spark.createDataFrame([("a", "first")], "job_id string, source string")
    history, now = jobs.edit_history(current, spark.createDataFrame(edits, "job_id string, edited_at timestamp, source string"))
    assert [r.source for r in history.orderBy("path").collect()] == ["first", *[f"t{i}" for i in range(10)]]
    assert {(r.job_id, r.source) for r in now.collect()} == {("a", "t10"), ("b", "only")}
