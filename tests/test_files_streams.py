from __future__ import annotations

import datetime
import json
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import archive, hooks, stats
from quire.sources import readers, sinks
from quire.streaming import streams

T0 = datetime.datetime(2024, 1, 1)


def otsu(values):
    """Threshold of plain values, restated from the definition."""
    best, best_bin = -1.0, 180
    for cut in range(256):
        low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
        if low and high:
            score = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
            if score > best * (1 + 1e-12):
                best, best_bin = score, cut
    return min(235, max(95, best_bin + 8))


def test_otsu(spark):
    groups = {"a": [10] * 5 + [200] * 4, "b": [130] * 3 + [180] * 9 + [140], "c": [7] * 4, "d": [250, 251, 252]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, bin int")
    got = {r.k: (r.threshold, r.total) for r in stats.otsu_threshold(stats.histogram(df, ["k"]), ["k"]).collect()}
    assert got == {k: (otsu(v), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_archive_manifest(spark, request, hot):
    if hot:
        request.getfixturevalue("hot_limits")
    names = [f"assets/page-{i}.md" for i in range(1, 13)] + ["keys/providerKEYS.txt", "artifacts.zip"]
    files = spark.createDataFrame([("j", n, n.encode() * 3) for n in names], "job_id string, path string, content binary")
    rows = archive.archive_manifest(files, ["artifacts.zip"], cap=500).orderBy("entry").collect()
    assert [r.archive_path for r in rows] == names[:12]
    total = 0
    for row in rows:
        data = row.archive_path.encode() * 3
        total += len(data) + 76 + 2 * len(row.archive_path)
        assert (row.crc32, row.size, row.running_bytes, row.over_cap) == (zlib.crc32(data), len(data), total, total > 500)


def manifest(**changes):
    body = {
        "version": 1, "id": "j", "title": "T", "stage": "baseOCR", "createdAt": "2024-01-01T00:00:00Z",
        "updatedAt": "2024-01-02T00:00:00Z", "uncertainCount": 0,
        "pages": [{"id": "p", "index": i, "sourcePath": f"pages/page-00{i + 1}.jpg"} for i in range(2)],
    }
    return {**body, **changes}


def test_manifests(spark, tmp_path):
    cases = {
        "a": json.dumps(manifest(id="a", stageProgress=0.5, stageDetail="x"), indent=1),
        "b": json.dumps(manifest(id="b", updatedAt="2024-02-02T00:00:00Z")),
        "c": "{broken",
        "d": json.dumps({"id": "d"}),
    }
    for name, text in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    rows = readers.list_jobs(readers.read_manifests(spark, f"{tmp_path}/*/manifest.json")).collect()
    assert [(r.id, r.stageProgress, r.stageDetail) for r in rows] == [("b", None, None), ("a", 0.5, "x")]
    assert [p.sourcePath for p in rows[0].pages] == ["pages/page-001.jpg", "pages/page-002.jpg"]


def test_manifests_from_texts(spark):
    cases = [json.dumps(manifest(id="a", stageProgress=0.5)), "{broken", json.dumps({"id": "d"}), None, json.dumps(manifest(id="e", version="x"))]
    texts = spark.createDataFrame([(c,) for c in cases], "text string")
    rows = readers.parse_manifests(texts).collect()
    assert [(r.id, r.stageProgress, len(r.pages)) for r in rows] == [("a", 0.5, 2)]


def test_binary_files(spark, tmp_path):
    (tmp_path / "assets").mkdir()
    (tmp_path / "assets" / "figure.png").write_bytes(b"\x01\x02")
    row = readers.read_binary(spark, str(tmp_path)).first()
    assert (row.path, bytes(row.content)) == ("assets/figure.png", b"\x01\x02")
    listing = readers.list_files(spark, str(tmp_path))
    assert [r.length for r in listing.collect()] == [2]
    bodies = readers.read_json_bodies(spark, str(tmp_path / "assets"))
    assert bodies.columns == ["path", "body"]


def test_artifacts_are_written_by_many_tasks(spark, tmp_path):
    rows = [(i % 40 if i else None, f"text {i}") for i in range(60)]
    sinks.write_text_artifacts(spark.createDataFrame(rows, "job_id int, text string").coalesce(1), str(tmp_path / "a"))
    files = list((tmp_path / "a").glob("job_id=*/*.txt"))
    assert len({f.name.split("-")[1] for f in files}) > 1
    assert len(files) == len({f.parent for f in files})  # equal keys stay in one file
    found = {f.parent.name.removeprefix("job_id="): sorted(f.read_text().splitlines()) for f in files}
    wanted = {}
    for key, text in rows:
        wanted.setdefault("__HIVE_DEFAULT_PARTITION__" if key is None else str(key), []).append(text)
    assert found == {key: sorted(texts) for key, texts in wanted.items()}


def test_manifests_below_a_folder(spark, tmp_path):
    texts = [(str(i), json.dumps(manifest(id=str(i))) if i else "{") for i in range(5)]
    sinks.write_text_artifacts(spark.createDataFrame(texts, "job_id string, text string"), str(tmp_path / "m"))
    found = readers.read_manifests(spark, str(tmp_path / "m"), "*.txt")
    assert sorted(row.id for row in found.collect()) == ["1", "2", "3", "4"]
    assert found.columns == readers.read_manifests(spark, str(tmp_path / "m/*/*.txt")).columns


def test_page_hook_may_drop_and_change_rows(spark):
    rows = [(page, i, (i * 7) % 5) for page in (None, 1, 2, 3) for i in range(6)]

    def top(page):
        assert list(page.index) == list(range(len(page))) and page["page"].nunique(dropna=False) == 1
        page["x"] = page["x"] + 1
        return page.sort_values("x", ascending=False, kind="stable").head(3)

    found = hooks.order_with(spark.createDataFrame(rows, "page int, i int, x int"), ["page"], ["i"], top)
    wanted = set()
    for page in (None, 1, 2, 3):
        best = sorted((r for r in rows if r[0] == page), key=lambda r: (-r[2], r[1]))[:3]
        wanted |= {(page, i, x + 1, n) for n, (_, i, x) in enumerate(best)}
    assert {(r.page, r.i, r.x, r.reading_order) for r in found.collect()} == wanted


@pytest.mark.parametrize("batch", [1, 3, 1000])
@pytest.mark.parametrize("places", [False, True])
def test_page_hook_gets_whole_pages_over_batches(spark, batch, places):
    sizes = {(None, None): 5, (None, 1): 1, ("a", None): 7, ("a", 1): 40, ("a", 2): 2, ("b", 1): 1, ("b", 2): 12, ("c", 3): 3}
    rows = [(a, b, i if i else None, i * 7 % 5) for (a, b), n in sizes.items() for i in range(n)]

    def order(page):
        assert len(page[["a", "b"]].drop_duplicates()) == 1 and len(page) in sizes.values()
        assert list(page.index) == list(range(len(page)))
        i = page["i"].to_list()
        assert i[:-1] == list(range(1, len(page))) and np.isnan(i[-1])  # rows without a number come last
        found = np.argsort(-page["x"].to_numpy(), kind="stable")[:4]
        return found if places else page.iloc[found]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, "a string, b int, i int, x int")
        found = [tuple(r) for r in hooks.order_with(df.repartition(7), ["a", "b"], ["i"], order).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = []
    for key in sizes:
        page = sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[3], r[2] is None, r[2] or 0))[:4]
        wanted += [(*r, n) for n, r in enumerate(page)]
    assert sorted(map(str, found)) == sorted(map(str, wanted))


def test_page_hook_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(100).selectExpr("id % 9 page", "id i").mapInPandas(counted, "page long, i long")
    assert len(hooks.order_with(df, ["page"], ["i"], lambda page: page.iloc[::-1]).collect()) == 100
    assert seen.value == 100


def test_page_hook_may_give_places(spark):
    rows = [(page, i) for page in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "page int, i int")
    some = hooks.order_with(df, ["page"], ["i"], lambda p: np.array([3, 0, 3] if p["page"][0] else [], dtype=int))
    wanted = [(page, i, n) for page in (1, 2) for n, i in enumerate([3, 0, 3])]
    assert sorted(map(tuple, some.collect())) == sorted(wanted)
    for place in (-1, 4):
        with pytest.raises(Exception, match="a place that its page does not have"):
            hooks.order_with(df, ["page"], ["i"], lambda p, place=place: np.array([place])).collect()


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "once")
    rows = spark.createDataFrame([(1, T0, "a"), (1, T0 + datetime.timedelta(1), "b")], "k int, arrived_at timestamp, v string")
    for _ in range(2):
        sinks.append_once(rows, path, ["k"])
    sinks.append_once(spark.createDataFrame([(1, T0, "z"), (2, T0, "c")], rows.schema), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_recognizer_hook(spark):
    def recognizer(content: bytes) -> list[dict]:
        return [
            {
                "candidates": [{"text": f" {w} ", "confidence": 0.5}] if w else [],
                "x": 0.1 + 0.3 * i, "y": 0.5, "w": 0.1, "h": 0.1,
            }
            for i, w in enumerate(content.decode().split(","))
        ]

    images = spark.createDataFrame([("p", b"one,,two"), ("q", b",")], "page string, content binary")
    rows = hooks.recognize_pages(images, recognizer, "page").collect()
    assert [(r.page, r.page_text) for r in rows] == [("p", "one two")]


@pytest.mark.parametrize("hot", [False, True])
def test_ordering_hooks(spark, request, hot):
    if hot:
        request.getfixturevalue("hot_limits")
    rows = [(p, i, "t", (i * 7 % 5) / 10, 0.9 - i / 20, 0.1, 0.01) for p in range(3) for i in range(4 if p else 9)]
    df = spark.createDataFrame(rows, "page int, i int, text string, x double, y double, w double, h double")
    keyed = hooks.order_by_key(df, ["page"], ["i"], lambda b: -b["x"])
    for page in range(3):
        got = [r.i for r in keyed.filter(F.col("page") == page).orderBy("reading_order").collect()]
        assert got == [r[1] for r in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[3], r[1]))]

    def by_x(pages: pd.DataFrame) -> pd.DataFrame:
        assert pages["page"].nunique() == 1
        return pages.sort_values("x", kind="stable")

    whole = hooks.order_with(df, ["page"], ["i"], by_x)
    assert whole.count() == len(rows)
    for page in range(3):
        got = [r.i for r in whole.filter(F.col("page") == page).orderBy("reading_order").collect()]
        assert got == [r[1] for r in sorted((r for r in rows if r[0] == page), key=lambda r: (r[3], r[1]))]


def stream_of(spark, tmp_path, df, files):
    """A stream that sees the rows of ``df`` in one micro-batch per file."""
    path = str(tmp_path / "input")
    for part in files:
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, writer, tmp_path, mode="append"):
    query = stream.writeStream.outputMode(mode).foreachBatch(writer).option(
        "checkpointLocation", str(tmp_path / "progress")
    ).trigger(availableNow=True).start()
    query.awaitTermination()


def test_debounce_batch(spark):
    times = [(0, "e"), (150, "ei"), (340, "eig"), (900, "x")]
    df = spark.createDataFrame([("u", T0 + datetime.timedelta(milliseconds=t), q) for t, q in times], "user string, ts timestamp, query string")
    rows = streams.debounce(df, "user").orderBy("started_at").collect()
    assert [(r.query, r.keystrokes) for r in rows] == [("eig", 3), ("x", 1)]


def test_states_over_several_batches(spark, tmp_path):
    rows = [
        ("j", 1, T0, "refining", None, 4, 0.5, "p1"),
        ("j", 2, T0 + datetime.timedelta(1), "failed", "boom", None, None, None),
        ("k", 3, T0 + datetime.timedelta(2), "complete", None, 1, None, None),
        ("j", 4, T0 - datetime.timedelta(1), "draft", None, 9, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "job_id string, seq long, at timestamp, stage string, failure_message string, uncertain_count int, "
        "stage_progress double, stage_detail string",
    )
    stream = stream_of(spark, tmp_path, df, ["seq = 1", "seq = 2", "seq >= 3"])
    out = str(tmp_path / "states")
    run(spark, stream, streams.fold_states(out), tmp_path)
    got = {r.job_id: (r.stage, r.failure_message, r.uncertain_count) for r in streams.current_version(spark, out).collect()}
    assert got == {"j": ("failed", "boom", 4), "k": ("complete", None, 1)}


def test_first_results_and_save_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i % 3}", T0 + datetime.timedelta(seconds=i)) for i in range(9)], "i int, key string, arrived_at timestamp")
    stream = stream_of(spark, tmp_path, df, ["i < 4", "i >= 4"])
    out = str(tmp_path / "saved")
    run(spark, streams.first_results(stream, ["key"], "1 hour"), streams.save_once(out, ["key"]), tmp_path)
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["k0", "k1", "k2"]


def test_arrivals(spark, tmp_path):
    pages = spark.createDataFrame([("d", i) for i in range(3)], "document_id string, i int")
    documents = spark.createDataFrame([("d", 4)], "document_id string, page_count int")
    out = str(tmp_path / "progress-table")

    def write(batch, epoch):
        streams.with_completion(batch, documents).write.mode("overwrite").parquet(out)

    run(spark, streams.arrivals(stream_of(spark, tmp_path, pages, ["i < 2", "i = 2"])), write, tmp_path, "complete")
    assert [(r.done, r.progress) for r in spark.read.parquet(out).collect()] == [(3, 0.75)]


def test_debounce_with_a_hot_key(spark, hot_limits):
    times = [0, 100, 250, 900, 950, 1500, 1600, 1650, 1700, 3000]
    rows = [("u", T0 + datetime.timedelta(milliseconds=t), f"q{t}") for t in times] + [("v", T0, "w")]
    df = spark.createDataFrame(rows, "user string, ts timestamp, query string")
    got = sorted((r.user, r.query, r.keystrokes) for r in streams.debounce(df, "user").collect())
    assert got == [("u", "q1700", 4), ("u", "q250", 3), ("u", "q3000", 1), ("u", "q950", 2), ("v", "w", 1)]


def test_deadline_slots(spark):
    from quire.operators.jobs import split_by_deadline

    starts = spark.createDataFrame([("b", 1, T0), ("b", 2, T0 + datetime.timedelta(seconds=300))], "batch_id string, s int, started_at timestamp")
    offsets = [-1, 0, 209, 210, 211, 299, 300, 509, 510, 511]
    results = spark.createDataFrame([("b", o, T0 + datetime.timedelta(seconds=o)) for o in offsets], "batch_id string, o int, finished_at timestamp")
    got = {(r.s, r.o) for r in split_by_deadline(starts, results).collect()}
    assert got == {(s, o) for s, b in ((1, 0), (2, 300)) for o in offsets if b <= o <= b + 210}


def test_deadline_leftovers(spark):
    from quire.operators.jobs import deadline_leftovers, deadline_progress

    rows = [("b", 0, T0), ("b", 1, T0), ("b", 2, T0), ("b", 3, T0), ("c", 0, T0)]
    planned = spark.createDataFrame(rows, "batch_id string, page int, started_at timestamp")
    offsets = [("b", 0, 210), ("b", 1, 211), ("b", 2, 250), ("b", 2, 10), ("c", 1, 1)]
    found = [(b, p, T0 + datetime.timedelta(seconds=o)) for b, p, o in offsets]
    results = spark.createDataFrame(found, "batch_id string, page int, finished_at timestamp")
    left = deadline_leftovers(planned, results, "page")
    assert {(r.batch_id, r.page) for r in left.collect()} == {("b", 1), ("b", 3), ("c", 0)}
    assert {tuple(r) for r in deadline_progress(planned, left).collect()} == {("b", 2, 4), ("c", 0, 1)}


def test_deadline_sorts_stay_in_many_tasks(spark):
    """Narrow rows are far larger in a sort than in a shuffle: their partitions are not put together by shuffled size."""
    from quire.operators.jobs import deadline_leftovers

    key, at = F.col("id") % 7, F.timestamp_seconds(F.col("id"))
    planned = spark.range(5000).select(key.alias("batch_id"), F.col("id").alias("page"), at.alias("started_at"))
    found = spark.range(4000).select(key.alias("batch_id"), F.col("id").alias("page"), (at + F.expr("INTERVAL 1 MINUTE")).alias("finished_at"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        left = deadline_leftovers(planned, found, "page").withColumn("_task", F.spark_partition_id())
        assert left.count() == 1000 and left.select("_task").distinct().count() == 16
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_deadline_leftovers_with_nulls_and_repeats(spark):
    from quire.operators.jobs import deadline_leftovers

    rows = [("b", 0, T0), ("b", 0, T0), ("b", 1, None), (None, 1, T0), ("b", None, T0), ("b", 2, T0)]
    planned = spark.createDataFrame(rows, "batch_id string, page int, started_at timestamp")
    found = [("b", 0, T0), ("b", 0, None), ("b", 1, T0), (None, 1, T0), ("b", None, T0), ("b", 2, None)]
    results = spark.createDataFrame(found, "batch_id string, page int, finished_at timestamp")
    left = [(r.batch_id, r.page) for r in deadline_leftovers(planned, results, "page").collect()]
    assert sorted(left, key=repr) == [("b", 1), ("b", 2), ("b", None), (None, 1)]


def test_planned_items_of_a_stream_are_made_once(spark, monkeypatch):
    from catalog import job_queries, stream_queries

    made = spark.sparkContext.accumulator(0)

    @F.udf("timestamp")
    def seen(at):
        made.add(1)
        return at

    day = datetime.timedelta(days=1)
    rows = [(i, 1, T0 + i * 40 * day) for i in range(9)]
    planned = spark.createDataFrame(rows, "batch_id long, line int, started_at timestamp").withColumn("started_at", seen("started_at"))
    found = [(b, n, at + (10 if b % 3 else 31) * day) for b, n, at in rows]
    results = spark.createDataFrame(found, "batch_id long, line int, finished_at timestamp")
    monkeypatch.setattr(job_queries, "shipping", lambda spark, sf_dir: (planned, results))
    left = stream_queries.streamed_deadline_leftovers(spark, "")
    assert sorted(map(tuple, left.collect())) == [(0, 1), (3, 1), (6, 1)]
    assert made.value == len(rows)
