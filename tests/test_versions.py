from __future__ import annotations

import datetime
import json
import shutil

import pytest
from pyspark.sql import functions as F

from quire.sources import sinks
from quire.streaming import streams, versions

T0 = datetime.datetime(2024, 1, 1)
STATE = (
    "job_id string, seq long, at timestamp, stage string, failure_message string, uncertain_count int, "
    "stage_progress double, stage_detail string"
)


def after(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


class Turns:
    """A folder that fills turn by turn, and one run of a stream over what is new."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        self.add([])

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


def drain(writer, progress):
    writer.option("checkpointLocation", str(progress)).trigger(availableNow=True).start().awaitTermination()


def update(job, seq, at, stage, count=None):
    return (job, seq, after(at), stage, None, count, None, None)


def test_states_over_epochs_and_checkpoints(spark, tmp_path):
    turns, out = Turns(spark, tmp_path / "in", STATE), str(tmp_path / "states")

    def run(progress):
        drain(turns.stream().writeStream.foreachBatch(streams.fold_states(out, buckets=4)), tmp_path / progress)

    turns.add([update("j", 1, 10, "preparing", 5), update("k", 2, 10, "preparing")])
    run("one")
    turns.add([update("j", 3, 30, "refining"), *[update(f"other{i}", 4 + i, 5, "draft") for i in range(5)]])
    run("one")
    # late: newer than the count of j, older than its stage
    turns.add([update("j", 20, 20, "late", 7), update("k", 21, 1, "older", 9)])
    run("one")
    want = {"j": ("refining", 7), "k": ("preparing", 9), **{f"other{i}": ("draft", 0) for i in range(5)}}

    def states():
        return {r.job_id: (r.stage, r.uncertain_count) for r in streams.current_states(spark, out).collect()}

    assert states() == want
    run("renewed")  # everything once more, under epochs that begin at 0 again
    assert states() == want
    turns.add([update("k", 30, 99, "complete")])
    run("renewed")
    assert states() == {**want, "k": ("complete", 9)}
    newest = versions.Versions(spark, out).newest()
    assert len(newest["applied"]) == 2 and len(newest["folders"]) <= 4


def batch(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, n int")


def largest(rows):
    return rows.groupBy("key").agg(F.max("n").alias("n"))


def rows_of(spark, path):
    return {r.key: r.n for r in versions.current(spark, path).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.fold(batch(spark, *[(f"k{i}", i) for i in range(200)]), 0, path, ["key"], largest, 8)
    first = versions.Versions(spark, path).newest()["folders"]
    versions.fold(batch(spark, ("k7", 900)), 1, path, ["key"], largest, 8)
    second = versions.Versions(spark, path).newest()["folders"]
    assert sum(first[name] != second[name] for name in first) == 1
    assert rows_of(spark, path) == {**{f"k{i}": i for i in range(200)}, "k7": 900}


def test_a_repeated_epoch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.fold(batch(spark, ("a", 1)), 0, path, ["key"], largest)
    versions.fold(batch(spark, ("a", 2)), 1, path, ["key"], largest)
    before = versions.Versions(spark, path).newest()
    versions.fold(batch(spark, ("a", 3)), 1, path, ["key"], largest)
    assert versions.Versions(spark, path).newest() == before and rows_of(spark, path) == {"a": 2}


def test_an_empty_epoch_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.fold(batch(spark, ("a", 1)), 0, path, ["key"], largest)
    versions.fold(batch(spark, ("a", 1)).limit(0), 1, path, ["key"], largest)
    versions.fold(batch(spark, ("b", 1)), 2, path, ["key"], largest)
    assert rows_of(spark, path) == {"a": 1, "b": 1}


def test_lost_versions_are_errors(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(versions.LostVersionError):
        versions.fold(batch(spark, ("a", 1)), 3, path, ["key"], largest)
    with pytest.raises(versions.LostVersionError):
        versions.current(spark, path)
    versions.fold(batch(spark, ("a", 1)), 0, path, ["key"], largest)
    versions.fold(batch(spark, ("a", 2)), 1, path, ["key"], largest)
    (tmp_path / "t" / "published" / "2.json").rename(tmp_path / "gone.json")
    with pytest.raises(versions.LostVersionError):
        versions.fold(batch(spark, ("a", 3)), 2, path, ["key"], largest)
    shutil.move(str(tmp_path / "t" / "data"), str(tmp_path / "elsewhere"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        versions.current(spark, path).collect()
    with pytest.raises(ValueError, match="buckets"):
        versions.fold(batch(spark, ("a", 3)), 1, path, ["key"], largest, 3)


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "KEEP_VERSIONS", 2)
    path = str(tmp_path / "t")
    for epoch in range(5):
        versions.fold(batch(spark, ("a", epoch)), epoch, path, ["key"], largest, 1)
    assert sorted(p.name for p in (tmp_path / "t" / "published").glob("*.json")) == ["4.json", "5.json"]
    kept = [json.loads(p.read_text())["folders"] for p in (tmp_path / "t" / "published").glob("*.json")]
    assert rows_of(spark, path) == {"a": 4} and len({f for folders in kept for f in folders.values()}) == 2
    assert len(list((tmp_path / "t" / "data").glob("*/_bucket=*"))) == 2


def test_deltas_are_compacted(spark, tmp_path):
    path = str(tmp_path / "log")
    write = streams.log_edits(path, most_deltas=2)
    schema = "page_id string, new_text string, changed_at timestamp"
    for epoch in range(5):
        rows = [("p", f"t{epoch}", after(epoch)), ("p", "older", after(-1)), (f"q{epoch}", "x", T0)]
        write(spark.createDataFrame(rows, schema), epoch)
    folders = versions.Versions(spark, path).newest()["folders"]
    assert sum(name.startswith("snapshot") for name in folders) == 1 and len(folders) <= 3
    found = versions.current(spark, path)
    assert found.filter("page_id = 'p'").agg(F.max_by("new_text", "changed_at")).first()[0] == "t4"
    assert {r.page_id for r in found.collect()} == {"p", *[f"q{i}" for i in range(5)]}


def test_pages_are_counted_once(spark, tmp_path):
    turns, out = Turns(spark, tmp_path / "in", "document_id string, page_id int"), str(tmp_path / "counts")
    counts = streams.arrivals(turns.stream(), "page_id")
    for rows in ([("d", 1), ("d", 2), ("e", 1)], [("d", 2), ("d", 1)], [("d", 3), ("d", 3), ("f", 1)]):
        turns.add(rows)
        drain(counts.writeStream.outputMode("update").foreachBatch(streams.keep_arrivals(out, 4)), tmp_path / "progress")
    assert {r.document_id: r.done for r in streams.current_version(spark, out).collect()} == {"d": 3, "e": 1, "f": 1}


def test_a_last_row_settles_all_bursts(spark, tmp_path):
    turns = Turns(spark, tmp_path / "in", "user string, ts timestamp, query string")
    bursts = streams.debounce(turns.stream(), "user", "10 seconds", "1 minute")
    out = str(tmp_path / "out")

    def run():
        drain(bursts.writeStream.format("parquet").option("path", out), tmp_path / "progress")
        return sorted((r.user, r.query, r.keystrokes) for r in spark.read.schema(bursts.schema).parquet(out).collect())

    turns.add([("u", after(0), "a"), ("u", after(5), "ab"), ("v", after(1), "x")])
    assert run() == []
    turns.add([("u", after(300), "c")])
    assert run() == [("u", "ab", 2), ("v", "x", 1)]
    turns.add([(None, after(10_000), None)])
    assert run() == [("u", "ab", 2), ("u", "c", 1), ("v", "x", 1)]


def test_leftovers_of_late_batches(spark, tmp_path):
    plans = Turns(spark, tmp_path / "plans", "batch_id string, page int, started_at timestamp")
    found = Turns(spark, tmp_path / "found", "batch_id string, page int, finished_at timestamp")
    late = streams.leftovers(plans.stream(), found.stream(), "page", "5 seconds", 210)
    out = str(tmp_path / "out")

    def run():
        drain(late.writeStream.format("parquet").option("path", out), tmp_path / "progress")
        return sorted((r.batch_id, r.page) for r in spark.read.schema(late.schema).parquet(out).collect())

    plans.add([("b", i, T0) for i in range(4)] + [("c", 0, T0)])
    found.add([("b", 0, after(210)), ("b", 2, after(10))])
    assert run() == []
    found.add([("b", 1, after(211)), ("b", 2, after(212)), ("c", 1, after(213))])
    plans.add([("d", 0, after(400))])
    run()
    plans.add([(None, None, after(9_000))])
    found.add([(None, None, after(9_000))])
    assert run() == [("b", 1), ("b", 3), ("c", 0), ("d", 0)]


def test_write_once_reads_touched_buckets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "once")
    rows = spark.createDataFrame([(i, T0, f"v{i}") for i in range(100)], "k int, arrived_at timestamp, v string")
    sinks.append_once(rows, path, ["k"], buckets=16)
    seen = []
    original = sinks.write_once
    monkeypatch.setattr(sinks, "write_once", lambda existing, new, keys: seen.append(existing) or original(existing, new, keys))
    more = spark.createDataFrame([(5, T0, "later"), (500, T0, "new")], rows.schema)
    for _ in range(2):
        sinks.append_once(more, path, ["k"], buckets=16)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan and "v#" not in plan.split("ReadSchema")[1]
    assert len(seen[0].inputFiles()) > 2 and seen[0].select("_bucket").distinct().count() <= 2
    found = {r.k: r.v for r in sinks.read_once(spark, path).collect()}
    assert found == {**{i: f"v{i}" for i in range(100)}, 500: "new"}
