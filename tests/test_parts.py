from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import markup as m
from quire.operators import jobs, parts
from quire.operators import markdown as md
from quire.plans import flows
from quire.sources import readers, sinks

BITS = ["$", "$$", "a", " ", "\n", "\n", "b$", "$$$", "# h", "- x", "1. y", "$x$", "[unclear: q", "]", "![c](p.png)", "$$ z"]


def pages_of(rng, n_jobs=25):
    rows = []
    for job in range(n_jobs):
        for i in range(rng.randint(1, 7)):
            rows.append((job, i, "".join(rng.choice(BITS) for _ in range(rng.randint(1, 12)))))
    return rows


def both(spark, rng, part_pages=2):
    """The same sources as one value and in parts."""
    pages = spark.createDataFrame(pages_of(rng), "job_id int, page_index int, final_markdown string")
    whole = jobs.assemble_markdown(pages).select(F.col("job_id").alias("doc_id"), "markdown")
    return whole, jobs.assemble_markdown(pages, part_pages).withColumnRenamed("job_id", "doc_id")


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize(("seed", "part_pages"), [(1, 2)])
def test_parts_give_what_the_whole_gives(spark, seed, part_pages):
    whole, cut_up = both(spark, random.Random(seed), part_pages)
    assert cut_up.agg(F.max("part")).first()[0] > 0
    assert rows_of(parts.whole(cut_up, ["doc_id"], "markdown", jobs.PAGE_BREAK)) == rows_of(whole)
    for operator in (md.block_table, md.outline, md.body_headings, md.list_runs, md.math_inventory, md.uncertain_counts):
        assert rows_of(operator(cut_up)) == rows_of(operator(whole)), operator.__name__
    files = spark.createDataFrame([(i, "p.png") for i in range(0, 25, 2)], "doc_id int, path string")
    assert rows_of(flows.publish_sources(cut_up, files)) == rows_of(flows.publish_sources(whole, files))
    assert flows.publish_sources(cut_up).count() == 25


def test_math_open_over_many_parts(spark):
    pages = ["text", "$$ open", "- mid", "# in math", "end $$ x", "# after", "$ one", "two", "three $", "$ never"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages)], "job_id int, page_index int, final_markdown string")
    cut_up = jobs.assemble_markdown(df, 1).withColumnRenamed("job_id", "doc_id")
    kinds = [r.kind for r in md.block_table(cut_up).orderBy("position").collect() if r.kind != "blank"]
    assert kinds == ["paragraph", "page_break", "math", "page_break", "heading", "page_break", "math", "page_break", "paragraph"]
    settled = {r.part: r.markdown for r in md.settle(cut_up).collect()}
    assert settled[1].endswith("end $$ x") and set(settled) == {0, 1, 5, 6, 9}
    assert [r.anchor for r in md.body_headings(cut_up).collect()] == ["section-1"]


def test_pages_beyond_the_first_part_alone(spark):
    df = spark.createDataFrame([(1, 7, "late"), (1, 9, "later"), (2, 0, "x")], "job_id int, page_index int, final_markdown string")
    cut_up = jobs.assemble_markdown(df, 2)
    texts = {r.job_id: r.markdown for r in parts.whole(cut_up, ["job_id"], "markdown", jobs.PAGE_BREAK).collect()}
    assert texts == {1: "late" + jobs.PAGE_BREAK + "later", 2: "x"}
    assert rows_of(jobs.split_pages(cut_up)) == [(1, "late", 0), (1, "later", 1), (2, "x", 0)]


def test_empty_sources(spark):
    empty = spark.createDataFrame([], "doc_id int, part int, markdown string")
    assert flows.publish_sources(empty).count() == 0 and md.block_table(empty).count() == 0


def test_unclosed_openings_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([("$open line of an equation that never ends\n" * n,)], "markdown string")
        start = time.perf_counter()
        assert df.select(F.size(m.raw_blocks(F.col("markdown")))).first()[0] == n + 1
        return time.perf_counter() - start

    seconds(1000)
    few, many = min(seconds(8_000) for _ in range(2)), min(seconds(64_000) for _ in range(2))
    assert many < 8 * few + 2


def test_marks_and_openings_against_the_rules(spark):
    """Lines behind the last closing line never open a block; lines before it do."""
    text = "$a\n$b\nc$\n$d\nCx\nF $e\n$$f\n$g"
    blocks = spark.createDataFrame([(text,)], "t string").select(m.raw_blocks(F.col("t")).alias("b")).first().b
    assert blocks == ["$a\n$b\nc$", "$d", "Cx", "F $e", "$$f\n$g"]


def test_missing_figures(spark):
    sources = spark.createDataFrame([(1, "![a](a.png) ![b](b<.png)\n- ![c](../c.png) ![d](d.png)"), (2, "no figure")], "doc_id int, markdown string")
    files = spark.createDataFrame([(1, "a.png"), (1, "a.png"), (2, "d.png")], "doc_id int, path string")
    html = {r.doc_id: r.html for r in md.to_html(sources, files).collect()}
    assert html[1].count("<figure>") == 1 and 'src="a.png"' in html[1]
    assert '<span class="unclear">[missing figure: b&lt;.png]</span>' in html[1]
    assert "[blocked image path]" in html[1] and "[missing figure: d.png]</span></li>" in html[1]
    assert html[2] == md.to_html(sources).filter("doc_id = 2").first().html
    plain = md.to_html(sources).filter("doc_id = 1").first().html
    assert plain.count("<figure>") == 3


@pytest.mark.parametrize("file_bytes", [40, 1 << 20])
def test_packed_files(spark, tmp_path, hot_limits, file_bytes):
    rng = random.Random(5)
    rows = [(f"k{rng.choice([0, 0, 0, 1, 2, 3])}", i, rng.choice(["", "é", "日本\n語", "plain " * 5, None])) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, i int, text string")
    path = str(tmp_path / "packed")
    sinks.write_packed(df, path, ["key"], ["i"], separator="\n--\n", file_bytes=file_bytes)
    found = {r.key: r.text for r in parts.whole(readers.read_packed(spark, path), ["key"], "text").collect()}
    want: dict = {}
    for key, _, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(key, []).append(text or "")
    assert found == {k: "\n--\n".join(v) for k, v in want.items()}
    some = spark.createDataFrame([("k1",), ("k9",)], "key string")
    assert {r.key for r in readers.read_packed(spark, path, some).collect()} == {"k1"}
    files = [f for f in (tmp_path / "packed" / "data").rglob("*.txt")]
    assert max(f.stat().st_size for f in files) < file_bytes + 60
    if file_bytes == 1 << 20:
        assert len(files) == 1


def test_small_packed_files_share_slices(spark, tmp_path):
    """Tasks do not grow in number with small files, and rows of equal keys stand where the index says."""
    rows = [(i // 2, f"{i}é" * (i % 5)) for i in range(2000)]
    path = str(tmp_path / "small")
    sinks.write_packed(spark.createDataFrame(rows, "key int, text string"), path, ["key"], [], file_bytes=64)
    index = spark.read.parquet(f"{path}/index")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert index.select("_slice").distinct().count() <= sinks.SLICES_PER_CORE * width
    assert index.select("_slice", "_file").distinct().count() > 100
    found = {r.key: r.text.split("\n") for r in readers.read_packed(spark, path).collect()}
    assert {key: sorted(texts) for key, texts in found.items()} == {k: sorted(t for key, t in rows if key == k) for k in range(1000)}


def test_record_lines(spark, tmp_path):
    crop = "crops array<struct<index:int,transcript:string>>"
    rows = [("a\"b", 1, "two", [(0, "t")], "m"), ("a\"b", 0, "one", [], "n"), ("c", 0, "x", None, "y"), (None, 0, "x", None, "z")]
    df = spark.createDataFrame(rows, f"job_id string, page_index int, overview string, {crop}, final_markdown string")
    path = str(tmp_path / "records")
    sinks.write_packed(jobs.record_lines(df), path, ["job_id"], ["page_index"], "json", ",", file_bytes=64)
    found = [json.loads(r.text) for r in parts.whole(readers.read_packed(spark, path), ["job_id"], "text").collect()]
    by_key = {r.get("job_id"): [p["final_markdown"] for p in r["pages"]] for r in found}
    assert by_key == {'a"b': ["n", "m"], "c": ["y"], None: ["z"]}


def test_sources_in_parts_are_made_once(spark):
    """However many renderings and counts read them."""
    _, cut_up = both(spark, random.Random(5))
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    files = spark.createDataFrame([(i, "p.png") for i in range(0, 25, 2)], "doc_id int, path string")
    rows = cut_up.count()
    sources = cut_up.withColumn("markdown", seen("markdown"))
    assert flows.publish_sources(sources, files).count() == 25 and made.value == rows
    assert md.outline(sources).count() and made.value == 2 * rows
