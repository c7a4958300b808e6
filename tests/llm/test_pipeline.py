"""The pipeline: each stage judged on its own input by plain Python, and the whole run."""

from __future__ import annotations

import random
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from quire.llm.queries import tokenizer_path
from plain import brute_components, contaminated, least_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LETTERS = {"en": "abcdefgh", "fr": "klmnopqr"}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    rng = random.Random(8)
    benchmark = [(i, words(rng, "en", 30)) for i in range(4)]
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        rows.append((i, "\n".join(words(rng, lang, rng.choice([4, 20, 60])) for _ in range(rng.randint(1, 6))), lang))
    near = words(rng, "en", 200)
    rows += [(100, near, "en"), (101, near, "en"), (102, near + " abc", "en"), (103, near.replace("a", "b", 3), "en")]
    rows += [(110, words(rng, "fr", 40) + " " + benchmark[0][1], "fr"), (111, words(rng, "en", 5) + "\n" + benchmark[1][1], "en")]
    shared = "\n".join(words(rng, "fr", 20) for _ in range(4))
    rows += [(120 + i, f"{words(rng, 'fr', 30)}\n{shared}\n{words(rng, 'fr', 30)}", "fr") for i in range(4)]
    rows += [(200, None, "en"), (201, "", "fr"), (202, " \n ", None), (203, "123 456 !", "en"), (204, "abc", None), (None, words(rng, "en", 50), "en")]
    rows += [(205, words(rng, "en", 6_000), "en"), (5, rows[5][1], "en")]
    return [(d, t, lang, "web", None if t is None else len(t)) for d, t, lang in rows], benchmark


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after every stage."""
    folder = tmp_path_factory.mktemp("corpus")
    rows, benchmark = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet")).select(*pipeline.COLUMNS)
    found = {"documents": docs.collect(), "benchmark": benchmark, "folder": str(folder)}
    for name, stage in pipeline.STAGES:
        docs = pipeline.store(stage(spark, docs, str(folder)))
        assert docs.columns == pipeline.COLUMNS or name == "best_fit_packing"
        found[name] = docs.collect()
    return found


def test_language(stages):
    before, after = stages["documents"], stages["language_id"]
    left = sorted(map(tuple, after), key=repr)
    assert set(left) <= set(map(tuple, before))
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {200, 201, 202, 203} <= gone
    # clean documents of known languages stay
    assert not gone & (set(range(60)) | {100, 101, 102, 103, 110, 111, 120, 121, 122, 123, 205})


def test_lines(stages):
    before, after = stages["language_id"], stages["line_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        assert r["n_chars"] == len(r["text"])
        if r["doc_id"] is not None and r["doc_id"] != 5:
            source = iter(texts[r["doc_id"]].split("\n"))
            assert all(line in source for line in r["text"].split("\n"))  # lines go, none changes or moves
    by_id = {r["doc_id"]: r["text"] for r in after}
    passage = set(texts[120].split("\n")[1:5])
    assert passage <= set(by_id[120].split("\n"))
    for i in (121, 122, 123):
        assert not passage & set(by_id[i].split("\n")) and len(by_id[i].split("\n")) == 2


def test_near_duplicates(stages):
    before, after = stages["line_dedup"], stages["ngram_jaccard_join"]
    keep = least_of(brute_components([(r["doc_id"], r["text"]) for r in before]))
    assert sorted((r["doc_id"] for r in after if r["doc_id"] is not None)) == sorted(keep)
    assert set(map(tuple, after)) <= set(map(tuple, before))


def test_decontamination(stages):
    before, after = stages["ngram_jaccard_join"], stages["benchmark_decontamination"]
    items = [text for _, text in stages["benchmark"]]
    want = [tuple(r) for r in before if not contaminated(r["text"], items)]
    assert sorted(map(tuple, after), key=repr) == sorted(want, key=repr)
    assert {110, 111} & {r["doc_id"] for r in before} and not {110, 111} & {r["doc_id"] for r in after}


def test_packing(stages):
    before, pieces = stages["benchmark_decontamination"], stages["best_fit_packing"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in before:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((r["doc_id"], n, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    bins: dict = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in bins.values():
        ends = [0]
        for offset, length in sorted(slots):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096


def test_run_is_all_stages(spark, stages):
    got = pipeline.run(spark, stages["folder"]).collect()

    def key(r):
        return (r["doc_id"] is None, r["doc_id"], r["piece"], r["length"], r["ids_crc32"])

    assert sorted(map(key, got), key=repr) == sorted(map(key, stages["best_fit_packing"]), key=repr)


def test_extra_columns_and_empty_tables(spark, stages):
    rows, _ = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows[-12:]], f"{DOCS}, id string, held_out int")
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.store(stage(spark, docs, stages["folder"]))
        assert docs.columns == pipeline.COLUMNS
    nothing = spark.createDataFrame([], DOCS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, stages["folder"]).count() == 0
