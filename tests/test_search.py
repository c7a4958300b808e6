from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import batch_search
from quire.operators.search import rank_order, search

BASE = 1_700_000_000


def library(spark, *documents):
    """documents: (id, title, seconds, [page texts])."""
    docs = [
        (key, title, "photo", datetime.datetime.fromtimestamp(BASE + shift, datetime.timezone.utc))
        for key, title, shift, _ in documents
    ]
    pages = [
        (key, f"{key}p{number}", number, text)
        for key, _, _, texts in documents
        for number, text in enumerate(texts, 1)
    ]
    return (
        spark.createDataFrame(docs, "document_id string, title string, document_type string, updated_at timestamp"),
        spark.createDataFrame(pages, "document_id string, page_id string, page_number int, text string"),
    )


def run(spark, query, *documents, limit=None):
    return search(*library(spark, *documents), query, limit=limit).orderBy(*rank_order()).collect()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_terms(spark):
    assert t.parse_terms("  Eigen  VALUE \n ") == ["eigen", "value"]
    assert value(spark, t.query_terms(F.lit("  Eigen  VALUE \n "))) == ["eigen", "value"]
    assert value(spark, t.query_terms(F.lit(" 　a b"))) == ["a", "b"]


def test_blank_query_finds_nothing(spark):
    assert run(spark, "   ", ("n", "Notes", 0, ["anything"])) == []


def test_case_and_accents_do_not_matter(spark):
    rows = run(spark, "EIGENVALUES", ("l", "Lecture", 0, ["Eigenvalues and eigenvectors"]))
    assert len(rows) == 1
    assert len(run(spark, "resume", ("a", "A", 0, ["my Résumé"]))) == 1
    assert len(run(spark, "résumé", ("a", "A", 0, ["my résumé"]))) == 1
    assert value(spark, t.fold(F.lit("İSTANBUL Ångström Ё"))) == "istanbul angstrom е"


def test_scripts_without_spaces(spark):
    documents = [
        ("a", "线性代数 课堂笔记", 0, ["矩阵 A 的特征值满足 det(A - λI) = 0。"]),
        ("b", "English only", 0, ["nothing here"]),
    ]
    rows = run(spark, "特征值", *documents)
    assert [(r.document_id, r.page_number) for r in rows] == [("a", 1)]


def test_title_only_match(spark):
    rows = run(spark, "课堂", ("a", "课堂笔记", 0, ["no hit"]))
    assert [(r.match_kind, r.snippet, list(r.highlights), r.result_id) for r in rows] == [
        ("title_partial", "no hit", [], "a#title")
    ]


def test_title_match_without_pages(spark):
    rows = run(spark, "empty", ("a", "Empty", 0, []), ("b", "other", 0, ["x"]))
    assert [(r.match_kind, r.page_id, r.page_number, r.snippet) for r in rows] == [("title_exact", None, None, "")]


def test_every_term_on_one_page(spark):
    documents = [("b", "Both", 0, ["alpha and beta live here"]), ("o", "One", 0, ["alpha only", "beta apart"])]
    assert [r.title for r in run(spark, "alpha beta", *documents)] == ["Both"]


def test_pages_in_order(spark):
    rows = run(spark, "vision", ("r", "Report", 0, ["vision on page one", "nothing", "vision again on page three"]))
    assert [r.page_number for r in rows] == [1, 3]


def test_exact_title_first(spark):
    documents = [("a", "Random", 0, ["vision vision vision vision"]), ("b", "Vision", 0, ["unrelated"])]
    rows = run(spark, "vision", *documents)
    assert (rows[0].title, rows[0].match_kind) == ("Vision", "title_exact")


def test_more_matches_then_newer(spark):
    assert run(spark, "ocr", ("a", "A", 0, ["ocr"]), ("b", "B", 0, ["ocr ocr ocr"]))[0].title == "B"
    assert run(spark, "ocr", ("a", "Older", 0, ["ocr"]), ("b", "Newer", 60, ["ocr"]))[0].title == "Newer"


def test_body_wins_over_title_kind_and_counts_all_pages(spark):
    rows = run(spark, "ocr ocr", ("a", "ocr", 0, ["ocr", "ocr ocr"]), ("b", "b", 0, ["ocr"]))
    assert [(r.match_kind, r.body_match_count) for r in rows if r.document_id == "a"] == [("body", 6)] * 2


def test_limit_is_a_top_k(spark):
    documents = [(f"d{i}", f"T{i}", i, ["ocr " * i]) for i in range(1, 6)]
    rows = search(*library(spark, *documents), "ocr", limit=2).collect()
    assert [r.document_id for r in rows] == ["d5", "d4"]


def test_snippet_with_context(spark):
    rows = run(spark, "needle", ("a", "A", 0, ["padding " * 20 + "needle" + " trailing" * 20]))
    snippet, marks = rows[0].snippet, rows[0].highlights
    assert snippet.startswith("…") and snippet.endswith("…")
    assert [snippet[m.start : m.end] for m in marks] == ["needle"]


@pytest.mark.parametrize(
    ("text", "terms", "expected"),
    [
        ("alpha beta alpha", ["alpha", "beta"], ["alpha", "beta", "alpha"]),
        ("矩阵的特征值和特征向量", ["特征"], ["特征", "特征"]),
        ("a+b A+B [x] \\E", ["a+b", "\\e"], ["a+b", "A+B", "\\E"]),
        ("none", ["x"], []),
        ("Cafe\u0301s caf\u00e9 \u0301 x", ["CAFE", "\u0301"], ["Cafe\u0301", "caf\u00e9"]),
        ("e\u0301\u0323 a.\u0301c \\\u0301E", ["\u00e9", "a.c", "\\e"], ["e\u0301\u0323", "a.\u0301c", "\\\u0301E", "E"]),
        ("\u0623\u0628 \u0627\u0628", ["\u0627\u0628"], ["\u0623\u0628", "\u0627\u0628"]),
        ("\u304b\u3099\u3063 \u304c", ["\u304b"], ["\u304b\u3099", "\u304c"]),
        ("\u039f\u0394\u039f\u03a3 \u03bf\u03b4\u03cc\u03c2 \u03bf\u03b4\u03bf\u03c3\u03b1", ["\u03bf\u03b4\u03bf\u03c2"],
         ["\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03cc\u03c2", "\u03bf\u03b4\u03bf\u03c3"]),
        ("\U0001d538\u0301x \U0001f600", ["\U0001f600"], ["\U0001f600"]),
    ],
)
def test_highlights(spark, text, terms, expected):
    marks = value(spark, t.highlight_ranges(F.lit(text), F.array(*[F.lit(x) for x in terms])))
    assert [text[m.start : m.end] for m in marks] == expected


def test_many_highlights_match_brute_force(spark):
    text = "ab" * 3000
    marks = value(spark, t.highlight_ranges(F.lit(text), F.array(F.lit("ba"))))
    assert [m.start for m in marks] == list(range(1, 5999, 2))


def test_marked_highlights_match_brute_force(spark):
    import random
    import unicodedata

    rng = random.Random(6)
    text = "".join(rng.choice("aabb \u0301\u0323\u00e1") for _ in range(2000))
    marks = value(spark, t.highlight_ranges(F.lit(text), F.array(F.lit("ab"), F.lit("ba"))))
    clusters = []  # (start, end, folded letter)
    for i, c in enumerate(text):
        if unicodedata.category(c) == "Mn" and clusters:
            clusters[-1][1] = i + 1
        elif unicodedata.category(c) != "Mn":
            clusters.append([i, i + 1, "a" if c == "\u00e1" else c])
    plain, want = "".join(c[2] for c in clusters), []
    for term in ("ab", "ba"):
        at = plain.find(term)
        while at >= 0:
            want.append((clusters[at][0], clusters[at + 1][1]))
            at = plain.find(term, at + 2)
    assert sorted((m.start, m.end) for m in marks) == sorted(want)


def test_snippets_of_marked_text(spark):
    text = "x" * 80 + " re\u0301sume\u0301 " + "y" * 80
    row = run(spark, "resume", ("d", "t", 0, [text]))[0]
    assert row.snippet == "\u2026" + "x" * 47 + " re\u0301sume\u0301 " + "y" * 47 + "\u2026"
    assert [row.snippet[h.start : h.end] for h in row.highlights] == ["re\u0301sume\u0301"]


def test_occurrences(spark):
    assert value(spark, t.occurrences(F.lit("abab ab"), F.lit("ab"))) == 3
    assert value(spark, t.occurrences(F.lit("abab ab"), F.lit(""))) == 0
    assert value(spark, t.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2


def test_preview(spark):
    assert value(spark, t.preview(F.lit("a \n b"))) == "a b"
    assert value(spark, t.preview(F.lit("x" * 121))) == "x" * 120 + "…"


def test_batch_search_matches_single_search(spark):
    texts = ["alpha beta alphabet", "beta 你好吗 x" + "y" * 300 + "z", "gamma aaa", "Álpha BETA", "alpha"]
    documents, pages = library(spark, *[(f"d{i}", "t", 0, [x, "alpha"]) for i, x in enumerate(texts)])
    queries = ["alpha beta", "a a", "好", "yyz", "zz top", "aa", " "]
    table = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {
        (r.query_id, r.page_id, r.body_match_count) for r in batch_search.search_batch(table, pages).collect()
    }
    want = set()
    for i, query in enumerate(queries):
        for r in search(documents, pages, query).filter("match_kind = 'body'").collect():
            want.add((i, r.page_id, r.body_match_count))
    assert got == want


def test_stored_index_and_shared_words(spark, tmp_path):
    """A common word shared by all queries costs nothing where another word is rare; unknown words drop a query."""
    texts = [f"shared w{i} w{i % 3} shared" for i in range(30)] + ["shared", "w1", "x\u0301y \u5b57\u5b57 shared"]
    documents, pages = library(spark, *[(f"d{i}", "t", 0, [x, "w1 other"]) for i, x in enumerate(texts)])
    queries = [f"shared w{i}" for i in range(12)] + ["shared shared", "shared none", "xy shared \u5b57", "shared w1 w1 w2"]
    table = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    path = str(tmp_path / "index")
    batch_search.write_index(batch_search.build_index(pages), path)
    index = batch_search.read_index(spark, path)
    got = {(r.query_id, r.page_id, r.page_matches, r.body_match_count) for r in batch_search.search_index(table, index).collect()}
    want = set()
    for i, query in enumerate(queries):
        for r in search(documents, pages, query).filter("match_kind = 'body'").collect():
            text = texts[int(r.document_id[1:])].replace("\u0301", "") if r.page_number == 1 else "w1 other"
            want.add((i, r.page_id, sum(text.count(term) for term in query.split()), r.body_match_count))
    assert got == want
    # each query meets the pages of its rarest word only
    plan = batch_search.search_index(table, index)._jdf.queryExecution().toString()
    assert " text#" not in plan
    assert batch_search.search_index(table.limit(0), index).count() == 0


def test_broadcasts_are_bounded_in_bytes(spark):
    from quire import runtime

    rows = spark.createDataFrame([("x" * 1000,)] * 20, "text string")
    assert runtime.is_small(rows)
    spark.conf.set(runtime.BROADCAST_BYTES, "5000")
    assert not runtime.is_small(rows) and runtime.is_small(rows.limit(2))
    spark.conf.unset(runtime.BROADCAST_BYTES)


def test_search_without_broadcasts(spark, no_broadcast):
    test_every_term_on_one_page(spark)
    test_title_only_match(spark)
    test_title_match_without_pages(spark)
    test_body_wins_over_title_kind_and_counts_all_pages(spark)


def test_batch_search_without_broadcasts(spark, no_broadcast):
    test_batch_search_matches_single_search(spark)


def test_index_counts_words_inside_rows(spark, monkeypatch):
    """Postings are counted without an exchange, and written once."""
    from collections import Counter

    from quire.operators import batch_search

    texts = ["b a\tb  É e\n", "", None, " \n ", "one", "x " * 500 + "y"]
    pages = spark.createDataFrame([(i, f"p{i}", 1, x) for i, x in enumerate(texts)], "document_id int, page_id string, page_number int, text string")
    plans, plain = [], batch_search.written

    def written(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(batch_search, "written", written)
    index = batch_search.build_index(pages)
    assert "Exchange" not in plans[0]
    want = [(i, w, n) for i, x in enumerate(texts) for w, n in Counter((x or "").replace("É", "e").split()).items()]
    assert sorted((r.document_id, r.token, r.n) for r in index.postings.collect()) == sorted(want)
    held = Counter(w for _, w, _ in want)
    assert {(r.token, r.pages) for r in index.vocabulary.collect()} == set(held.items())
