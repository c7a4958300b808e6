"""Fill-in-the-middle: ranks against slices, exact round trips, the query against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import fill_in_middle as fim
from quire.llm import queries

TEXTS = [
    None, "", "a", "héllo wörld", "日本語" * 300, "é" * 50, "x" * 63, "x" * 64, "x" * 65, "a<P>b", "<S>", "end <M", "<<<P", "S>M><",
    "\U0001f600 \x00 zero", "long " * 40_000, "same", "same", "line\nline\r\n\n",
]


def test_ranks_are_exact():
    rng = random.Random(1)
    for n in [0, 1, 2, 63, 64, 65, 128, 4097, 100_000]:
        plain = fim.SkipList(n)
        widths = np.array([rng.choice([0, 1, 1, 2, 7]) for _ in range(n)], dtype=np.int64)
        wide, before = fim.SkipList(n, widths), np.concatenate([[0], np.cumsum(widths)])
        for rank in {0, n, n // 2, *(rng.randint(0, n) for _ in range(200))}:
            assert plain.find(rank) == rank
            assert wide.find(rank) == before[rank]
        assert len(plain.lanes) <= 2 + n.bit_length()
        with pytest.raises(IndexError):
            plain.find(n + 1)


def test_lanes_get_thinner():
    lanes = fim.SkipList(64 * 50_000).lanes
    sizes = [len(units) for _, units, _ in lanes]
    assert sizes[0] == 50_000 and all(b < a / 2 for a, b in zip(sizes, sizes[1:]))
    assert all(units.sum() == 64 * 50_000 and chars.sum() == 64 * 50_000 for _, units, chars in lanes)


def test_units_of_a_pattern():
    text = "one two  three\nfour"
    assert fim.cut(text, 1, 3, r"\S+\s*") == (4, 15)
    assert fim.cut(text, 0, 2, r"[^\n]*\n|[^\n]+\Z") == (0, len(text))
    with pytest.raises(ValueError):
        fim.cut(text, 0, 1, r"\S+")


def expected(doc_id, text):
    text = text or ""
    if doc_id is None:
        return ("plain", None, None, text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return ("plain", None, None, text)
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    one, two, three = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return ("spm", a, b - a, f"<S>{three}<P>{one}<M>{two}")
    return ("psm", a, b - a, f"<P>{one}<S>{three}<M>{two}")


def test_query_against_plain_python(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 8)] + [(None, "no key", "x"), (3, TEXTS[3], "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, output string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op11_fill_in_middle(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc_id, text, _ in rows:
        form, a, b, output = expected(doc_id, text)
        want.append((doc_id, len(text or ""), form, a, b, digest(output), digest(text or "")))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_own_forms_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "ab cd ef", "k", 5), (2, None, "k", 5), (3, "ab", None, 5)], "id int, text string, Form string, output int")
    made = fim.transform(docs, F.lit(1), F.lit(2), F.lit("spm"), units=r"\S+\s*")
    assert made.columns == ["id", "text", "form", "prefix_chars", "middle_chars", "output"]
    rows = {r["id"]: r for r in made.collect()}
    assert rows[1]["output"] == "<S>ef<P>ab <M>cd " and rows[2]["output"] == "" and rows[2]["form"] == "plain"
    nothing = fim.transform(docs, F.lit(None), F.lit(2), F.lit("spm")).collect()
    assert {r["form"] for r in nothing} == {"plain"}
    assert fim.transform(docs.limit(0), F.lit(1), F.lit(2), F.lit("spm")).count() == 0
