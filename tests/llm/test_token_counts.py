"""Token counts against the library itself."""

from __future__ import annotations

import random

import pytest

from quire.llm import queries, token_counts
from quire.llm.queries import tokenizer_path

WORDS = [
    "The", "the", "of,", "Ünd", "it's", "don't!", "12ab", "ﬁ", "é", "́", "ΟΔΟΣ", "x\ty", " ", "\x1c", "end.\n", "", "a\r\nb",
    "<|endoftext|>", "a<|startoftext|>b", "<|endoftext|", "日本語", "co-op", "...", "İ", "A.", "Q?", " ", "\x85", "🙂🙂", "supercalifragilistic" * 9,
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def make_texts():
    rng = random.Random(3)
    texts = [None, "", " ", "\n", "a", "word " * 9000, "z" * 3000]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 5, 60, 700]))) for _ in range(120)]
    return texts + ["the same text"] * 400


@pytest.mark.parametrize("chars, docs", [(8 << 20, 20_000), (2_000, 20_000), (1 << 20, 3)])
def test_query_against_the_library(spark, tmp_path, monkeypatch, tokenizer, chars, docs):
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", chars)
    monkeypatch.setattr(token_counts, "BLOCK_DOCS", docs)
    rows = [(None if i % 11 == 4 else i % 500, t, "a", "b") for i, t in enumerate(make_texts())]
    spark.createDataFrame(rows, "doc_id bigint, text string, block string, words string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_token_counts(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, *_ in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 2048))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert any(r["over_limit"] for r in found)


def test_pieces_are_counted_per_word(spark, tokenizer):
    docs = spark.createDataFrame([(i, "the cat, the dog <|endoftext|>") for i in range(50)], "doc_id bigint, text string")
    blocks = token_counts.frequencies(docs, tokenizer_path())
    words = blocks.selectExpr("block", "posexplode(words) as (place, word)")
    counted = words.join(token_counts.piece_counts(words, tokenizer_path()), ["block", "place"])
    found = {r["word"]: r["pieces"] for r in counted.collect()}
    assert found.pop("<|endoftext|>") == 1
    assert found == {w: len(tokenizer.encode(w, add_special_tokens=False).ids) for w in ("the", "cat", ",", "dog")}


def test_pre_tokens_of_many_stretches_at_once():
    known = token_counts.PreTokens(tokenizer_path())
    stretches = sorted({s for text in make_texts() for s in (text or "").replace("\n", " ").split(" ")})
    assert known.find(stretches) == [known._find(s) for s in stretches]


def test_numbers_survive_squeezing():
    import numpy as np

    from quire.llm.shared import squeezed, unsqueezed

    for values in ([], [0], [1, 2, 1 << 31, (1 << 32) - 1], list(range(1000))):
        assert unsqueezed(squeezed(np.array(values, dtype=np.int64))).tolist() == values


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.count_tokens(docs, tokenizer_path()).count() == 0
