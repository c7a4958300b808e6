"""Periodic runs against a search of every period and place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from quire.llm import periodic_runs, queries


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_words(rng):
    n, kinds = rng.choice([0, 1, 23, 24, 25, 40, 100, 300, 700]), rng.choice([1, 2, 3, 50])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.choice([0, 1, 2])):
        if n > 30:
            a, p = rng.randrange(n), rng.randrange(1, n // 3)
            for i in range(a, rng.randrange(a, n + 1)):
                words[i] = words[a + (i - a) % p]
    return words


def test_transform_counts_mismatches():
    rng = np.random.default_rng(1)
    for block in (8, 64, 512):
        numbers = rng.integers(0, 2, 5 * block + 3)
        numbers[3 * block : 5 * block] = numbers[2 * block : 4 * block]
        found = {(int(a), int(d)) for at, gap in periodic_runs.zero_distances(numbers, block, True) for a, d in zip(at, gap, strict=True)}
        want = {
            (a, d) for a in range(0, 4 * block, block) for d in range(1, 2 * block)
            if a + d + block <= len(numbers) and (numbers[a : a + block] == numbers[a + d : a + d + block]).all()
        }
        assert want and {(a, d) for a, d in found if a + d + block <= len(numbers)} == want


def test_runs_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        docs = [random_words(rng) for _ in range(rng.choice([1, 4]))]
        found = periodic_runs.runs_of([np.array(d, dtype=np.int64) for d in docs])
        assert found == [brute_runs(d) for d in docs]


def test_many_kinds_of_words_and_long_periods():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 30_000)
    words = np.concatenate([base, np.tile(base[:9_000], 4), np.full(50_000, 7), base[:5_000]])
    assert periodic_runs.runs_of([words, words[:100]]) == [[(30_000, 36_000, 9_000), (66_000, 50_000, 1)], []]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    blanks = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]
    texts = [None, "", " \n", "one", "  \x1c", "\x85 a"]
    for _ in range(120):
        texts.append("".join(f"wörd{w}{rng.choice(blanks)}" for w in random_words(rng)))
    rows = [(i, t, "extra") for i, t in enumerate(texts * 2)] + [(None, texts[20], "extra"), (7, texts[7], "extra")]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = brute_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2])) if runs else None
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(kept))]
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert sum(r["n_runs"] for r in found) > 50


def test_operator_takes_any_key_and_an_empty_table(spark):
    docs = spark.createDataFrame([("a", "x y " * 20), (None, None), ("a", "x y " * 20)], "name string, body string")
    rows = periodic_runs.find_runs(docs, "name", "body").collect()
    assert sorted((r["name"] or "", r["n_words"], r["collapsed"], len(r["runs"])) for r in rows) == [("", 0, "", 0)] + [("a", 40, "x y", 1)] * 2
    assert periodic_runs.find_runs(docs.limit(0), "name", "body").count() == 0
