"""Shingle join against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import pytest

from quire.llm import components, ngram_join

DOCS = "doc_id bigint, text string, n bigint, comp string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", "d") for i, t in rows], DOCS)


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "Éa", "x y", *(f"w{i}" for i in range(60))])
    bases = [[word() for _ in range(rng.choice([3, 5, 8, 30, 60, 120]))] for _ in range(8)]
    passage = [word() for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two three four"), (None, "one"), (None, "null id"), (None, "null id")]
    for i in range(10, 10 + n):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            ws[rng.randrange(len(ws))] = word()
        if rng.random() < 0.1:
            ws += passage
        rows.append((i, " ".join(ws)))
    rows += [rows[-1], rows[-2], (7, "word " * 3000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("fragment", "per_row"), [(4_000_000, 4), (50, 0), (2000, 10**9)])
def test_components_match_all_pairs(spark, monkeypatch, fragment, per_row):
    monkeypatch.setattr(ngram_join, "FRAGMENT_SHINGLES", fragment)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", per_row)
    monkeypatch.setattr(ngram_join, "MAX_HUB_ROUNDS", 2)
    rows = corpus(fragment, 110)
    got = ngram_join.link_documents(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_keep_one(spark):
    rows = corpus(4, 50)
    want = {c for _, n, c in brute(rows) if n and c is not None}
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "comp", "id"]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(d for d, t in got if shingles(t) and d is not None) == sorted(want)
    assert {d for d, t in got if not shingles(t)} == {0, 1, 2}
    assert [t for d, t in got if d is None] == ["null id"]


def test_empty(spark):
    assert ngram_join.link_documents(frame(spark, [])).count() == 0
    assert ngram_join.keep_one(frame(spark, [])).count() == 0
    assert [r["component_id"] for r in ngram_join.link_documents(frame(spark, [(1, None)])).collect()] == [1]


def test_label(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 9), (9, 9), (7, 6), (6, 5)], "u bigint, v bigint")
    assert {(r["u"], r["v"]) for r in components.label(links).collect()} == {(2, 1), (3, 1), (9, 1), (5, 4), (6, 4), (7, 4)}


def test_rounds_that_take_nothing_away_end(spark, monkeypatch):
    """Sixty sets hold one shingle, ten couples of them link: one round finds these, and no other is worth its rows."""

    def bits(own):
        longs = [0] * ngram_join.BITMAP_LONGS
        for h in own:
            longs[(h >> 6) % ngram_join.BITMAP_LONGS] |= 1 << (h & 63)
        return [x - (1 << 64) if x >> 63 else x for x in longs]

    rows = []
    for i in range(60):
        couple = min(i, i ^ 1) if i < 20 else i
        own = [0, *range(100 * couple + 1, 100 * couple + 10)]
        rows.append((i, 10 + (couple != i), own, bits(own)))
    sets = spark.createDataFrame(rows, "id bigint, n bigint, hashes array<bigint>, bits array<bigint>")
    plain, made = ngram_join._renamed, []

    def renamed(*given):
        made.append(plain(*given))
        return made[-1]

    monkeypatch.setattr(ngram_join, "_renamed", renamed)
    found = {r.id: r.comp for r in ngram_join.set_components(sets, 80).collect()}
    assert found == {i: i - i % 2 if i < 20 else i for i in range(60)}
    assert len(made) <= 2
    # read twice, joined once
    assert all("Join" not in r._jdf.queryExecution().toString() for r in made)
