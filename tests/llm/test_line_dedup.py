"""Line chunks: planted passages, shifts, and the kept occurrence."""

from __future__ import annotations

import random

from quire.llm import line_dedup

DOCS = "doc_id bigint, text string, low int, words string, _cuts string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", "c") for i, t in rows], DOCS)


def line(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_bounds_do_not_shift():
    rng = random.Random(1)
    shared = [line(rng, 8).encode() for _ in range(60)]
    cuts = []
    for extra in range(4):
        head = [line(rng, 5).encode() for _ in range(extra)]
        bounds = line_dedup.chunk_bounds(head + shared)
        assert bounds[0][0] == 0 and bounds[-1][1] == len(head + shared)
        assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))
        cuts.append({low - extra for low, _ in bounds})
    assert {c for c in set.union(*cuts) if c > 16} == {c for c in set.intersection(*cuts) if c > 16}


def test_passages(spark):
    rng = random.Random(2)
    long, lines = line(rng, 70), "\n".join(line(rng, 12) for _ in range(12))
    licence = line(rng, 12)
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, licence)]
    for i in range(10, 30):
        own = [line(rng, rng.choice([3, 15, 40])) for _ in range(6)]
        rows.append((i, "\n".join([*own[:3], long if i % 2 else lines, *own[3:], licence])))
    rows += [(40, rows[5][1]), (41, "once\n" + "tail " * 60), (41, "once\n" + "tail " * 60), (None, long)]
    got = line_dedup.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "low", "words", "_cuts", "_lines", "_removed"]
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    before = dict(rows)
    assert by_id[1]["text"] == "" and by_id[2]["text"] == "\n\n" and by_id[3]["text"] == licence
    assert long in by_id[11]["text"] and lines in by_id[10]["text"]
    for i in range(12, 30):
        own = [x for x in before[i].split("\n") if x not in (long, licence) and x not in lines.split("\n")]
        left = by_id[i]["text"].split("\n")
        assert [x for x in left if x in own] == own and left[-1] == licence
        assert long not in left
        if not i % 2:  # at most the lines at the edges stay
            assert sum(x in lines.split("\n") for x in left) <= 4
    assert by_id[40]["text"] == "" and by_id[40]["_removed"] == by_id[40]["_lines"]
    assert [r["text"] for r in got if r["doc_id"] == 41] == [before[41]] * 2
    assert sorted(str(r["text"]) for r in got if r["doc_id"] is None) == ["", "None"]
    for r in got:
        assert r["_lines"] - r["_removed"] == (len(r["text"].split("\n")) if r["text"] else r["_lines"] - r["_removed"])
    assert line_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_blank_lines_after_a_paragraph(spark):
    rng = random.Random(3)
    rows, kept = [], {}
    for k in range(24):
        paragraph = line(rng, 60)
        for n, (blank, tail) in enumerate([("", "short"), ("\n", "short"), ("\n\n", "short"), (" \n", "end"), ("", "end"), ("", "last"), ("\n", "last")]):
            head, after = line(rng, rng.choice([4, 30])), {"short": "\n" + line(rng, 3), "end": "\n", "last": ""}[tail]
            rows.append((10 * k + n, f"{head}\n\n{paragraph}\n{blank}{after[1:]}\n{line(rng, 4)}" if tail == "short" else f"{head}\n\n{paragraph}{after}{blank}"))
            kept[10 * k + n] = (paragraph, head)
    for r in line_dedup.remove_repeats(frame(spark, rows)).collect():
        paragraph, head = kept[r["doc_id"]]
        assert (paragraph in r["text"]) == (r["doc_id"] % 10 == 0), r
        assert head in r["text"]
        if r["doc_id"] % 10 in (1, 2):
            own = [x for x in dict(rows)[r["doc_id"]].split("\n") if x.strip() and x != paragraph]
            assert [x for x in r["text"].split("\n") if x.strip()] == own


def brute_left(texts):
    """Per text the lines that stay; texts are in order and differ."""
    split = [[x for x in t.split("\n") if x.strip()] for t in texts]
    left = []
    for t, own in enumerate(split):
        gone = set()
        for u in range(t + 1):
            for i in range(len(own)):
                for j in range(len(split[u]) if u < t else i):
                    most, k = (len(own) - i if u < t else i - j), 0
                    while k < most and i + k < len(own) and j + k < len(split[u]) and own[i + k] == split[u][j + k]:
                        k += 1
                    if sum(len(x.split()) for x in own[i : i + k]) >= line_dedup.MIN_WORDS:
                        gone.update(range(i, i + k))
        left.append([x for i, x in enumerate(own) if i not in gone])
    return left


def test_short_passages_of_short_lines(spark):
    rng = random.Random(4)
    rows, planted = [], {}
    for k in range(60):
        sizes = [[17, 17, 17], [12] * 5, [10, 10, 10, 10, 11], [19, 19, 19], [5] * 14][k % 5]
        passage = [line(rng, n) for n in sizes]
        for n in range(3):
            rows.append((10 * k + n, "\n".join([*(line(rng, 9) for _ in range(3)), *passage, *(line(rng, 9) for _ in range(3))])))
            planted[10 * k + n] = passage
    for r in line_dedup.remove_repeats(frame(spark, rows)).collect():
        passage, left = planted[r["doc_id"]], r["text"].split("\n")
        assert len(left) == (6 if r["doc_id"] % 10 else 6 + len(passage)), r
        assert (passage[0] in left) == (r["doc_id"] % 10 == 0)


def test_passages_brute_force(spark):
    rng = random.Random(5)
    pool = [line(rng, rng.choice([1, 4, 9, 17, 30, 55])) for _ in range(40)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(pool))
            parts += pool[at : at + rng.randrange(1, 9)] if rng.random() < 0.7 else [pool[at]] * rng.randrange(1, 8)
            parts += [""] * rng.randrange(3)
        texts.append("\n".join(parts))
    texts = list(dict.fromkeys(texts))
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(frame(spark, list(enumerate(texts)))).collect()}
    for i, left in enumerate(brute_left(texts)):
        assert [x for x in got[i].split("\n") if x.strip()] == left, i
