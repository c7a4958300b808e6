"""Fitted operators: fixed parts against plain Python, planted cases, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import language_id, pii, quality, toxicity

DOCS = "doc_id bigint, text string, lang string, score string, base string, n_words string"
ODD = [None, "", " \n\t", "!!!", "\x00", "x" * 30_000, "a b c", "same same", "same same"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "b", "n") for i, t, lang in rows], DOCS)


def odd(first=1000):
    return [(None if k == 4 else first + k, t, None) for k, t in enumerate(ODD)]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_pii(text):
    spans = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            spans.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            spans.append((m.start(), 3, "phone", m.end()))
    return sorted(spans)


def test_base_entities_match_the_patterns():
    rng = random.Random(1)
    parts = ["a@b.c", "@", "x.y@", "b-1.de", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.0.00.1", ".", " ", "-", "+", "(", ")", "4111 1111 1111 1111",
             "4111111111111111", "12", "+1 555 123 4567", "+49(0)30-1234567", "é", "a@b@c.d.e", "٣", "٣.٣.٣.٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        assert pii.base_spans(text) == brute_pii(text), text


def test_contexts_find_new_identifiers(spark):
    rng = random.Random(2)
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    rows = [(i, f"please write today my address is 10.{i}.3.{i % 200} thanks", None) for i in range(40)]
    rows += [(100 + i, f"some words my address is fe80x{number(9)} thanks", None) for i in range(4)]
    rows += [(200 + i, f"in the year {number(7)} it rained", None) for i in range(40)] + odd()
    found = pii.find(frame(spark, rows))
    got = {(r["doc_id"], s["kind"]) for r in found.collect() for s in r["found"]}
    assert got == {(100 + i, "ip") for i in range(4)}
    assert found.count() == len(rows)
    for r in pii.digest(found).collect():
        text = dict((i, t) for i, t, _ in rows if i is not None).get(r["doc_id"]) or ""
        base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in brute_pii(text))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert pii.find(frame(spark, [])).count() == 0


def test_contexts_find_grouped_numbers(spark):
    rng = random.Random(7)
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    rows = [(i, f"you can call me on +49 30 {number(3)} {number(5)} any day", None) for i in range(40)]
    rows += [(100 + i, f"please charge my card 4111 1111 {1000 + i} {k:04d} today", None) for i in range(40) for k in range(1000, 1010) if luhn(f"41111111{1000 + i}{k}")]
    new = {200: ("phone", "030 123 45 67"), 201: ("phone", "(555) 123 4567"), 202: ("phone", "555-123 4567"), 203: ("card", "4111 1111 1111 1112")}
    assert not luhn("4111111111111112")
    rows += [(i, f"you can call me on {v} any day" if kind == "phone" else f"please charge my card {v} today", None) for i, (kind, v) in new.items()]
    rows += [(300 + i, f"we sold {number(3)} {number(4)} apples in {number(4)} 12 lots", None) for i in range(40)]
    got = {(r["doc_id"], s["kind"], rows_text[s["start"] : s["end"]]) for r in pii.find(frame(spark, rows)).collect() for s in r["found"] for rows_text in [dict((i, t) for i, t, _ in rows)[r["doc_id"]]]}
    assert got == {(i, kind, v) for i, (kind, v) in new.items()}


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_statistics():
    rng = random.Random(3)
    parts = ["a", "b", "#", "é|", "\n", " ", "\t", "\x1c", " ", "c d\n", "\r"]
    for n in [0, 1, 2, 5, 20, 200]:
        for _ in range(60):
            text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(n))
            assert quality.statistics(text)[:5] == brute_statistics(text)
    for text in ODD:
        assert quality.statistics(text)[:5] == brute_statistics(text)


def test_quality(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word() + ("***" if i % 10 == 0 else "") for _ in range(rng.randrange(60, 200))), None) for i in range(300)] + odd()
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1, 0) for i in range(0, 200)] + [(None, 0, None), (5, None, None), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.judge(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert not any(by_id[i]["kept"] for i in range(0, 300, 10))
    assert sum(by_id[i]["kept"] for i in range(300) if i % 10) >= 0.97 * 270
    assert not any(r["kept"] for r in got if r["base_failed"])
    bare = quality.judge(frame(spark, rows), labels.limit(0)).where("not base_failed and not kept").count()
    assert bare == 0 and quality.judge(frame(spark, []), labels).count() == 0


def test_language(spark):
    rng = random.Random(5)
    makes = {"aa": "abcde", "bb": "vwxyz", "cc": "éñöab"}
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(rng.randrange(3, 40)))
    rows = [(i, text(makes[lang]), lang) for i, lang in enumerate(rng.choices(list(makes), k=240))] + odd()
    got = language_id.identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert held and all(r["lang_pred"] == r["lang"] for r in held if r["lang"])
    for r in got:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, odd())).collect()} == {"und"}
    assert language_id.identify(frame(spark, [])).count() == 0


def test_kernel_is_the_mean_cosine_of_presence():
    a, b = "the cat", "the hat sat"
    codes = np.unique(np.concatenate([language_id.grams(t, n) for t in (a, b) for n in language_id.ORDERS]))
    x = language_id.presence([a, b], codes).astype(float)
    sets = [[{t[i : i + n] for i in range(len(t) - n + 1)} for n in language_id.ORDERS] for t in (a, b)]
    want = np.mean([len(p & q) / np.sqrt(len(p) * len(q)) for p, q in zip(*sets, strict=True)])
    assert abs(x[0] @ x[1] - want) < 1e-5 and abs(x[0] @ x[0] - 1) < 1e-5


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(300)}"
    rows, marks = [], []
    for i in range(400):
        bad = i % 8 == 0
        words = [word() for _ in range(rng.randrange(20, 80))] + (["Vileword!"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), None))
        if i < 300:
            marks.append((i, 1 - (i % 5 == 0), int(bad)))
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    got = toxicity.predict(frame(spark, rows + odd()), labels, categories).collect()
    assert len(got) == len(rows) + len(ODD)
    fresh = [r for r in got if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    assert all(r["toxic"] == (r["doc_id"] % 8 == 0) for r in fresh)
    assert not any(r["toxic"] for r in got if r["doc_id"] is None or r["doc_id"] >= 1000)
    assert not toxicity.predict(frame(spark, rows), labels.limit(0), categories).where("toxic").count()
    assert toxicity.predict(frame(spark, []), labels, categories).count() == 0
