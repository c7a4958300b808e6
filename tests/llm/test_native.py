"""URL rules, decontamination and secret scan against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from quire.llm import decontaminate, secrets, shared, url_filters
from quire.llm.queries import URL_RULES

DOCS = "doc_id bigint, text string, k1 string, words string"


def docs(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts, first)], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def test_running_sums(spark):
    row = spark.range(40).select(shared.running_sums(F.sequence(F.lit(1), F.col("id") + 1).cast("array<bigint>")).alias("s")).collect()
    for n, r in enumerate(row):
        assert r["s"] == [k * (k + 1) // 2 for k in range(1, n + 2)]
    assert spark.range(1).select(shared.running_sums(F.array().cast("array<bigint>")).alias("s")).first()["s"] == []


def test_spans_match_re(spark):
    texts = ["", None, "ab12cd345", "7", "x7", "é1ñ22\n333", "1" * 50, " ".join(str(n) for n in range(300))]
    got = docs(spark, texts).select("text", shared.match_spans(F.coalesce("text", F.lit("")), "[0-9]+").alias("s")).collect()
    for r in got:
        assert [(s["start"], s["end"], s["value"]) for s in r["s"]] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", r["text"] or "")]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Net", "http://A.Net/", "http://www.example.net/en/1?q", "http://example.com/de/", "https://x.org/fr/a#b",
            "https://x.org/fr", "http://notnet/", "http://cheap-pills.example.com/en/", "http://spammer.com/", "http://\u212aspam.com/", "http://spam\u212a.com/", "x://net?://org/fr/", "http://net/", "http://net/"]
    pages = spark.createDataFrame([(None if u == "" else i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    rules = url_filters.host_rules(spark, URL_RULES).union(url_filters.word_rules(spark))
    got = url_filters.judge(pages, rules).collect()
    assert len(got) == len(urls)

    def expected(url):
        m = re.search("://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, *max(fits)[1:]
        return host, path, None, "block" if set(re.findall("[a-z0-9]+", host)) & set(url_filters.BLOCKED_HOST_WORDS) else "allow"

    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(r["url"]), r
    assert url_filters.judge(pages.limit(0), rules).count() == 0


def brute_contamination(text, items):
    ws, hit, found = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        n = min(13, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for p in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[p : p + n]) in windows:
                hit.update(range(p, p + n))
                found.add("null" if item is None else str(item))
    return len(ws), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws)


def test_contamination_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "Ünd", "a1", "b", "c", "Ñu"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, make(20)), (2, make(5)), (3, make(13)), (4, ""), (5, None), (None, make(14)), (2, "the of"), (10, "solo")]
    items.append((7, items[0][1]))
    texts = [None, "", "!!!", "THE, of", "solo solo solo", make(400), make(60) + " " + items[0][1] + " " + make(9), items[2][1].upper(), items[5][1] * 3, make(30)] + ["the of the of"] * 5
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs(spark, texts), benchmark).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == brute_contamination(texts[r["doc_id"] - 1], items), r
    empty = decontaminate.contamination(docs(spark, texts), benchmark.limit(0)).collect()
    assert not any(r["contaminated"] or r["n_hit"] for r in empty)
    assert decontaminate.contamination(docs(spark, texts).limit(0), benchmark).count() == 0
    kept = decontaminate.drop_contaminated(docs(spark, texts), benchmark)
    assert kept.columns == ["doc_id", "text", "k1", "words"]
    clean = {i for i, t in enumerate(texts, 1) if not brute_contamination(t, items)[3]}
    assert {r["doc_id"] for r in kept.collect()} == clean


def test_shuffled_joins_agree(spark, monkeypatch):
    rows = docs(spark, ["x the quick brown fox jumps over y", "the lazy dog", None])
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "lazy")], "item_id bigint, text string")
    want = decontaminate.contamination(rows, items).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "broadcast_if_bounded", lambda df: (df, False))
    assert decontaminate.contamination(rows, items).orderBy("doc_id").collect() == want


def test_proximity(spark):
    rows = docs(spark, ["one two three four five six", "six five filler four three two one", "one far away from the rest of it two"])
    phrases = decontaminate.phrases_of(spark.createDataFrame([(1, "one two three four five six")], "item_id bigint, text string"))
    index = decontaminate.build_index(rows, phrases)
    assert decontaminate.exact_matches(index).count() == 1
    near = decontaminate.proximity_matches(index, slop=6, share=0.9).join(index.texts, ["k1", "k2"]).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in near} == {1, 2}


def brute_secrets(text):
    spans = []
    for place, (kind, pattern) in enumerate([("assign", secrets.ASSIGN), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                spans.append((m.start(), place, kind, m.end()))
    return sorted(spans)


def test_secrets_brute_force(spark):
    rng = random.Random(5)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alnum) for _ in range(40)) for _ in range(60)]
    plain = ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "path-to-the-index-page-number-1-of-the-index"]
    pieces = ["password = hunter22x", "PASSWD:'abc'", "token=secret=abcdefgh", "token: secret: abcdefghij", "api_key\": \"ABCDEFGH1\"", "apikey=short",
              "AKIAABCDEFGHIJKL", "AKIAABC", "AKIAAKIAAKIAAKIA1", "0123456789abcdef" * 2, "deadbeef", "ñ", "é\n", "   ", *keys, *plain]
    texts = [None, "", "x" * 50_000] + [" ".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(150)] + ["password=abcdefghi"] * 3
    got = secrets.digest(secrets.scan(docs(spark, texts).withColumn("base", F.lit(1)))).collect()
    assert len(got) == len(texts)
    hit = missed = wrong = 0
    for r in got:
        text = texts[r["doc_id"] - 1] or ""
        base = brute_secrets(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[2] == k for b in base) for k in ("assign", "access", "hex"))
        spans = {tuple(x.split(":")) for x in r["spans"].split(",") if x}
        assert {(k, str(s), str(e)) for s, _, k, e in base} <= spans
        random_spans = {text[int(s) : int(e)] for k, s, e in spans if k == "random"}
        hit += sum(k in random_spans for k in keys if k in text)
        missed += sum(k not in random_spans for k in keys if k in text)
        wrong += sum(p in random_spans for p in plain)
    assert hit > 0.9 * (hit + missed) and wrong == 0
    assert secrets.scan(docs(spark, texts).limit(0)).count() == 0


def test_glued_secrets(spark):
    rng = random.Random(6)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    forms = ["DB_PASS={}", "AUTH={}", "?sig={}", "/api/v1/{}", "/api/v1/my-item_7/{}", "{}/of-a-path", "x=y&sig={}&z=1", "{}"]
    texts, wanted = [], []
    for i in range(160):
        value = key(alnum[:52] if i % 4 == 0 else alnum, 40)
        before, after = forms[i % len(forms)].split("{}")
        texts.append(f"see {before}{value}{after} now")
        wanted.append((4 + len(before), 4 + len(before) + len(value)))
    plain = ["internationalisation", "undschungkeitber Underlichungkeit", "a/path/to/the-index_page/of/the/documentation", "name=value_of_a_setting_here", "4041894974608795"]
    got = secrets.scan(docs(spark, texts + plain)).orderBy("doc_id").collect()
    found = [[(s["start"], s["end"]) for s in r["found"]] for r in got]
    assert not any(found[len(texts) :])
    for form in range(len(forms)):
        of = range(form, len(texts), len(forms))
        assert sum(any(low <= wanted[i][0] and high >= wanted[i][1] for low, high in found[i]) for i in of) >= 0.8 * len(of), forms[form]
    assert all(not (a[0] <= b[0] and b[1] <= a[1]) for f in found for a in f for b in f if a is not b)
