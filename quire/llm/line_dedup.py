"""Removal of repeated passages of whole lines by content-defined windows of lines.

A passage is a run of lines with enough words. From every line on, the shortest run with as many words is a window, and
so is the shortest run up to every line. Windows depend on the lines inside them alone, and every passage is the union
of the windows inside it; so a line is in a passage that occurs before just where it is in a window that does. A window
that occurs again anywhere is a repeat but for its first occurrence and what overlaps that. Lines in repeats are
removed, after their bytes have been compared with the lines of the first occurrence. Blank lines have no part in
windows and comparison; those after a line go with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import store

#: Lines that a rolling hash spans.
WINDOW = 2
#: A rolling hash makes a boundary at one place in so many.
DIVISOR = 2
MAX_LINES = 16
#: A line of as many words is a chunk of its own.
LONG_WORDS = 20
#: Passages of fewer words stay: a window has as many.
MIN_WORDS = 50
_MASK = 0xFFFFFFFFFFFFFFFF


def chunk_bounds(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of every chunk. Boundaries are chosen on the lines that are not blank; blank
    lines stay with the line before them, or with the first chunk. For callers that want disjoint chunks;
    ``remove_repeats`` looks at windows, which no neighbouring line can shift."""
    places = [i for i, line in enumerate(lines) if line.strip()]
    hashes = [xxhash.xxh3_64_intdigest(lines[i]) for i in places]
    pairs = [(h * 31 + g) & _MASK for h, g in zip(hashes, hashes[WINDOW - 1 :], strict=False)]  # of lines i and i + 1
    chosen = [(p >> 17) % DIVISOR == 0 for p in pairs]
    long = [lines[i].count(b" ") + lines[i].count(b"\t") >= LONG_WORDS - 1 for i in places]
    bounds, start, first, last = [], 0, 0, len(places) - 1
    for i in range(last):
        before, after = i > 0 and chosen[i - 1], i + 1 < last and chosen[i + 1]
        if before or after or long[i] or long[i + 1] or i + 1 - first >= MAX_LINES:
            bounds.append((start, places[i + 1]))
            start, first = places[i + 1], i + 1
    bounds.append((start, len(lines)))
    return bounds


def worded(text: str | None) -> tuple[list[bytes], list[int]]:
    """All lines of a text, and the places of those that are not blank."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip()]


def windows(sizes: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first line, line after the last) of the shortest runs of ``min_words`` from every line on and up to every line,
    by the numbers of words of the lines that are not blank."""
    found, total, high = set(), 0, 0
    for low, size in enumerate(sizes):
        while high < len(sizes) and total < min_words:
            total += sizes[high]
            high += 1
        if total < min_words:
            break
        found.add((low, high))
        total -= size
    total = low = 0
    for last, size in enumerate(sizes):
        total += size
        while total - sizes[low] >= min_words and low < last:
            total -= sizes[low]
            low += 1
        if total >= min_words:
            found.add((low, last + 1))
    return sorted(found)


def pieces(repeats: list[tuple[int, int, tuple]]) -> list[tuple[int, int, tuple, int]]:
    """(first line, line after the last, text of the first occurrence, its first line): lines in repeats, each once.

    ``repeats``: (first line, line after the last, (text, first line) of the first occurrence).
    """
    found, end = [], 0
    for low, high, (text, at) in sorted(repeats, key=lambda r: r[:2]):
        begin = max(low, end)
        if begin >= high:
            continue
        at += begin - low
        if found and found[-1][1] == begin and found[-1][2] == text and found[-1][3] + begin - found[-1][0] == at:
            begin, _, _, at = found.pop()
        found.append((begin, high, text, at))
        end = high
    return found


def _keys(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _occurrences(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, t1, t2, low, high, h1, h2): the windows of every text, counted in lines that are not blank, with 128
    bits of their lines."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, lows, highs, digests = [], [], [], []
            for i, body in enumerate(batch["text"].tolist()):
                lines, places = worded(body)
                hashed = b"".join(xxhash.xxh3_128_digest(lines[k]) for k in places)
                for low, high in windows([len(lines[k].split()) for k in places], min_words):
                    owner.append(i)
                    lows.append(low)
                    highs.append(high)
                    digests.append(hashlib.blake2b(hashed[16 * low : 16 * high], digest_size=16).digest())
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            own = batch[["doc_id", "t1", "t2"]].iloc[owner].reset_index(drop=True)
            yield own.assign(low=np.array(lows, dtype=np.int32), high=np.array(highs, dtype=np.int32), h1=h[:, 0], h2=h[:, 1])

    return rows.select("doc_id", "t1", "t2", "text").mapInPandas(cut, "doc_id string, t1 bigint, t2 bigint, low int, high int, h1 bigint, h2 bigint")


_ONE = "o_key string, o1 bigint, o2 bigint"


def _pieces(gone: DataFrame) -> DataFrame:
    """(_key, t1, t2, low, high, o_key, o1, o2, at): the pieces of every text, from its repeats."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *text, items in zip(*(batch[c].tolist() for c in ("_key", "t1", "t2", "repeats")), strict=True):
                found = pieces([(w["low"], w["high"], ((w["o_key"], w["o1"], w["o2"]), w["at"])) for w in items])
                out += [(*text, low, high, *one, at) for low, high, one, at in found]
            yield pd.DataFrame(out, columns=["_key", "t1", "t2", "low", "high", "o_key", "o1", "o2", "at"])

    own = gone.groupBy("_key", "t1", "t2").agg(F.collect_list(F.struct("low", "high", "o_key", "o1", "o2", "at")).alias("repeats"))  # a text's own windows
    return own.mapInPandas(merge, f"_key string, t1 bigint, t2 bigint, low int, high int, {_ONE}, at int")


def _lines_of(rows: DataFrame, work: DataFrame) -> DataFrame:
    """(_key, t1, t2, low, high, o_key, o1, o2, at, body): the lines that ``work`` lists per text, with the blank lines
    after them and before the first. Lines of a first occurrence have no low."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *text, body, items in zip(*(batch[c].tolist() for c in ("_key", "t1", "t2", "text", "work")), strict=True):
                lines, places = worded(body)
                ends = [0, *places[1:], len(lines)]
                for w in items:
                    for k in range(w["low"], w["high"]):
                        of = (None, None, *text, k) if w["first"] else (ends[k], ends[k + 1], w["o_key"], w["o1"], w["o2"], w["at"] + k - w["low"])
                        out.append((*text, *of, lines[places[k]]))
            frame = pd.DataFrame(out, columns=["_key", "t1", "t2", "low", "high", "o_key", "o1", "o2", "at", "body"])
            yield frame.astype({"low": "Int32", "high": "Int32"})

    joined = rows.join(work.hint("shuffle_hash"), ["_key", "t1", "t2"]).select("_key", "t1", "t2", "text", "work")
    return joined.mapInPandas(fetch, f"_key string, t1 bigint, t2 bigint, low int, high int, {_ONE}, at int, body binary")


def repeated_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_key, t1, t2, low, high): ranges of lines in passages of ``min_words`` that occur before, whose bytes equal the
    first occurrence's. First is the smallest doc_id (as a number, nulls last), then text hash, then line. A window that
    overlaps its first occurrence is none of its repeats."""
    found = store(_occurrences(rows, min_words))
    place = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "t1", "t2", "low")  # wholly equal rows count once
    # stored, so that the joins with what many texts hold can be split
    again = store(found.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h1", "h2"))
    listed = store(found.join(again, ["h1", "h2"]))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("decimal(38,0)"), "doc_id", "t1", "t2", "low", "high")
    known = store(listed.groupBy("h1", "h2").agg(F.min(order).alias("one")))
    inside = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("t1") == F.col("one.t1")) & (F.col("t2") == F.col("one.t2"))
    one = [F.coalesce("one.doc_id", F.lit("")).alias("o_key"), F.col("one.t1").alias("o1"), F.col("one.t2").alias("o2"), F.col("one.low").alias("at")]
    gone = listed.join(known, ["h1", "h2"]).where(~inside | (F.col("low") >= F.col("one.high"))).select(_doc_key(), "t1", "t2", "low", "high", *one).distinct()
    cut = store(_pieces(gone))
    ones = cut.select("o_key", "o1", "o2", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("high") - F.col("low") - 1)).alias("at")).distinct()
    ones = ones.select(F.col("o_key").alias("_key"), F.col("o1").alias("t1"), F.col("o2").alias("t2"), F.col("at").alias("low"), (F.col("at") + 1).alias("high"), "o_key", "o1", "o2", "at", F.lit(True).alias("first"))
    wanted = cut.withColumn("first", F.lit(False)).unionByName(ones)
    work = wanted.groupBy("_key", "t1", "t2").agg(F.collect_list(F.struct("low", "high", "o_key", "o1", "o2", "at", "first")).alias("work"))  # a text's own lines
    lines = store(_lines_of(rows, work))
    at = ["o_key", "o1", "o2", "at"]
    firsts = lines.where("low is null").select(*at, F.col("body").alias("one")).dropDuplicates(at)
    same = lines.where("low is not null").join(firsts, at).where("body = one").select("_key", "t1", "t2", "low", "high").distinct()
    # neighbouring lines make one range
    by_text = Window.partitionBy("_key", "t1", "t2").orderBy("low")
    apart = same.withColumn("apart", F.coalesce((F.col("low") != F.lag("high").over(by_text)).cast("int"), F.lit(1)))
    ranges = apart.withColumn("run", F.sum("apart").over(by_text)).groupBy("_key", "t1", "t2", "run")
    return ranges.agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def _doc_key() -> Column:
    return F.coalesce("doc_id", F.lit("")).alias("_key")


def remove_repeats(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with all columns, ``text`` without repeated passages, and ``_lines`` and ``_removed``: the
    numbers of lines before and of lines removed.

    A null text stays null and has no lines; a text whose lines all repeat becomes empty. Wholly equal (doc_id, text)
    rows count as one document, and each keeps what it keeps. Shorter passages stay. An empty table gives an empty one.
    Input columns named _lines or _removed are replaced; the prefix _quire_ is reserved.
    """
    others = [c for c in docs.columns if c not in ("_lines", "_removed")]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"), *_keys(text), F.col(text).alias("text"))
    gone = store(repeated_lines(rows, min_words))
    cuts = gone.groupBy("_key", "t1", "t2").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))
    cuts = cuts.select(F.col("_key").alias("_quire_qk"), F.col("t1").alias("_quire_q1"), F.col("t2").alias("_quire_q2"), F.col("cuts").alias("_quire_cuts"))
    keyed = docs.select(*others, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_quire_k"), F.xxhash64(text).alias("_quire_t1"), F.xxhash64(F.lit(7), text).alias("_quire_t2"))
    same = (F.col("_quire_k") == F.col("_quire_qk")) & (F.col("_quire_t1") == F.col("_quire_q1")) & (F.col("_quire_t2") == F.col("_quire_q2"))
    joined = keyed.join(cuts.hint("shuffle_hash"), same, "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda _, i: ~F.exists("_quire_cuts", lambda c: (i >= c["low"]) & (i < c["high"])))
    cleaned = F.when(F.col("_quire_cuts").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate("_quire_cuts", F.lit(0), lambda a, c: a + c["high"] - c["low"]), F.lit(0))
    count = F.when(F.col(text).isNull(), 0).otherwise(F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    return joined.select(*[cleaned.alias(text) if c == text else F.col(c) for c in others], count.cast("long").alias("_lines"), removed.cast("long").alias("_removed"))
