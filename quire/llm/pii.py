"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

The fixed patterns give seed entities. The words around them are lexical patterns; the words around all other
identifier-like tokens too. Patterns and instances form a graph with counts. In turns a pattern is scored by the share
of its occurrences that known instances fill, and an instance by the patterns it stands in. Tokens that stand in a
pattern of high confidence for a kind, and have the make of that kind, are new identifiers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import joined_spans, store

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
# a run of digits is tried from its start alone: from within it nothing else can match
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
#: Groups of digits joined by blanks, dots, hyphens and brackets.
_GROUPED = re.compile(r"(?<![0-9A-Za-z@])[+(]{0,2}[0-9]+(?:[\x20().-]{1,3}[0-9]+)+(?![0-9A-Za-z@])")
_EDGE = ".,;:!?()[]{}<>\"'"
#: Characters before and after an identifier that its context is taken from.
_REACH = 64
#: Turns of scoring, least confidence, and least number of different known instances behind a pattern.
TURNS = 3
#: A number of fewer digits is no identifier.
LEAST_DIGITS = 6
CONFIDENCE = 0.8
SUPPORT = 3


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end), by start and kind."""
    found = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            low = m.start()
            while low > end and _LOCAL_END.match(text, low - 1):
                low -= 1
            if low < m.start() and m.start() >= end:
                found.append((low, 0, "email", m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the two words before it, and the word before it with the word after it."""
    before = ["", "", *text[max(0, start - _REACH) : start].lower().split()][-2:]
    after = [*text[end : end + _REACH].lower().split(), ""][0]
    return [f"{before[0]} {before[1]} _", f"{before[1]} _ {after}"]


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def identifiers(text: str, base: list[tuple[int, int, str, int]]) -> list[tuple]:
    """Seeds and other identifier-like tokens: (start, end, kind or None, instance, signs, digits, patterns).

    A token is a word, or a number in groups with blanks between them; words of such a number are tokens too.
    Instances and patterns are hashes: words around an identifier may themselves be personal data.
    """
    out = [(s, e, k, _hash(text[s:e]), None, None, list(map(_hash, context(text, s, e)))) for s, _, k, e in base]
    i, reach = 0, 0
    for m in _TOKEN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][3])
            i += 1
        if reach > m.start():
            continue
        token = m[0].lstrip(_EDGE)
        start = m.end() - len(token)
        token = token.rstrip(_EDGE)
        digits = sum("0" <= c <= "9" for c in token)
        if "@" in token or digits >= 4:
            patterns = list(map(_hash, context(text, start, start + len(token))))
            out.append((start, start + len(token), None, _hash(token), token.count("@"), digits, patterns))
    i, reach = 0, 0
    for m in _GROUPED.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][3])
            i += 1
        digits = sum("0" <= c <= "9" for c in m[0])
        if reach <= m.start() and " " in m[0] and digits >= LEAST_DIGITS:
            out.append((m.start(), m.end(), None, _hash(m[0]), 0, digits, list(map(_hash, context(text, m.start(), m.end())))))
    return out


_SPAN = "struct<start:bigint,place:int,kind:string,end:bigint>"
_IDENTIFIER = "struct<start:bigint,end:bigint,kind:string,instance:bigint,signs:int,digits:int,patterns:array<bigint>>"


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, base spans and identifiers of every row, stored with a row number."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases, tokens = [], []
            for body in batch["text"].tolist():
                base = base_spans(body or "")
                bases.append([dict(zip(("start", "place", "kind", "end"), b, strict=True)) for b in base])
                names = ("start", "end", "kind", "instance", "signs", "digits", "patterns")
                tokens.append([dict(zip(names, t, strict=True)) for t in identifiers(body or "", base)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": bases, "tokens": tokens})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInPandas(measure, f"doc_id string, base array<{_SPAN}>, tokens array<{_IDENTIFIER}>")
    # the number is fixed once it is written
    return store(found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id()))


def score_patterns(edges: DataFrame, turns: int = TURNS) -> DataFrame:
    """(pattern, kind, confidence) from (pattern, instance, kind or null, n)."""
    seeds = edges.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    plain = edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n"))
    known, confidence = seeds, None
    for turn in range(turns):
        filled = plain.join(known, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("w"), F.sum("score").alias("support"))
        confidence = store(
            filled.where(F.col("support") >= SUPPORT).join(totals, "pattern")
            .select("pattern", "kind", F.least(F.lit(0.99), F.col("w") / F.col("total") * (1 - 1 / (1 + F.col("support")))).alias("confidence"))
        )
        if turn + 1 == turns:
            break
        doubt = plain.join(confidence, "pattern").groupBy("instance", "kind").agg(F.sum(F.log(1 - F.col("confidence"))).alias("d"))
        fresh = doubt.select("instance", "kind", (1 - F.exp("d")).alias("score")).where(F.col("score") >= CONFIDENCE)
        known = store(seeds.unionByName(fresh).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    return confidence


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, base, found): spans of the fixed patterns and those found by context, per row of ``docs``.

    Null and empty texts have none. Repeated rows count again in the graph and each get their spans; a null doc_id
    stays null; other columns are not looked at. An empty table gives an empty one.
    """
    rows = _measured(docs, text)
    tokens = rows.select("row", F.explode("tokens").alias("t"))
    edges = store(
        tokens.select(F.explode("t.patterns").alias("pattern"), "t.instance", "t.kind").groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))
    )
    sure = score_patterns(edges).where(F.col("confidence") >= CONFIDENCE)
    best = sure.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("pattern", "best.confidence", "best.kind")
    open_ = tokens.where("t.kind is null").select("row", "t.start", "t.end", "t.signs", "t.digits", F.explode("t.patterns").alias("pattern"))
    fits = F.when(F.col("kind") == "email", F.col("signs") == 1).otherwise((F.col("signs") == 0) & (F.col("digits") >= LEAST_DIGITS))
    spans = open_.join(best, "pattern").where(fits).groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("b.kind")).cast("int") - 1
    # a word inside a number in groups that is found too
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("reach", before).where("reach is null or reach < end")
    new = spans.select("row", F.struct("start", place.alias("place"), F.col("b.kind").alias("kind"), "end").cast(_SPAN).alias("s"))
    new = new.groupBy("row").agg(F.collect_list("s").alias("found"))  # a text's own spans
    return rows.join(new, "row", "left").select("doc_id", "base", F.coalesce("found", F.array().cast(f"array<{_SPAN}>")).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    def many(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(many, KINDS), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.concat("base", "found")).alias("spans"))
