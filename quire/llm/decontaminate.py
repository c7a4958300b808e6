"""Benchmark decontamination with a positional inverted index, on DataFrame functions alone.

Training texts are tokenised once. Of the tokens that the test phrases hold, the corpus counts are taken; each phrase
looks up its two rarest terms. The index stores the postings (text, position) of those terms. Lists are shifted by the
offset of their term in the phrase and intersected from the rarest on; what is left is compared with the words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import ascii_lower, broadcast_if_bounded, store

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["k1", "k2"]
#: Terms of a phrase whose postings are intersected before words are compared.
DEPTH = 2
#: Key buckets that tell, before words are shuffled, which texts can have a place; the list is never longer.
BUCKETS = 1 << 20


def words_of(text: Column) -> Column:
    """Lower-cased runs of characters other than ASCII signs and capitals; none for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: equal texts share their postings."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def phrases_of(items: DataFrame, width: int = 13, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, item): all windows of ``width`` words of an item, or the whole of a shorter one; items without words have none."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text)).alias("words"))
    some = words.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return some.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("phrase")).distinct()


@dataclass
class PositionalIndex:
    """Tokenised texts, the phrases' looked-up terms and the postings of those terms."""

    texts: DataFrame
    terms: DataFrame
    postings: DataFrame


def build_index(docs: DataFrame, phrases: DataFrame, text: str = "text") -> PositionalIndex:
    """Tokenise all texts, count the phrases' terms over them, and store the postings of each phrase's rarest terms."""
    texts = store(docs.select(*text_key(F.col(text)), words_of(F.col(text)).alias("words"), F.col("doc_id")))
    distinct = phrases.select("phrase").distinct()
    terms = distinct.select("phrase", F.posexplode("phrase").alias("offset", "term"))
    known, _ = broadcast_if_bounded(terms.select("term").distinct())
    counts = texts.select(F.explode("words").alias("term")).join(known, "term").groupBy("term").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "offset")
    looked_up = store(
        terms.join(counts, "term", "left").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= DEPTH)
        .select("phrase", "term", "offset", "place")
    )
    wanted, _ = broadcast_if_bounded(looked_up.select("term").distinct())
    postings = store(texts.select(*KEY, F.posexplode("words").alias("pos", "term")).join(wanted, "term").distinct())
    return PositionalIndex(texts, looked_up, postings)


def alignments(index: PositionalIndex, depth: int = DEPTH) -> DataFrame:
    """(k1, k2, phrase, start): places where the ``depth`` rarest terms of a phrase stand as far apart as in the phrase."""
    first = index.terms.where("place = 1").select("phrase", "term", "offset")
    second = index.terms.where("place = 2").select("phrase", F.col("term").alias("other"), F.col("offset").alias("shift"))
    small, _ = broadcast_if_bounded(first.join(second, "phrase", "left"))
    found = index.postings.join(small, "term").where(F.col("pos") >= F.col("offset"))
    found = found.select(*KEY, "phrase", "other", "shift", (F.col("pos") - F.col("offset")).alias("start"))
    if depth < 2:
        return found.drop("other", "shift")
    lists = index.postings.select(*KEY, F.col("term").alias("other"), F.col("pos").alias("at"))
    asked = found.where("other is not null").withColumn("at", F.col("start") + F.col("shift"))
    both = asked.join(lists, [*KEY, "other", "at"], "left_semi").select(*KEY, "phrase", "start")
    return both.unionByName(found.where("other is null").select(*KEY, "phrase", "start"))


def _with_words(index: PositionalIndex, places: DataFrame) -> DataFrame:
    """The places with the words of their texts; only texts with a place are kept."""
    bucket = F.pmod("k1", F.lit(BUCKETS)).cast("int")
    some = F.broadcast(places.select(bucket.alias("bucket")).distinct())  # at most BUCKETS numbers
    one = index.texts.select(*KEY, "words").withColumn("bucket", bucket).join(some, "bucket", "left_semi").drop("bucket")
    return one.join(places.hint("shuffle_hash"), KEY)


def exact_matches(index: PositionalIndex) -> DataFrame:
    """(k1, k2, phrase, start): all occurrences of the phrases; ``start`` counts words from 0."""
    places = _with_words(index, store(alignments(index)))
    return places.where(F.slice("words", F.col("start") + 1, F.size("phrase")) == F.col("phrase")).select(*KEY, "phrase", "start").distinct()


def proximity_matches(index: PositionalIndex, slop: int = 3, share: float = 0.8) -> DataFrame:
    """(k1, k2, phrase, start, n_near): places of the rarest term around which at least ``share`` of the phrase's
    different words stand within its width and ``slop`` more words on either side, in any order."""
    low = F.greatest(F.col("start") - slop, F.lit(0))
    around = F.slice("words", low + 1, F.col("start") + F.size("phrase") + slop - low)
    near = F.size(F.array_intersect("phrase", around))
    places = _with_words(index, store(alignments(index, 1))).select(*KEY, "phrase", "start", near.alias("n_near"))
    return places.where(F.col("n_near") >= share * F.size(F.array_distinct("phrase"))).distinct()


def covered_words(matches: DataFrame) -> DataFrame:
    """(k1, k2, n_hit): words of a text inside any match, each counted once."""
    ends = matches.groupBy(*KEY, "start").agg(F.max(F.col("start") + F.size("phrase")).alias("end"))
    before = Window.partitionBy(*KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    return ends.select(*KEY, F.greatest(F.col("end") - reach, F.lit(0)).alias("n")).groupBy(*KEY).agg(F.sum("n").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, percent: int = 5) -> DataFrame:
    """(k1, k2, doc_id, n_words, n_hit, items, contaminated): one row per row of ``docs``.

    ``items`` are the sorted ids, as strings, of the items that share a window with the text; a null id is "null", and
    a repeated one counts once. Contaminated: some word is hit, and hits are at least ``percent`` of the words. Null,
    empty and sign-only texts have no words; items without words are ignored; either table may be empty.
    """
    phrases = store(phrases_of(items, width))
    index = build_index(docs, phrases)
    matches = store(exact_matches(index))
    hits = covered_words(matches)
    pairs = matches.select(*KEY, "phrase").distinct().join(phrases, "phrase").groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = hits.join(pairs, KEY)
    rows = index.texts.select(*KEY, "doc_id", F.size("words").cast("long").alias("n_words")).join(found, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        *KEY, "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose texts are not contaminated, with all their columns."""
    bad = contamination(docs, items).where("contaminated").select(*KEY).distinct()
    k1, k2 = text_key(F.col("text"))
    keyed = docs.withColumns({"_quire_k1": k1, "_quire_k2": k2})
    left = keyed.join(bad, (keyed["_quire_k1"] == bad["k1"]) & (keyed["_quire_k2"] == bad["k2"]), "left_anti")
    return left.drop("_quire_k1", "_quire_k2")


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
