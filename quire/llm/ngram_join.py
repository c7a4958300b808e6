"""Exact Jaccard join of word-shingle sets by vertical partitioning.

The hashes of all shingles stand in one global order, which is cut into fragments of even load. A set sends each
fragment the part of its shingles that lies there. A fragment counts how many sets hold each of its shingles and
returns, per set, those that other sets hold too; summed over the fragments they bound the overlap with any other set,
and most sets end there. The rest are joined on the rarest shingles that a link must touch. Pairs are counted fragment
by fragment of the order and the partial overlaps summed.

Groups of thousands of near copies would make all pairs. So members are first compared with a few hubs per shingle,
and linked ones become one component; only pairs across components are compared after that. Links inside a component
change nothing in the result, and all others are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quire.llm import components
from quire.llm.shared import broadcast_if_bounded, squeezed, store, unsqueezed

#: Shingles that one fragment holds, on average.
FRAGMENT_SHINGLES = 1_500_000
#: A task packs the parts of so many shingles at once, whatever the batch holds.
PACKED_SHINGLES = 1_000_000
#: Bits of a shingle's hash that cross the wire; its fragment gives the others.
SENT_BITS = 40
#: Fragments in which a pair's overlap is counted: the low bits of a shingle's number.
PAIR_FRAGMENT_BITS = 3
#: Longs of the bitmap that bounds an overlap before it is counted.
BITMAP_LONGS = 8
#: Members of a shingle that all others are compared with in one round.
HUBS = 4
#: Hub rounds end when the pairs left are at most this many times the rows they come from.
PAIRS_PER_ROW = 4
MAX_HUB_ROUNDS = 3
#: They also end when fewer than one in so many compared pairs links, or a round takes away fewer pairs than it reads rows.
BARREN_SHARE = 20
#: A set's rarest shingles at which it is compared across components before all others.
FIRST_SHINGLES = 2
CACHE_ENTRIES = 100_000
_BASE = 0x9E3779B97F4A7C15


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    mixed = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(_BASE) + hashes[i : len(words) - width + 1 + i]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _key(hashes: np.ndarray) -> int:
    """64 bits of a set, as a signed number."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sets_of(docs: DataFrame, text: str = "text", size: int = 5) -> DataFrame:
    """(doc_id, t1, t2, n, key): 128 bits of each row's text and 64 of its set; n is the size of the set."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(len(hashes), _key(hashes)) for hashes in (shingle_hashes(body, size) for body in batch["text"])]
            yield batch[["doc_id", "t1", "t2"]].assign(n=[n for n, _ in found], key=[key for _, key in found])

    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), F.col(text).alias("text")
    )
    found = rows.mapInPandas(measure, "doc_id string, t1 bigint, t2 bigint, n bigint, key bigint")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _sent(hashes: np.ndarray) -> bytes:
    """The low 40 bits of each hash."""
    return hashes.astype("<u8").view("u1").reshape(-1, 8)[:, : SENT_BITS // 8].tobytes()


def _received(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, dtype="u1").reshape(-1, SENT_BITS // 8)
    whole = np.zeros((len(rows), 8), dtype="u1")
    whole[:, : SENT_BITS // 8] = rows
    return whole.view("<u8").ravel()


def _packed(keys: list[int], parts: list[np.ndarray], fragments: int) -> pd.DataFrame:
    """One row a fragment: the keys of its sets, how many shingles of each lie in it, and those."""
    hashes, owner = np.concatenate(parts), np.repeat(np.arange(len(keys), dtype=np.int32), [len(p) for p in parts])
    fragment = (((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(fragment, kind="stable")
    hashes, owner, fragment = hashes[order], owner[order], fragment[order]
    key = np.array(keys, dtype="<i8")
    bounds = np.flatnonzero(np.diff(fragment)) + 1
    rows = []
    for low, high in zip([0, *bounds], [*bounds, len(fragment)], strict=True):
        own, counts = np.unique(owner[low:high], return_counts=True)  # owners are in order: so are the counts
        rows.append((int(fragment[low]), key[own].tobytes(), squeezed(counts), _sent(hashes[low:high])))
    return pd.DataFrame(rows, columns=["fragment", "keys", "counts", "hashes"])


def _segments(docs: DataFrame, fragments: int, text: str, size: int) -> DataFrame:
    """(fragment, keys, counts, hashes): the parts of many sets that lie in one fragment, as packed arrays."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            keys, parts, held = [], [], 0
            for body in batch["text"]:
                hashes = shingle_hashes(body, size)
                key = _key(hashes)
                if not len(hashes) or key in seen:
                    continue
                if len(seen) >= CACHE_ENTRIES:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                parts.append(hashes)
                held += len(hashes)
                if held >= PACKED_SHINGLES:
                    yield _packed(keys, parts, fragments)
                    keys, parts, held = [], [], 0
            if keys:
                yield _packed(keys, parts, fragments)

    return docs.select(F.col(text).alias("text")).mapInPandas(cut, "fragment int, keys binary, counts binary, hashes binary")


def _unpacked(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of packed rows."""
    return np.frombuffer(b"".join(group["keys"]), dtype="<i8"), np.concatenate([unsqueezed(c) for c in group["counts"]])


def _shared_of_fragment(buckets: int):
    """Of one fragment: the shingles that at least two sets hold, and how many hold each; packed by bucket of the sets.

    From here on a shared shingle is its rank among those of its fragment: a small number that means the same for all.
    """

    def count(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _unpacked(group)
        hashes = _received(b"".join(group["hashes"]))
        _, first = np.unique(keys, return_index=True)
        once = np.zeros(len(keys), dtype=bool)  # a set may have come from several tasks
        once[first] = True
        if not once.all():
            hashes = hashes[np.repeat(once, counts)]
            keys, counts = keys[once], counts[once]
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        held = np.diff(edges).astype(np.uint32)
        holders, ranks = np.empty(len(hashes), dtype=np.uint32), np.empty(len(hashes), dtype=np.uint32)
        holders[order] = np.repeat(held, held)
        ranks[order] = np.repeat(np.cumsum(held > 1).astype(np.uint32) - np.uint32(1), held)
        del order, ordered, edges, held, hashes
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
        shared = holders > 1
        ranks, holders, owner = ranks[shared], holders[shared], owner[shared]
        bucket = (keys.view("<u8") % np.uint64(buckets)).astype(np.int32)[owner]
        by_bucket = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.diff(bucket[by_bucket])) + 1
        rows = []
        for part in np.split(by_bucket, bounds) if len(by_bucket) else []:
            own, n = np.unique(owner[part], return_counts=True)
            rows.append((int(bucket[part[0]]), int(group["fragment"].iat[0]), keys[own].tobytes(), squeezed(n), squeezed(ranks[part]), squeezed(holders[part])))
        return pd.DataFrame(rows, columns=["bucket", "fragment", "keys", "counts", "ranks", "holders"])

    return count


def _survivors_of_bucket(percent: int):
    """Sums what the fragments counted per set; sets that can link, with their shared shingles from the rarest on."""

    def select(group: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "n", "hashes", "bits"]
        if not len(group):
            return pd.DataFrame([], columns=columns)
        keys, counts = _unpacked(group)
        known = sizes["key"].to_numpy()
        order = np.argsort(known)
        known, n = known[order], sizes["n"].to_numpy()[order]
        ids, same = np.unique(keys, return_inverse=True)
        n = n[np.searchsorted(known, ids)]
        enough = np.bincount(same, weights=counts) * 100 >= n * percent
        owner, hashes, holders = [], [], []
        at = 0
        for row in group.itertuples():  # a row of a fragment at a time: most of it goes at once
            size = len(row.keys) // 8
            own = np.repeat(same[at : at + size], counts[at : at + size])
            keep = enough[own]
            owner.append(own[keep])
            hashes.append(unsqueezed(row.ranks)[keep].astype(np.uint64) | (np.uint64(row.fragment) << np.uint64(32)))
            holders.append(unsqueezed(row.holders)[keep])
            at += size
        owner, hashes, holders = (np.concatenate(x) for x in (owner, hashes, holders))
        order = np.lexsort((hashes, holders, owner))
        owner, hashes = owner[order], hashes[order]
        rows = []
        for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1) if len(owner) else []:
            own, i = hashes[part], owner[part[0]]
            bits = np.zeros(BITMAP_LONGS, dtype=np.uint64)
            np.bitwise_or.at(bits, ((own >> np.uint64(6)) % np.uint64(BITMAP_LONGS)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
            rows.append((ids[i], n[i], own.view(np.int64), bits.view(np.int64)))
        return pd.DataFrame(rows, columns=columns)

    return select


def survivors(docs: DataFrame, sets: DataFrame, percent: int, text: str, size: int) -> DataFrame:
    """(id, n, hashes, bits): sets that share at least ``percent`` of their shingles with others; the shared ones from
    the rarest on, and a bitmap of them. ``sets`` has (key, n) of every row."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    fragments = max(1, -(-total // FRAGMENT_SHINGLES))
    shared = (
        _segments(docs, fragments, text, size)
        .groupBy("fragment")
        .applyInPandas(_shared_of_fragment(fragments), "bucket int, fragment int, keys binary, counts binary, ranks binary, holders binary")
    )
    # the keys in unsigned order are what numpy sees; pmod of the signed number does not agree with it
    bucket = (F.pmod(F.shiftrightunsigned("key", 1) % fragments * 2 + F.col("key").bitwiseAND(1), F.lit(fragments))).cast("int")
    sizes = sets.where("n > 0").select("key", "n").distinct().withColumn("bucket", bucket)
    schema = "id bigint, n bigint, hashes array<bigint>, bits array<bigint>"
    return shared.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInPandas(_survivors_of_bucket(percent), schema)


def _needed(n: Column, percent: int) -> Column:
    """The least overlap that a set of ``n`` shingles needs with any partner."""
    return F.ceil(n * percent / 100).cast("int")


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs that link: overlaps are counted per fragment and summed."""
    met, _ = broadcast_if_bounded(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct())
    cut = F.transform(
        F.sequence(F.lit(0), F.lit((1 << PAIR_FRAGMENT_BITS) - 1)),
        lambda i: F.struct(
            i.alias("fragment"),
            F.filter("hashes", lambda h: h.bitwiseAND((1 << PAIR_FRAGMENT_BITS) - 1) == i).alias("hashes"),
        ),
    )
    parts = sets.join(met, "id", "left_semi").select("id", "n", F.inline(cut)).where(F.size("hashes") > 0)
    left = parts.select(F.col("id").alias("u"), F.col("n").alias("n_u"), "fragment", F.col("hashes").alias("h_u"))
    right = parts.select(F.col("id").alias("v"), F.col("n").alias("n_v"), "fragment", F.col("hashes").alias("h_v"))
    partial = pairs.join(left, "u").join(right, ["v", "fragment"]).select("u", "v", "n_u", "n_v", F.size(F.array_intersect("h_u", "h_v")).alias("o"))
    summed = partial.groupBy("u", "v", "n_u", "n_v").agg(F.sum("o").alias("o"))
    return summed.where(F.col("o") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("o")) * percent).select("u", "v")


def _near(most: Column, percent: int) -> Column:
    """Whether two sets with at most so many common shingles can still link."""
    return most * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent


def _common(m: str, one: str, other: str) -> Column:
    """Most common shingles by the bitmaps: a bit that only one has stands for a shingle that only one set holds."""
    alone = [F.bit_count(F.col(one)[i].bitwiseAND(F.bitwise_not(F.col(other)[i]))) for i in range(BITMAP_LONGS)]
    return F.col(m) - sum(alone[1:], alone[0])


_COMMON = [("m_u", "b_u", "b_v"), ("m_v", "b_v", "b_u")]


def _possible(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): distinct pairs of those that met, without the ones whose bitmaps rule a link out."""
    bits, _ = broadcast_if_bounded(sets.select("id", "n", F.size("hashes").alias("m"), "bits"))
    u = bits.select(F.col("id").alias("u"), F.col("n").alias("n_u"), F.col("m").alias("m_u"), F.col("bits").alias("b_u"))
    v = bits.select(F.col("id").alias("v"), F.col("n").alias("n_v"), F.col("m").alias("m_v"), F.col("bits").alias("b_v"))

    rows = met.select("u", "v").distinct().join(u, "u").join(v, "v")
    return rows.where(_near(F.least(*[_common(*names) for names in _COMMON]), percent)).select("u", "v")


def _merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) after the links have joined components."""
    u = members.select(F.col("id").alias("u"), F.col("comp").alias("cu"))
    v = members.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
    edges = links.join(u, "u").join(v, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    roots = components.label(edges).select(F.col("u").alias("comp"), F.col("v").alias("root"))
    return store(members.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))


def set_components(sets: DataFrame, percent: int) -> DataFrame:
    """(id, comp) of the surviving sets; ``comp`` is the smallest id that links reach.

    Rows are (hash, id, n, rest): ``rest`` counts a set's shared shingles from this one on, so at the first shingle that
    two sets both hold, no more than the smaller rest can be common.
    """
    sets = store(sets)
    m = F.size("hashes")
    prefix = sets.select("id", F.col("n").cast("int").alias("n"), m.alias("m"), F.posexplode(F.slice("hashes", F.lit(1), m - _needed(F.col("n"), percent) + 1)).alias("at", "hash"))
    rows = prefix.select("hash", "id", "n", (F.col("m") - F.col("at")).alias("rest"), F.col("id").alias("comp"))
    members = store(sets.select("id", F.col("id").alias("comp")))
    rows, left = _open(rows, single=True)
    for turn in range(MAX_HUB_ROUNDS):
        if not left["pairs"]:
            return members
        if left["pairs"] <= PAIRS_PER_ROW * left["rows"]:
            break
        drawn = Window.partitionBy("hash").orderBy(F.xxhash64(F.lit(turn), "id"), "id")
        hubs = rows.withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= HUBS)
        pairs = store(_possible(_across(rows, hubs, F.lit(True), percent), sets, percent))
        links = store(_overlaps(pairs, sets, percent))
        members = _merged(members, links)
        before = left
        rows, left = _open(_renamed(rows, members))
        # shingles of many sets that do not link: another round would read all rows again for next to nothing
        if links.count() * BARREN_SHARE < pairs.count() or before["pairs"] - (left["pairs"] or 0) < before["rows"]:
            break
    # all pairs across components: one of the two is not in the largest component of their shingle
    once = (F.col("cv") == F.col("top")) | (F.col("u") < F.col("v"))
    # the rarest shingles of a set first: what links there joins its component and meets no more of it
    rarest = Window.partitionBy("id").orderBy(F.col("rest").desc(), "hash")
    first = rows.where("comp != top").withColumn("_n", F.row_number().over(rarest)).where(F.col("_n") <= FIRST_SHINGLES)
    tried = store(_across(first, rows, once, percent, sets).distinct())
    members = _merged(members, store(_overlaps(tried, sets, percent)))
    rows, left = _open(_renamed(rows, members))
    if not left["pairs"]:
        return members
    met = _across(rows.where("comp != top"), rows, once, percent, sets).distinct()
    pairs = store(met.join(tried, ["u", "v"], "left_anti"))
    return _merged(members, store(_overlaps(pairs, sets, percent)))


def _renamed(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with the components of now; written, as :func:`_open` reads them twice."""
    return store(rows.select("hash", "id", "n", "rest").join(broadcast_if_bounded(members)[0], "id"))


def _open(rows: DataFrame, single: bool = False) -> tuple[DataFrame, Row]:
    """Rows of the shingles that several components hold, with the largest of them as ``top``, and how many pairs they make.

    A shingle of one component stays so, so later rounds look at these alone. ``single``: each set is a component.
    """
    counted = rows.withColumn("c", F.lit(1.0)) if single else rows.groupBy("hash", "comp").agg(F.count("*").cast("double").alias("c"))
    top = F.max_by("comp", F.struct("c", "comp")).alias("top")
    found = counted.groupBy("hash").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("comps"), top)
    found = store(found.where("comps > 1"))
    left = found.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs"), F.sum("s").alias("rows")).first()
    return store(rows.select("hash", "id", "n", "rest", "comp").join(found.select("hash", "top"), "hash")), left


def _across(one: DataFrame, other: DataFrame, once: Column, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """(u, v): sets of different components that meet at a shingle and may link; the smaller id first.

    With ``sets`` their bitmaps are compared where they meet, so that what cannot link makes no row.
    """
    u = one.select(F.col("id").alias("u"), F.col("hash").alias("hu"), F.col("n").alias("n_u"), F.col("rest").alias("rest_u"), F.col("comp").alias("cu"))
    v = other.select(F.col("id").alias("v"), F.col("hash").alias("hv"), F.col("n").alias("n_v"), F.col("rest").alias("rest_v"), F.col("comp").alias("cv"), "top")
    most = [F.col("rest_u"), F.col("rest_v")]
    if sets is not None:
        bits, _ = broadcast_if_bounded(sets.select("id", F.size("hashes").alias("m"), "bits"))
        u = u.join(bits.select(F.col("id").alias("u"), F.col("m").alias("m_u"), F.col("bits").alias("b_u")), "u")
        v = v.join(bits.select(F.col("id").alias("v"), F.col("m").alias("m_v"), F.col("bits").alias("b_v")), "v")
        most += [_common(*names) for names in _COMMON]
    met = u.join(v, (F.col("hu") == F.col("hv")) & (F.col("cu") != F.col("cv")) & once & _near(F.least(*most), percent))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def link_documents(docs: DataFrame, percent: int = 80, size: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, t1, t2, n_shingles, component_id): one row per row of ``docs``.

    Two rows link when the Jaccard similarity of their shingle sets is at least ``percent`` hundredths;
    ``component_id`` is the smallest doc_id that links reach. Null, empty and blank texts have no shingles and link
    with nothing: their component is their own doc_id. Rows with equal sets, repeated rows among them, are linked.
    Null doc_ids are passed over in the minimum; a component of them alone has a null id. An empty table gives none.
    """
    rows = store(sets_of(docs, text, size))
    found = set_components(survivors(docs, rows, percent, text, size), percent)
    joined = rows.join(found.select(F.col("id").alias("key"), "comp"), "key", "left")
    named = joined.select("doc_id", "t1", "t2", "n", F.coalesce("comp", "key").alias("comp"))
    # written first, so that the rows of a large component can be dealt to several tasks
    least = store(named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least")))
    alone = named.where("n = 0").select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return (
        named.where("n > 0").join(least, "comp").select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
        .unionByName(alone)
    )


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5, text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that of the smallest doc_id (nulls last), then of the
    smallest text hash. Of wholly equal rows one stays. Documents without words all stay, but for equal rows."""
    linked = store(link_documents(docs, percent, size, text))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")
    known = F.when(F.col("n_shingles") > 0, F.struct(F.lit(0).alias("a"), F.col("component_id").alias("b"), F.lit(0).cast("long").alias("c")))
    group = F.coalesce(known, F.struct(F.lit(1).alias("a"), F.col("doc_id").alias("b"), F.col("t1").alias("c")))
    # a component of null ids alone is told apart by its text
    group = F.when(F.col("component_id").isNull(), F.struct(F.lit(2).alias("a"), F.col("t1").alias("b"), F.col("t2").alias("c"))).otherwise(group)
    first = linked.groupBy(group.alias("g")).agg(F.min(order).alias("first")).select("first.doc_id", "first.t1", "first.t2")
    first = store(first.select(F.col("doc_id").alias("_quire_d"), F.col("t1").alias("_quire_t1"), F.col("t2").alias("_quire_t2")))
    keyed = docs.withColumns({"_quire_q1": F.xxhash64(text), "_quire_q2": F.xxhash64(F.lit(7), text)})
    same = keyed["doc_id"].eqNullSafe(first["_quire_d"]) & (keyed["_quire_q1"] == first["_quire_t1"]) & (keyed["_quire_q2"] == first["_quire_t2"])
    kept = keyed.join(first, same, "left_semi")
    twice = linked.groupBy("doc_id", "t1", "t2").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", "_quire_q1", "_quire_q2"]) if twice else kept).drop("_quire_q1", "_quire_q2")
