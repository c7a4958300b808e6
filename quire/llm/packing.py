"""Packing of token sequences by best-two-fit over the length histogram.

A piece is at most 4096 tokens long, so the histogram has at most 4096 rows for any corpus. The plan is made on it:
bins are filled greedily with the largest length that fits; then the smallest document of a bin makes room for two
unpacked ones that fill the gap more tightly. A bin is used as often as the histogram allows. Pieces are numbered
within their length, in salted groups for long lists, and look up their place by number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import store

CAPACITY = 4096
END_ID = 1
#: Pieces of one length numbered in one task.
ROWS_PER_GROUP = 200_000
#: Entries after which a worker's cache of encoded words starts anew.
CACHE_ENTRIES = 600_000


class Encoder:
    """Token ids of whole texts, as little-endian bytes, with a cache of words.

    Blanks and line ends always part tokens and never yield one, so a text's ids are those of its blank-free stretches
    in turn. A stretch of ASCII letters, perhaps with one closing sign, goes straight to the merges, as lower case.
    """

    _one = None

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's own encoder: it outlives a task."""
        if cls._one is None or cls._one.path != path:
            cls._one = cls(path)
        return cls._one

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            found = np.array([t.id for t in self.model.tokenize(word)], dtype="<u4").tobytes()
            self.words[word] = found
        return found

    def _stretch(self, stretch: str) -> bytes:
        if stretch.isascii():
            if stretch.isalpha():
                return self._word(stretch.lower())
            if stretch[-1] in ".,;:!?" and stretch[:-1].isalpha():
                return self._word(stretch[:-1].lower()) + self._word(stretch[-1])
        return np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        known, parts = self.stretches, text.replace("\n", " ").split(" ")
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        for part in set(parts).difference(known):
            known[part] = self._stretch(part) if part else b""
        return b"".join(map(known.__getitem__, parts))


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every text's ids with the closing id, cut only beyond the capacity.

    Null and empty texts are the closing id alone.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    step = 4 * CAPACITY

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(tokenizer)
        end = int(END_ID).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = encoder.encode(body or "") + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, part) if with_ids else row)
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(encode, schema)


def plan_bins(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how often it is used), for ``counts[length]`` pieces; the last index is the capacity.

    Greedy: the largest length left, then again the largest that fits. Best-two-fit: with the smallest taken out
    again, the two lengths left that fill the gap best take its place if they fill it better.
    """
    left, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    left[0] = 0
    lengths = np.arange(capacity + 1)
    fitting = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the largest length left up to an index
    bins = []

    def took(length: int, n: int = 1) -> None:
        left[length] -= n
        if left[length] == 0:
            high = length
            while high <= capacity and fitting[high] == length:
                high += 1
            fitting[length:high] = fitting[length - 1]

    def gave_back(length: int) -> None:
        left[length] += 1
        if left[length] == 1:
            fitting[length:] = np.maximum(fitting[length:], length)

    while fitting[capacity]:
        bin_, gap = [], capacity
        while length := int(fitting[gap]):
            bin_.append(length)
            gap -= length
            took(length)
        if gap and len(bin_) > 1:
            out = bin_.pop()
            room = gap + out
            first = lengths[1:room][left[1:room] > 0]
            second = fitting[room - first]
            second = np.where((second == first) & (left[first] < 2), fitting[first - 1], second)
            sums = np.where(second > 0, first + second, 0)
            if len(sums) and sums.max() > out:
                best = int(np.argmax(sums))
                bin_ += [int(first[best]), int(second[best])]
                took(bin_[-2])
                took(bin_[-1])
                gave_back(out)
            else:
                bin_.append(out)
        kinds, uses = np.unique(bin_, return_counts=True)
        more = int(min(left[k] // u for k, u in zip(kinds, uses, strict=True)))
        if more:
            for k, u in zip(kinds.tolist(), uses.tolist(), strict=True):
                took(k, u * more)
        bins.append((bin_, 1 + more))
    return bins


def places(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per slot of a plan: its length, the first number of that length it takes, the first sequence and the offset; sorted."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for bin_, times in bins:
        offset = 0
        for length in bin_:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))


def pack(found: DataFrame) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces. Equal pieces are interchangeable; an empty table stays empty."""
    # at most CAPACITY rows, whatever the corpus
    by_length = found.groupBy("length").count().collect()
    counts = np.zeros(CAPACITY + 1, dtype=np.int64)
    for row in by_length:
        counts[row["length"]] = row["count"]
    lengths, firsts, sequences, offsets = places(plan_bins(counts))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32")]
    salts = found.sparkSession.createDataFrame(
        [(r["length"], -(-r["count"] // ROWS_PER_GROUP)) for r in by_length], "length bigint, groups bigint"
    )
    salted = found.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64(*order), "groups")).drop("groups")
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy(*order)
    numbered = salted.withColumn("_n", F.row_number().over(within)).join(starts, ["length", "_salt"])

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        stride = int(counts.max()) + 1
        slot = np.searchsorted(lengths * stride + firsts, length.to_numpy() * stride + number.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[slot] + number.to_numpy() - firsts[slot], "offset": offsets[slot]})

    placed = numbered.withColumn("_place", place("length", F.col("_first") + F.col("_n") - 1))
    return placed.select(*found.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row per piece of every document, with its place.

    Null and empty texts are one id. Repeated rows are packed each. Null ids stay null. Other columns are not looked at.
    """
    return pack(store(pieces(docs, tokenizer, text)))
