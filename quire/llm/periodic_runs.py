"""Runs of periodically repeated words, found by block convolution.

Words become numbers. A run is at least three periods long, so for a period in [B, 2B) it holds a block of B words,
aligned to B, that occurs again one period later, inside the two blocks that follow. At every dyadic scale B each block
is compared with all places of these two blocks at once: the sum of squared differences at a distance is a sum of
squares less twice a correlation, and the correlation comes from a number-theoretic transform. Numbers are cut to so
few bits that every sum stays below the modulus, so a zero is exact. Distances with a zero seed the extension word by
word; seeds inside a run that is known already cost a comparison of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime with roots of unity of order 2 ** 27.
MODULUS = 2013265921
_GENERATOR = 31
#: Shortest run, in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Scale that also covers all shorter periods: two blocks and such a period fit into the shortest run.
FIRST_BLOCK = 8
#: Words of documents looked at together, and numbers in one matrix of transforms.
GROUP_WORDS, MATRIX_NUMBERS = 1 << 17, 1 << 17

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@lru_cache(maxsize=64)
def _roots(size: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Factors of each forward and backward step, and the places of the negated frequencies, for one transform size."""
    bits = size.bit_length() - 1
    root = pow(_GENERATOR, (MODULUS - 1) // size, MODULUS)

    def powers(base: int, n: int) -> np.ndarray:
        found = np.ones(n, dtype=np.uint64)
        done = 1
        while done < n:
            found[done : 2 * done] = found[:done] * np.uint64(pow(base, done, MODULUS)) % np.uint64(MODULUS)
            done *= 2
        return found

    forward = [powers(pow(root, 1 << s, MODULUS), size >> (s + 1)) for s in range(bits)]
    inverse = pow(root, MODULUS - 2, MODULUS)
    backward = [powers(pow(inverse, 1 << s, MODULUS), size >> (s + 1)) for s in range(bits)]
    reversed_ = np.zeros(size, dtype=np.int64)
    for i in range(bits):
        reversed_ |= ((np.arange(size) >> i) & 1) << (bits - 1 - i)
    return forward, backward, reversed_[(-reversed_) % size]


def _forward(rows: np.ndarray) -> np.ndarray:
    """Transforms along the middle axis of B numbers below the modulus, zero-padded to 2B; frequencies in bit-reversed order."""
    m = np.uint64(MODULUS)
    outer, half, lanes = rows.shape
    factors = _roots(2 * half)[0]
    out = np.empty((outer, 2 * half, lanes), dtype=np.uint64)
    out[:, :half] = rows
    out[:, half:] = rows * factors[0][:, None] % m  # the padding is zero
    for factor in factors[1:]:
        view = out.reshape(-1, 2, len(factor), lanes)
        low, high = view[:, 0], view[:, 1]
        total, less = low + high, low + (m - high)
        np.minimum(total, total - m, out=low)  # a negative number wraps to a huge one
        np.remainder(less * factor[:, None], m, out=high)
    return out


def _backward(rows: np.ndarray) -> np.ndarray:
    """Inverse transforms times their size, along the middle axis from bit-reversed order."""
    m, rows = np.uint64(MODULUS), np.ascontiguousarray(rows)
    outer, size, lanes = rows.shape
    for factor in reversed(_roots(size)[1]):
        view = rows.reshape(-1, 2, len(factor), lanes)
        low, high = view[:, 0], view[:, 1] * factor[:, None] % m
        total, less = low + high, low + (m - high)
        np.minimum(total, total - m, out=view[:, 0])
        np.minimum(less, less - m, out=view[:, 1])
    return rows


def zero_distances(numbers: np.ndarray, block: int, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start of a block, distance) of all places in [block, 2 * block) at which a block may occur again.

    With ``first`` the distances 1 to ``block`` - 1 are looked at as well. Places where the numbers differ but their
    low bits agree are among them; no place of an occurrence is missing. Beyond the end zeros follow.
    """
    m, size = np.uint64(MODULUS), 2 * block
    bits = (MODULUS.bit_length() - 2 - block.bit_length()) // 2
    if bits < 1:
        raise ValueError("a block this long needs a larger modulus")
    n = -(-len(numbers) // block)
    codes = np.zeros((n + 2) * block, dtype=np.uint64)
    codes[: len(numbers)] = numbers & ((1 << bits) - 1)
    squares = np.concatenate([[np.uint64(0)], np.cumsum(codes * codes)])
    sums = squares[block:] - squares[:-block]  # of the window from each place
    table = codes.reshape(-1, block)
    negated = _roots(size)[2]
    step = max(1, MATRIX_NUMBERS // size)
    for low in range(0, n, step):
        count = min(step, n - low)
        # many blocks lie side by side, few long ones one after another: the innermost loop is long either way
        beside = count >= 32
        chosen = table[low : low + count + 2]
        spectra = _forward(chosen.T[None] if beside else chosen[:, :, None])

        def blocks(after: int) -> np.ndarray:
            return spectra[:, :, after : after + count] if beside else spectra[after : after + count]

        turned = np.take(blocks(0), negated, axis=1)

        def zeros(after: int) -> tuple[np.ndarray, np.ndarray]:
            # the second block lies half a transform further on: its odd frequencies change sign
            one, two = blocks(after), blocks(after + 1)
            window = np.empty(turned.shape, dtype=np.uint64)
            window[:, :block] = one[:, :block] + two[:, :block]
            window[:, block:] = one[:, block:] + (m - two[:, block:])
            correlation = _backward(window % m * turned % m)[:, :block]
            correlation = correlation[0].T if beside else correlation[:, :, 0]
            starts = (low + np.arange(count)) * block
            both = sums[starts][:, None] + sums[starts[:, None] + after * block + np.arange(block)[None, :]]
            # both is less than the modulus, so zero means zero
            rows, at = np.nonzero((both * np.uint64(size) + np.uint64(2) * (m - correlation)) % m == 0)
            return starts[rows], at + after * block

        if first:
            starts, distances = zeros(0)
            yield starts[distances > 0], distances[distances > 0]
        yield zeros(1)


def _equal_steps(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common beginning, compared in pieces that double."""
    done, piece, n = 0, 64, len(left)
    while done < n:
        differ = np.flatnonzero(left[done : done + piece] != right[done : done + piece])
        if len(differ):
            return done + int(differ[0])
        done += piece
        piece *= 2
    return n


class _Document:
    """Runs of one document, from seeds by ascending scale."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.runs: dict[tuple[int, int], int] = {}
        self.seen: dict[int, tuple[int, int]] = {}
        self.known: list[tuple[int, int, int]] = []

    def seed(self, at: int, distance: int, block: int) -> None:
        """Extend a block at ``at`` that may occur again at ``distance``; blocks of a distance come in order."""
        words, end = self.words, at + distance + block
        begin, until = self.seen.get(distance, (0, 0))
        if begin <= at and end <= until:
            return
        for begin, until, period in self.known:
            if begin <= at and end <= until and distance % period == 0:
                return
        if not np.array_equal(words[at : at + block], words[at + distance : end]):
            return
        until = end + _equal_steps(words[at + block : len(words) - distance], words[end:])
        begin = at - _equal_steps(words[:at][::-1], words[distance : at + distance][::-1])
        self.seen[distance] = (begin, until)
        if until - begin >= max(LEAST_WORDS, LEAST_PERIODS * distance):
            # a multiple of the period reaches exactly as far as the period itself
            if distance < self.runs.get((begin, until), distance + 1):
                self.runs[begin, until] = distance
                self.known.append((begin, until, distance))


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of word numbers, by start, then period."""
    docs = [_Document(words) for words in texts]
    longest, block = max(map(len, texts), default=0), FIRST_BLOCK
    while longest >= LEAST_WORDS and (block == FIRST_BLOCK or longest >= LEAST_PERIODS * block):
        # documents too short for this scale take no part
        wanted = [d for d in docs if len(d.words) >= max(LEAST_WORDS, LEAST_PERIODS * block if block > FIRST_BLOCK else 0)]
        starts = np.cumsum([0] + [len(d.words) for d in wanted])
        numbers = np.concatenate([d.words for d in wanted])
        for at, distance in zero_distances(numbers, block, block == FIRST_BLOCK):
            owner = np.searchsorted(starts, at, side="right") - 1
            # a place in the next document is none
            inside = at + distance + block <= starts[owner + 1]
            order = np.lexsort((at[inside], distance[inside], owner[inside]))
            found = (c[inside][order].tolist() for c in (owner, at - starts[owner], distance))
            for doc, begin, gap in zip(*found, strict=True):
                wanted[doc].seed(begin, gap, block)
        block *= 2
    return [sorted((b, e - b, p) for (b, e), p in d.runs.items()) for d in docs]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``runs`` (start, length, period; by start, then period), ``collapsed``.

    Words are the longest stretches without ASCII blanks and line ends. A run is a longest stretch with a smallest
    period q that is at least 24 words and 3 q long. ``collapsed`` joins by one blank the words that no run holds
    after its first period. A null text counts as empty: no words, no runs, an empty string. Keys are taken as they are,
    null or repeated; an empty table gives none; other columns are not looked at. A text of any length is one row and is
    looked at whole, in matrices of bounded size.
    """
    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, n_words bigint, runs {RUNS}, collapsed binary"

    def finished(keys: list, texts: list[list[bytes]], numbers: list[np.ndarray], names: pa.Schema) -> pa.RecordBatch:
        found, collapsed = runs_of(numbers), []
        for words, runs in zip(texts, found, strict=True):
            if runs:
                kept = np.ones(len(words), dtype=bool)
                for start, length, period in runs:
                    kept[start + period : start + length] = False
                words = [words[i] for i in np.flatnonzero(kept)]
            collapsed.append(b" ".join(words))
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
        values = [pa.concat_arrays(keys), pa.array([len(w) for w in texts], pa.int64())]
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        values += [pa.array(rows, pa.list_(run)), pa.array(collapsed, pa.binary())]
        return pa.RecordBatch.from_arrays(values, names=[key, "n_words", "runs", "collapsed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = number = len(self)
                return number

        for batch in batches:
            known, keys, texts, numbers, held = Numbers(), [], [], [], 0
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or b"").split()  # of bytes: at ASCII blanks and line ends only
                keys.append(batch.column(0).slice(i, 1))
                texts.append(words)
                numbers.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
                held += len(words)
                if held >= GROUP_WORDS:
                    yield finished(keys, texts, numbers, batch.schema)
                    known, keys, texts, numbers, held = Numbers(), [], [], [], 0
            if keys:
                yield finished(keys, texts, numbers, batch.schema)

    found = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("binary").alias("_text")).mapInArrow(search, schema)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties: smallest start, then period. Null without runs."""

    def order(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        before = (left > right) | ((left == right) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
        return F.when(before, -1).when(a == b, 0).otherwise(1)

    return F.get(F.array_sort(runs, order), F.lit(0))


def repeat_tail(words: Column, first: Column, period: Column) -> Column:
    """Words of which every one from ``first`` on becomes word first + (i - first) % period: planted runs."""
    place = F.sequence(F.lit(0), F.size(words) - 1)
    return F.transform(place, lambda i: F.get(words, F.when(i >= first, first + (i - first) % period).otherwise(i).cast("int")))
