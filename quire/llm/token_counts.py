"""Token counts of texts, from pieces counted once per distinct pre-token.

Documents are gathered into blocks of bounded size. A block keeps its distinct pre-tokens and, packed, how often each
of its documents holds each of them: that table is written once. The pre-tokens of all blocks meet in a shuffle of
short words; equal ones lie side by side there, each is cut into pieces once, in the whole corpus, and only its number
of pieces goes back. Joined to the blocks, a document's count is the sum of frequency times pieces. No token id of a
document is ever made, and the texts are not shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import squeezed, store, unsqueezed

#: A block is closed after the document with which it reaches this many characters, or this many documents.
BLOCK_CHARS = 12 << 20
BLOCK_DOCS = 100_000

#: Code points that may be letters standing for themselves, and signs that may close a word.
LETTERS = range(0x41, 0x250)
SIGNS = ".,;:!?"

_BLOCKS = "doc_ids array<bigint>, n_bytes array<bigint>, sizes binary, places binary, times binary, words array<string>"


class PreTokens:
    """Pre-tokens of texts as the tokenizer itself finds them.

    Blanks and line ends always part pre-tokens and are in none, so a text's pre-tokens are those of its blank-free
    stretches. Added tokens, such as special strings inside texts, are matched first, as they are by the library.
    """

    _one = None

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        #: What must not be joined to others by blanks.
        self.apart = regex.compile("|".join([r"[\s\x1c-\x1f]", *map(regex.escape, longest_first)]))
        # Letters that stand for themselves, alone or between others, and signs that part from letters: asked of the tokenizer once.
        letters = [c for c in map(chr, LETTERS) if c.isalpha()]
        alone = {c: self._find(c) for c in letters}
        plain = {c: w[0] for c, w in alone.items() if len(w) == 1 and alone["a"] and self._find(f"a{c}a") == [alone["a"][0] + w[0] + alone["a"][0]]}
        signs = [c for c in SIGNS if "a" in plain and self._find(f"a{c}") == [plain["a"], c]]
        self.table = str.maketrans(plain)
        self.simple = regex.compile(f"([{''.join(plain)}]+)([{regex.escape(''.join(signs))}]?)") if plain and signs else None

    @classmethod
    def of(cls, path: str) -> PreTokens:
        """The worker's own: it outlives a task."""
        if cls._one is None or cls._one.path != path:
            cls._one = cls(path)
        return cls._one

    def _plain(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _find(self, stretch: str) -> list[str]:
        found: list[str] = []
        for part in self.cut.split(stretch) if self.cut else [stretch]:
            if part in self.added:
                found.append(part)
            elif part:
                found += (word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self._plain(part)))
        return found

    def _together(self, stretches: list[str]) -> list[list[str]]:
        """Pre-tokens of stretches without any blank or added token, found in one call."""
        plain = self._plain(" ".join(stretches))
        starts = np.cumsum([0] + [len(p) + 1 for p in plain.split(" ")])
        if len(starts) != len(stretches) + 1:
            return [self._find(s) for s in stretches]
        found: list[list[str]] = [[] for _ in stretches]
        tokens = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)
        owners = np.searchsorted(starts, [at for _, (at, _) in tokens], side="right") - 1
        for owner, (word, _) in zip(owners.tolist(), tokens, strict=True):
            found[owner].append(word)
        return found

    def find(self, stretches: list[str]) -> list[list[str]]:
        """Pre-tokens of each stretch."""
        found: list[list[str]] = []
        others = []
        simple, table = self.simple.fullmatch if self.simple else (lambda _: None), self.table
        for stretch in stretches:
            match = simple(stretch)
            if match:
                word, sign = match.groups()
                word = word.translate(table)
                found.append([word, sign] if sign else [word])
            elif self.apart.search(stretch):
                found.append(self._find(stretch))
            else:
                others.append(len(found))
                found.append([])
        for i, words in zip(others, self._together([stretches[i] for i in others]) if others else [], strict=True):
            found[i] = words
        return found

    def pieces(self, word: str) -> int:
        """Number of tokens of one pre-token."""
        return 1 if word in self.added else len(self.tokenizer.model.tokenize(word))


class _Numbers(dict):
    """Numbers of keys by first occurrence."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _summed(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, with the sums of their times."""
    order = np.argsort(rows, kind="stable")
    rows, times = rows[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.empty(0, dtype=np.int64)
    return rows[first], np.add.reduceat(times, first) if len(first) else times


class _Block:
    """Documents gathered so far, as numbers of their stretches."""

    def __init__(self):
        self.stretches, self.chars = _Numbers(), 0
        self.doc_ids, self.n_bytes, self.found = [], [], []

    def add(self, doc_id: int | None, text: str) -> None:
        counts = Counter(text.replace("\n", " ").split(" "))
        numbers = np.fromiter(map(self.stretches.__getitem__, counts), dtype=np.int32, count=len(counts))
        self.found.append((numbers, np.fromiter(counts.values(), dtype=np.int32, count=len(counts))))
        self.doc_ids.append(doc_id)
        self.n_bytes.append(len(text) if text.isascii() else len(text.encode()))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.doc_ids) >= BLOCK_DOCS

    def row(self, known: PreTokens) -> pa.RecordBatch:
        words = _Numbers()
        per_stretch = known.find(list(self.stretches))
        held = np.array([len(w) for w in per_stretch], dtype=np.int64)
        ends = np.cumsum(held)
        places = np.fromiter(map(words.__getitem__, chain.from_iterable(per_stretch)), dtype=np.int64, count=int(held.sum()))
        # every (document, stretch) becomes the pre-tokens of the stretch, then equal ones of a document are summed
        docs = np.repeat(np.arange(len(self.found)), [len(s) for s, _ in self.found])
        stretches = np.concatenate([s for s, _ in self.found])
        n = held[stretches]
        steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = places[np.repeat(ends[stretches] - n, n) + steps]
        times = np.repeat(np.concatenate([t for _, t in self.found]), n)
        width = max(1, len(words))
        rows, times = _summed(np.repeat(docs, n) * width + at, times)
        docs, places = rows // width, rows % width
        sizes = np.bincount(docs, minlength=len(self.found))
        # ascending places as steps from the one before: small numbers
        steps = np.diff(places, prepend=0)
        begins = (np.cumsum(sizes) - sizes)[sizes > 0]
        steps[begins] = places[begins]
        names = ["doc_ids", "n_bytes", "sizes", "places", "times", "words"]
        values = [pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([self.n_bytes], pa.list_(pa.int64()))]
        values += [pa.array([squeezed(v)], pa.binary()) for v in (sizes, steps, times)]
        return pa.RecordBatch.from_arrays([*values, pa.array([list(words)], pa.list_(pa.string()))], names=names)


def frequencies(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents with their distinct pre-tokens and each document's frequencies of them, written once.

    ``places`` are positions in ``words``, ascending within a document, as steps from the one before; ``times`` their
    frequencies; ``sizes`` how many of them a document has. ``block`` numbers the written rows.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PreTokens.of(tokenizer)
        block = _Block()
        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                block.add(doc_id.as_py(), body.as_py() or "")
                if block.full():
                    yield block.row(known)
                    block = _Block()
        if block.doc_ids:
            yield block.row(known)

    rows = docs.select(F.col(key).cast("long").alias("doc_ids"), F.col(text).alias("words"))
    return store(rows.mapInArrow(gather, _BLOCKS).withColumn("block", F.monotonically_increasing_id()))


def piece_counts(words: DataFrame, tokenizer: str) -> DataFrame:
    """(block, place, pieces) for (block, place, word): equal words come to one task, where the word is cut into pieces once.

    The rows of a word stream by in order, so one that stands in every block needs no memory for its rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PreTokens.of(tokenizer)
        last: tuple[str | None, int] = (None, 0)
        for batch in batches:
            encoded = batch.column(2).dictionary_encode()
            distinct = encoded.dictionary.to_pylist()
            counts = [last[1] if word == last[0] else known.pieces(word) for word in distinct]
            if distinct:
                last = (distinct[-1], counts[-1])
            pieces = pa.array(counts, pa.int32()).take(encoded.indices)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pieces], names=["block", "place", "pieces"])

    alike = words.select("block", "place", "word").repartition("word").sortWithinPartitions("word")
    return alike.mapInArrow(count, "block bigint, place int, pieces int")


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_bytes`` (UTF-8) and ``n_tokens``, special tokens at the ends not counted.

    ``tokenizer`` is a file of the tokenizers library whose pre-tokens never hold a blank or a line end, read on every
    worker. Null and empty texts have no tokens, null keys stay null, repeated rows are counted each, an empty table
    gives none; other columns are not looked at. A text of any length is counted whole; one longer than a block is a
    block of its own. A word in every block is one row per block.
    """
    blocks = frequencies(docs, tokenizer, key, text)
    words = blocks.select("block", F.posexplode("words").alias("place", "word"))
    # place and pieces in one number: half the width on the way back
    both = F.shiftleft(F.col("place").cast("long"), 32) + F.col("pieces")
    numbers = piece_counts(words, tokenizer).groupBy("block").agg(F.sort_array(F.collect_list(both)).alias("pieces"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, n_bytes, sizes, places, times, pieces = (batch.column(c)[i] for c in range(6))
                sizes = unsqueezed(sizes.as_py())
                ends = np.cumsum(sizes)
                sums = np.concatenate([[0], np.cumsum(unsqueezed(places.as_py()))])
                at = sums[1:] - np.repeat(sums[ends - sizes], sizes)  # places start anew in every document
                held = np.array(pieces.values.to_numpy() if pieces.is_valid else [], dtype=np.int64) & 0xFFFFFFFF
                tokens = held[at] * unsqueezed(times.as_py())
                totals = np.concatenate([[0], np.cumsum(tokens)])
                counts = totals[ends] - totals[ends - sizes]
                yield pa.RecordBatch.from_arrays([doc_ids.values, n_bytes.values, pa.array(counts)], names=["k", "n_bytes", "n_tokens"])

    packed = blocks.drop("words").join(numbers, "block", "left").select("doc_ids", "n_bytes", "sizes", "places", "times", "pieces")
    return packed.mapInArrow(add_up, "k bigint, n_bytes bigint, n_tokens bigint").withColumnRenamed("k", key)
