"""Fill-in-the-middle: texts cut at two ranks and put together in another order.

The ranks count units: code points, or whatever a pattern tiles the text with (words, lines). An indexable skip list
finds where a unit starts. Its nodes are short runs of units; a node is on the next higher lane with the chance 1/4,
drawn from its number alone, so a repeated task builds the same list. Every link carries two widths, the units and the
code points it passes; a descent adds up the widths that still fit under the rank, so it ends at the exact unit and
knows its code point. Lanes are arrays, built by sums between the nodes of a lane.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import let

# Marks in front of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of one node of the skip list.
NODE_UNITS = 64

ADDED = ["form", "prefix_chars", "middle_chars", "output"]
_SCHEMA = "struct<form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def _heights(nodes: int) -> np.ndarray:
    """Highest lane of each node: one more with the chance 1/4 each, from a mixed node number."""
    mixed = (np.arange(1, nodes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    heights = np.zeros(nodes, dtype=np.int64)
    risen = np.ones(nodes, dtype=bool)
    for level in range(16):
        risen &= (mixed >> np.uint64(2 * level)) & np.uint64(3) == 0
        if not risen.any():
            break
        heights += risen
    return heights


class SkipList:
    """Units of a text by rank. ``widths`` are the code points of each unit; None: every unit is one code point."""

    def __init__(self, n_units: int, widths: np.ndarray | None = None):
        self.n_units, self.widths = n_units, widths
        nodes = -(-n_units // NODE_UNITS)
        firsts = np.arange(nodes, dtype=np.int64) * NODE_UNITS
        units = np.minimum(n_units - firsts, NODE_UNITS)
        chars = units if widths is None or not nodes else np.add.reduceat(widths.astype(np.int64), firsts)
        heights = _heights(nodes)
        #: Per lane, lowest first: place in the lane below, units and code points passed by each link.
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        below = np.arange(nodes, dtype=np.int64)
        at = below
        for level in range(int(heights.max(initial=0)) + 1):
            if level:
                up = heights[at] >= level
                up[0] = True  # the head is on every lane
                below = np.flatnonzero(up)
                at, units, chars = at[below], np.add.reduceat(units, below), np.add.reduceat(chars, below)
            self.lanes.append((below, units, chars))

    def find(self, rank: int) -> int:
        """Code points before the unit of this rank; the rank may be the number of units."""
        if not 0 <= rank <= self.n_units:
            raise IndexError(rank)
        place, passed, chars = 0, 0, 0
        for level in range(len(self.lanes) - 1, -1, -1):
            below, units, widths = self.lanes[level]
            while place < len(units) and passed + units[place] <= rank:
                passed += int(units[place])
                chars += int(widths[place])
                place += 1
            if level:
                place = int(below[place]) if place < len(below) else len(self.lanes[level - 1][1])
        if self.widths is None:
            return chars + rank - passed
        return chars + int(self.widths[passed:rank].sum())


def cut(text: str, first: int, second: int, units: str | None = None) -> tuple[int, int]:
    """Code points before the units of two ranks, each taken modulo the number of units plus one; smaller first."""
    if units is None:
        n, widths = len(text), None
    else:
        import regex

        widths = np.array([m.end() - m.start() for m in regex.finditer(units, text)], dtype=np.int64)
        n = len(widths)
        if int(widths.sum()) != len(text):
            raise ValueError("the pattern of the units must tile every text")
    found = SkipList(n, widths)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return found.find(low), found.find(high)


def draws(key: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """Reproducible unsigned 32-bit numbers of a row: groups of 8 digits of the digest of ``seed:key``; null for a null key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def transform(
    docs: DataFrame, first: Column, second: Column, form: Column, text: str = "text", units: str | None = None
) -> DataFrame:
    """Add ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` to every row.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``; ``first`` and
    ``second`` are non-negative numbers, taken modulo the number of units plus one. ``units`` is a pattern that tiles
    every text, None for code points. A null text counts as empty. Plain, with the text itself as output and null
    widths, are also empty texts, texts that hold a mark, and rows with a null number or form. Texts of any length are
    taken whole; repeated rows and an empty table need no care. Input columns called like an added one, and
    ``_quire_fim``, are replaced; all others stay.
    """

    @F.arrow_udf(_SCHEMA)
    def build(texts: pa.Array, forms: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        rows = []
        for body, wanted, a, b in zip(*(c.to_pylist() for c in (texts, forms, firsts, seconds)), strict=True):
            marked = PREFIX in body or SUFFIX in body or MIDDLE in body
            if not body or marked or wanted not in ("psm", "spm") or a is None or b is None:
                rows.append(("plain", None, None, body))
                continue
            low, high = cut(body, a, b, units)
            head, middle, tail = body[:low], body[low:high], body[high:]
            parts = (PREFIX, head, SUFFIX, tail) if wanted == "psm" else (SUFFIX, tail, PREFIX, head)
            rows.append((wanted, low, high - low, "".join((*parts, MIDDLE, middle))))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=ADDED)

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*ADDED, "_quire_fim")]
    made = build(F.coalesce(F.col(f"`{text}`"), F.lit("")), form, first.cast("long"), second.cast("long"))
    return docs.withColumn("_quire_fim", made).select(*kept, *[F.col(f"_quire_fim.{c}") for c in ADDED])


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from.

    A cut text holds no mark, and no mark can begin in a text and end in the mark behind it; so the first place of
    each inner mark is its own.
    """

    def parts(first: str, second: str) -> Column:
        start = len(first) + 1
        inner = F.position(F.lit(second), output)
        last = F.position(F.lit(MIDDLE), output)
        return F.struct(
            F.substring(output, F.lit(start), inner - start).alias("one"),
            F.substring(output, inner + len(second), last - inner - len(second)).alias("two"),
            F.substring(output, last + len(MIDDLE), F.length(output)).alias("middle"),
        )

    psm = let(parts(PREFIX, SUFFIX), lambda p: F.concat(p["one"], p["middle"], p["two"]))
    spm = let(parts(SUFFIX, PREFIX), lambda p: F.concat(p["two"], p["middle"], p["one"]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
