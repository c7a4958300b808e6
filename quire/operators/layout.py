"""Layout analysis of recognised text blocks.

Blocks carry ``x, y, w, h`` (normalised, origin bottom-left) and ``text``. A
page is identified by ``keys``; ``ordinal`` columns fix the input order used to
break ties. The page key is the only shuffle key from column detection to page
text, so one exchange serves every step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SAME_LINE_RATIO, page_side, shares_line
from ..functions.text import trim_blank
from .ordered import Ordered, per_group, with_group_totals

#: Blocks per text part; a page of ordinary size is a single part 0.
PART_BLOCKS = 100_000


def _side_counts() -> dict:
    side = F.col("_side")
    return {
        "_left": F.count_if(side == "left"),
        "_right": F.count_if(side == "right"),
        "_span": F.count_if(side == "spanning"),
    }


def column_statistics(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left, right and spanning block counts per page and the two-column verdict."""
    counted = (
        blocks.withColumn("_side", page_side(F.col("x"), F.col("w")))
        .groupBy(*keys)
        .agg(*[agg.alias(name) for name, agg in _side_counts().items()], F.count("*").alias("block_count"))
    )
    return counted.select(
        *keys,
        F.col("_left").alias("left_count"),
        F.col("_right").alias("right_count"),
        F.col("_span").alias("spanning_count"),
        "block_count",
        _two_columns().alias("two_columns"),
    )


def _two_columns():
    return (F.col("_span") == 0) & (F.col("_left") >= 2) & (F.col("_right") >= 2)


def assign_columns(blocks: DataFrame, keys: Sequence[str], slices: int = 0, detect_columns: bool = True) -> DataFrame:
    """Add ``column_id``: 0, or 1 for the right side of a two-column page; all 0 where columns are not detected."""
    if not detect_columns:
        return blocks.withColumn("column_id", F.lit(0))
    sided = blocks.withColumn("_side", page_side(F.col("x"), F.col("w")))
    counted = with_group_totals(sided, keys, _side_counts(), slices)
    right = _two_columns() & (F.col("_side") == "right")
    return counted.withColumn("column_id", F.when(right, 1).otherwise(0)).drop(
        "_side", "_left", "_right", "_span"
    )


def _with_lines(
    blocks: DataFrame, keys: Sequence[str], ordinal: Sequence[str], slices: int, same_line_ratio: float, detect_columns: bool
) -> DataFrame:
    """Add ``mid_y`` and ``line_id``, the 1-based visual line within a column.

    Blocks are visited by descending middle; only the latest line is open, so a
    block joins it exactly when it shares a line with the block just before.
    """
    placed = assign_columns(blocks, keys, slices, detect_columns).withColumn("mid_y", F.col("y") + F.col("h") / 2)
    order = [F.col("mid_y").desc(), *[F.col(o) for o in ordinal]]
    scan = Ordered(placed, [*keys, "column_id"], order, slices).lag({"_py": "y", "_ph": "h"}, first="_start")
    joined = shares_line(F.col("y"), F.col("h"), F.col("_py"), F.col("_ph"), same_line_ratio)
    fresh = F.when(~F.col("_start") & joined, 0).otherwise(1)
    return scan.running_sum(fresh, "line_id").done().drop("_py", "_ph", "_start")


def _with_reading_order(
    blocks: DataFrame, keys: Sequence[str], ordinal: Sequence[str], slices: int, same_line_ratio: float, detect_columns: bool
) -> DataFrame:
    lined = _with_lines(blocks, keys, ordinal, slices, same_line_ratio, detect_columns)
    order = [
        F.col("column_id"),
        F.col("line_id"),
        F.col("x"),
        F.col("mid_y").desc(),
        *[F.col(o) for o in ordinal],
    ]
    return Ordered(lined, keys, order, slices).index("reading_order").done()


def group_lines(
    blocks: DataFrame,
    keys: Sequence[str],
    ordinal: Sequence[str],
    same_line_ratio: float = SAME_LINE_RATIO,
    detect_columns: bool = True,
) -> DataFrame:
    """Visual lines within detected columns: adds ``column_id``, ``line_id``, ``mid_y``."""
    options = same_line_ratio, detect_columns
    return per_group(blocks, keys, lambda rows, slices: _with_lines(rows, keys, ordinal, slices, *options))


def reading_order(
    blocks: DataFrame,
    keys: Sequence[str],
    ordinal: Sequence[str],
    same_line_ratio: float = SAME_LINE_RATIO,
    detect_columns: bool = True,
) -> DataFrame:
    """Natural reading order: adds a dense 0-based ``reading_order`` per page."""
    options = same_line_ratio, detect_columns
    return per_group(blocks, keys, lambda rows, slices: _with_reading_order(rows, keys, ordinal, slices, *options))


def reindex(blocks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Make ``reading_order`` dense and 0-based again, keeping the given order."""
    columns = [F.col(o) for o in order]
    return per_group(
        blocks.withColumnRenamed("reading_order", "_given"),
        keys,
        lambda rows, slices: Ordered(
            rows, keys, [F.col("_given"), *columns], slices
        ).index("reading_order").done().drop("_given"),
    )


def _with_text_lines(blocks: DataFrame, keys: Sequence[str], slices: int) -> Ordered:
    """Add ``continues_line`` and the 1-based ``text_line``, following stored order.

    A block continues the line of the block before it when both share a visual
    line and it does not step back left.
    """
    scan = Ordered(blocks, keys, [F.col("reading_order")], slices)
    scan.lag({"_py": "y", "_ph": "h", "_px": "x"}, first="_start")
    follows = (
        ~F.col("_start")
        & shares_line(F.col("y"), F.col("h"), F.col("_py"), F.col("_ph"))
        & (F.col("x") >= F.col("_px"))
    )
    scan.with_columns({"continues_line": F.coalesce(follows, F.lit(False))})
    scan.running_sum(F.when(F.col("continues_line"), 0).otherwise(1), "text_line")
    scan.df = scan.df.drop("_py", "_ph", "_px", "_start")
    return scan


def line_flags(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Continues-line flag and text line of each block in stored reading order."""
    return per_group(blocks, keys, lambda rows, slices: _with_text_lines(rows, keys, slices).done())


def _with_pieces(blocks: DataFrame, keys: Sequence[str], slices: int) -> DataFrame:
    """Add the ``piece`` each block contributes, with its own leading separator.

    Page text is then the plain concatenation of pieces in reading order. Empty
    blocks contribute nothing but still act as the block before the next one.
    """
    scan = _with_text_lines(blocks, keys, slices)
    scan.with_columns({"_text": trim_blank(F.col("text"))})
    scan.max_before(F.when(F.col("_text") != "", F.col("text_line")), "_before")
    separator = (
        F.when(F.col("_before").isNull(), "").when(F.col("_before") == F.col("text_line"), " ").otherwise("\n")
    )
    piece = F.when(F.col("_text") != "", F.concat(separator, F.col("_text"))).otherwise("")
    return scan.with_columns({"piece": piece}).done().drop("_text", "_before")


def _concatenate(pieces: DataFrame, keys: Sequence[str], part_blocks: int) -> DataFrame:
    part = F.floor(F.col("reading_order") / part_blocks).cast("int")
    return (
        pieces.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(
            F.expr("listagg(piece, '') within group (order by reading_order)").alias("page_text"),
            F.count("*").alias("block_count"),
        )
    )


def compose_text(blocks: DataFrame, keys: Sequence[str], part_blocks: int = PART_BLOCKS) -> DataFrame:
    """Page text from blocks with a dense ``reading_order``.

    Emits one row per page and part. Parts hold at most ``part_blocks`` blocks
    and concatenate (no separator) to the whole text; only a page beyond that
    size has more than part 0, so no task ever builds an unbounded string.
    """
    return per_group(
        blocks, keys, lambda rows, slices: _concatenate(_with_pieces(rows, keys, slices), keys, part_blocks)
    )


def order_and_compose(
    blocks: DataFrame,
    keys: Sequence[str],
    ordinal: Sequence[str],
    part_blocks: int = PART_BLOCKS,
    same_line_ratio: float = SAME_LINE_RATIO,
    detect_columns: bool = True,
) -> DataFrame:
    """Unordered blocks to page text in one pass over a single page-key exchange."""

    def compute(rows: DataFrame, slices: int) -> DataFrame:
        ordered = _with_reading_order(rows, keys, ordinal, slices, same_line_ratio, detect_columns)
        return _concatenate(_with_pieces(ordered, keys, slices), keys, part_blocks)

    return per_group(blocks, keys, compute)
