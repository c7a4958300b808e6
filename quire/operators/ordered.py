"""Ordered computations per group that survive a hot group.

A plain window puts a whole group into one task. Here the rows of groups above
a size limit are range-partitioned on (keys, order) instead, so a hot group is
spread over many bounded slices; each slice is windowed on its own and a small
per-slice summary carries state across slice borders. All other groups take the
ordinary window, whose exchange later steps on the same key reuse.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import HOT_GROUP_ROWS, SLICE_ROWS, broadcast_if_small, cut, setting

SLICE = "_slice"


def same_keys(keys: Sequence[str], left: str = "a", right: str = "b") -> Column:
    """Null-safe equality over key columns of two aliased frames."""
    tests = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    return reduce(lambda x, y: x & y, tests)


def split_hot(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None, int]:
    """Split rows into (ordinary groups, hot groups, rows in hot groups).

    The second part is None without hot groups. Counting is a partially
    aggregated, column-pruned scan. The hot key table is at most ``rows / limit``
    long.
    """
    limit = setting(df.sparkSession, HOT_GROUP_ROWS)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit)
    if not hot.take(1):
        return df, None, 0
    hot = cut(hot)
    rows = hot.agg(F.sum("_rows")).first()[0]
    side = broadcast_if_small(hot.select(*keys)).alias("b")
    on = same_keys(keys)
    return (
        df.alias("a").join(side, on, "left_anti"),
        df.alias("a").join(side, on, "left_semi"),
        rows,
    )


def slice_count(df: DataFrame, rows: int) -> int:
    return max(1, math.ceil(rows / setting(df.sparkSession, SLICE_ROWS)))


def slice_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int) -> DataFrame:
    """Range-partition on (keys, order) and tag each row with its slice number.

    The result is checkpointed: slice numbers are read twice (rows and summary)
    and must be the same after a lost executor.
    """
    ranged = df.drop(SLICE).repartitionByRange(slices, *keys, *order)
    return cut(ranged.withColumn(SLICE, F.spark_partition_id()))


class Ordered:
    """Rows of a frame viewed in order within groups.

    With ``slices`` the rows are cut into that many range slices and state is
    carried over between them; with 0 each group is one ordinary window.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int = 0):
        self.keys, self.order, self.sliced = list(keys), list(order), slices > 0
        self.df = slice_rows(df, keys, order, slices) if slices else df

    def _window(self):
        return Window.partitionBy(*([SLICE] if self.sliced else []), *self.keys).orderBy(*self.order)

    def _carry(self, summary: DataFrame, carried: list[str]) -> None:
        """Join the per-(slice, group) carry; it has one row per slice and hot group.

        The summary is written first, so later steps do not compute it again.
        """
        keys = [SLICE, *self.keys]
        self.df = (
            self.df.alias("a")
            .join(broadcast_if_small(cut(summary.select(*keys, *carried))).alias("b"), same_keys(keys), "left")
            .select("a.*", *[F.col(f"b.{c}") for c in carried])
        )

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        self.df = self.df.withColumns(columns)
        return self

    def lag(self, columns: dict[str, str], first: str | None = None) -> Ordered:
        """Add previous-row values ``{new: source}``; ``first`` flags group starts."""
        window = self._window()
        first = first or "_first"
        keep_first = first != "_first"
        self.df = self.df.withColumns(
            {**{new: F.lag(src).over(window) for new, src in columns.items()},
             first: F.lag(F.lit(1)).over(window).isNull()}
        )
        if self.sliced:
            ends = self.df.withColumn("_last", F.lead(F.lit(1)).over(window).isNull()).filter("_last")
            across = Window.partitionBy(*self.keys).orderBy(SLICE)
            names = [f"_carry_{new}" for new in columns]
            summary = ends.select(
                SLICE,
                *self.keys,
                *[F.lag(src).over(across).alias(n) for n, src in zip(names, columns.values())],
                F.lag(F.lit(1)).over(across).isNotNull().alias("_continued"),
            )
            self._carry(summary, [*names, "_continued"])
            starts = F.col(first)
            self.df = self.df.withColumns(
                {new: F.when(starts, F.col(n)).otherwise(F.col(new)) for new, n in zip(columns, names)}
            ).withColumn(first, starts & ~F.col("_continued")).drop(*names, "_continued")
        if not keep_first:
            self.df = self.df.drop(first)
        return self

    def running_sum(self, value: Column, out: str) -> Ordered:
        """Inclusive running sum of an expression."""
        window = self._window().rowsBetween(Window.unboundedPreceding, 0)
        self.df = self.df.withColumn(out, F.sum(value).over(window))
        if self.sliced:
            across = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
            totals = self.df.groupBy(SLICE, *self.keys).agg(F.sum(value).alias("_total"))
            summary = totals.withColumn("_base", F.coalesce(F.sum("_total").over(across), F.lit(0)))
            self._carry(summary, ["_base"])
            self.df = self.df.withColumn(out, F.col(out) + F.col("_base")).drop("_base")
        return self

    def max_before(self, value: Column, out: str) -> Ordered:
        """Largest value of an expression over all earlier rows; null on none."""
        self.df = self.df.withColumn(
            out, F.max(value).over(self._window().rowsBetween(Window.unboundedPreceding, -1))
        )
        if self.sliced:
            across = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
            tops = self.df.groupBy(SLICE, *self.keys).agg(F.max(value).alias("_top"))
            self._carry(tops.withColumn("_base", F.max("_top").over(across)), ["_base"])
            self.df = self.df.withColumn(out, F.greatest(F.col(out), F.col("_base"))).drop("_base")
        return self

    def index(self, out: str) -> Ordered:
        """Dense 0-based position in the group."""
        if self.sliced:
            self.running_sum(F.lit(1), out)
            self.df = self.df.withColumn(out, (F.col(out) - 1).cast("int"))
        else:
            self.df = self.df.withColumn(out, F.row_number().over(self._window()) - 1)
        return self

    def done(self) -> DataFrame:
        return self.df.drop(SLICE)


def per_group(
    df: DataFrame,
    keys: Sequence[str],
    compute: Callable[[DataFrame, int], DataFrame],
) -> DataFrame:
    """Apply ``compute(rows, slices)`` to ordinary groups (0 slices) and hot groups; unite both."""
    cold, hot, rows = split_hot(df, keys)
    result = compute(cold, 0)
    return result if hot is None else result.unionByName(compute(hot, slice_count(hot, rows)))


def with_group_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Dense 0-based position of each row in its group."""
    return per_group(df, keys, lambda rows, slices: Ordered(rows, keys, order, slices).index(out).done())


def with_global_index(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Dense 0-based position over the whole frame, without a single-task window."""
    rows = slice_rows(df, [], order, slice_count(df, df.count()))
    window = Window.partitionBy(SLICE).orderBy(*order)
    sizes = rows.groupBy(SLICE).agg(F.count("*").alias("_size"))
    # One row per slice: the only un-partitioned window here is over slice numbers.
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(sizes.select(SLICE, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base")))
    return (
        rows.withColumn(out, F.row_number().over(window) - 1)
        .join(broadcast_if_small(bases), SLICE)
        .withColumn(out, F.col(out) + F.col("_base"))
        .drop("_base", SLICE)
    )


def with_group_totals(df: DataFrame, keys: Sequence[str], totals: dict[str, Column], slices: int) -> DataFrame:
    """Attach per-group aggregates to rows.

    Ordinary groups use a window on the key they are already partitioned by.
    Hot groups are aggregated first and joined back, one row per hot group.
    """
    if not slices:
        window = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(window) for name, agg in totals.items()})
    summary = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in totals.items()])
    return (
        df.alias("a")
        .join(broadcast_if_small(cut(summary)).alias("b"), same_keys(keys), "left")
        .select("a.*", *[F.col(f"b.{name}") for name in totals])
    )
