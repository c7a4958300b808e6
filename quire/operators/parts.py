"""Long values in ordered parts: numbering across parts, and parts put together again.

A value that may outgrow a task comes as rows (keys, ``part``, value); its parts in order, joined by the separator its
operator names, are the whole value. Nearly all values have one part. What a part needs to know of the parts before it is a
sum over one narrow row per part, so texts are never moved for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut
from .ordered import same_keys

PART = "part"


def whole(parts: DataFrame, keys: Sequence[str], value: str, separator: str = "") -> DataFrame:
    """One row per key: the texts of its parts in order. A value must fit a task; ``sinks.write_packed`` has no such limit."""
    quoted = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return parts.groupBy(*keys).agg(F.expr(f"listagg(`{value}`, '{quoted}') within group (order by {PART})").alias(value))


def whole_array(parts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key: the arrays of its parts in order, as one array."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(PART).alias("_part"), F.col(value).alias("_value"))))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(rows, lambda r: r["_value"])).alias(value))


def several_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """(keys, ``_from``, ``_to``) of the values that have more than one part; None where there is no such value."""
    found = parts.groupBy(*keys).agg(F.min(PART).alias("_from"), F.max(PART).alias("_to")).filter("_from < _to")
    found = cut(found)
    return found if found.take(1) else None


def sums_before(parts: DataFrame, keys: Sequence[str], counts: dict[str, Column], several: DataFrame | None) -> DataFrame:
    """Add the sum of each count over the earlier parts of the same value; 0 for a first part."""
    if several is None:
        return parts.withColumns({name: F.lit(0).cast("long") for name in counts})
    side = broadcast_if_small(several.select(*keys))
    narrow = parts.alias("a").join(side.alias("b"), same_keys(keys), "left_semi").select(
        *keys, PART, *[value.cast("long").alias(name) for name, value in counts.items()]
    )
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.select(*keys, PART, *[F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")).alias(n) for n in counts])
    joined = parts.alias("a").join(broadcast_if_small(cut(sums)).alias("b"), same_keys([*keys, PART]), "left")
    return joined.select("a.*", *[F.coalesce(F.col(f"b.{n}"), F.lit(0).cast("long")).alias(n) for n in counts])


def later_parts(parts: DataFrame, keys: Sequence[str], several: DataFrame | None) -> DataFrame:
    """Add ``_later``: the part is not the first of its value."""
    if several is None:
        return parts.withColumn("_later", F.lit(False))
    joined = parts.alias("a").join(broadcast_if_small(several).alias("b"), same_keys(keys), "left")
    return joined.select("a.*", F.coalesce(F.col(f"a.{PART}") > F.col("b._from"), F.lit(False)).alias("_later"))
