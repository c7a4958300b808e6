"""Histograms and bimodal thresholds per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bin count, default and limits of the threshold, brightness offset.
BINS = 256
DEFAULT_THRESHOLD = 180
LOWEST, HIGHEST, OFFSET = 95, 235, 8


def histogram(values: DataFrame, keys: Sequence[str], value: str = "bin") -> DataFrame:
    """Counts per group and bin 0..255; combined map-side, at most 256 rows per group leave a task."""
    return (
        values.groupBy(*keys, F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("n")).filter(
            F.col("bin").between(0, BINS - 1)
        )
    )


def otsu_threshold(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-class threshold per group from its histogram.

    Windows run over at most 256 pre-aggregated bins. Empty bins repeat the
    variance of the bin before, so only filled ones can win; ties keep the
    smallest bin. Weights are multiplied as doubles, which cannot overflow.
    """
    group = Window.partitionBy(*keys)
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    mass = (F.col("bin") * F.col("n")).cast("double")
    scored = (
        bins.withColumn("_total", F.sum("n").over(group))
        .withColumn("_sum", F.sum(mass).over(group))
        .withColumn("_bw", F.sum("n").over(upto))
        .withColumn("_bs", F.sum(mass).over(upto))
        .withColumn("_fw", F.col("_total") - F.col("_bw"))
    )
    gap = F.col("_bs") / F.col("_bw") - F.try_divide(F.col("_sum") - F.col("_bs"), F.col("_fw"))
    variance = F.col("_bw").cast("double") * F.col("_fw").cast("double") * F.pow(gap, F.lit(2.0))
    return (
        scored.withColumn("_variance", F.when(F.col("_fw") > 0, variance))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("total"),
            F.coalesce(F.expr("max_by(bin, struct(_variance, -bin)) FILTER (WHERE _variance IS NOT NULL)"),
                       F.lit(DEFAULT_THRESHOLD)).alias("_best"),
        )
        .withColumn("threshold", F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), F.col("_best") + OFFSET)))
        .drop("_best")
    )
