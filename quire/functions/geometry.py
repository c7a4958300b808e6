"""Rectangles as four double columns; normalised space has its origin bottom-left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Crop overlap and counts, same-line ratio, gutter band.
CROP_OVERLAP = 0.20
MIN_CROPS = 3
MAX_CROPS = 6
SAME_LINE_RATIO = 0.35
LEFT_LIMIT = 0.5 + 0.02
RIGHT_LIMIT = 0.5 - 0.02


def to_image_rect(x: Column, y: Column, w: Column, h: Column, iw: Column, ih: Column) -> Column:
    """Rectangle in pixels from the top-left corner; all zero for an empty image."""
    drawn = (iw > 0) & (ih > 0)

    def part(value: Column, name: str) -> Column:
        return F.when(drawn, value).otherwise(F.lit(0.0)).alias(name)

    return F.struct(
        part(x * iw, "x"), part((1 - y - h) * ih, "y"), part(w * iw, "w"), part(h * ih, "h")
    )


def to_normalized_rect(x: Column, y: Column, w: Column, h: Column, iw: Column, ih: Column) -> Column:
    """Inverse of :func:`to_image_rect`."""
    drawn = (iw > 0) & (ih > 0)

    def part(value: Column, name: str) -> Column:
        return F.when(drawn, value).otherwise(F.lit(0.0)).alias(name)

    height = F.try_divide(h, ih)
    return F.struct(
        part(F.try_divide(x, iw), "x"),
        part(1 - F.try_divide(y, ih) - height, "y"),
        part(F.try_divide(w, iw), "w"),
        part(height, "h"),
    )


def shares_line(y1: Column, h1: Column, y2: Column, h2: Column, ratio: float = SAME_LINE_RATIO) -> Column:
    """True when the vertical overlap covers enough of the shorter rectangle."""
    overlap = F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2)
    shorter = F.least(h1, h2)
    enough = F.when(shorter > 0, overlap / shorter >= ratio).otherwise(False)
    return F.coalesce((overlap > 0) & enough, F.lit(False))


def page_side(x: Column, w: Column) -> Column:
    """Which side of the gutter a block keeps to: left, right or spanning."""
    return F.when(x + w <= LEFT_LIMIT, "left").when(x >= RIGHT_LIMIT, "right").otherwise("spanning")


def crop_count(width: Column, height: Column) -> Column:
    aspect = F.try_divide(F.greatest(width, height), F.least(width, height))
    planned = F.least(F.lit(MAX_CROPS), F.greatest(F.lit(MIN_CROPS), F.ceil(aspect * 2).cast("int")))
    return F.when((width > 0) & (height > 0), planned).otherwise(F.lit(MIN_CROPS))


def plan_crops(pages: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """One row per overlapping crop along the long edge, 3 to 6 per page.

    Adds ``crop_count``, ``crop_index`` and the normalised ``crop_x/y/w/h``.
    """
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    length = F.lit(1.0) / (F.lit(1.0) + F.lit(1.0 - CROP_OVERLAP) * (F.col("crop_count") - 1))
    origin = F.least(F.col("crop_index") * (length * F.lit(1.0 - CROP_OVERLAP)), F.lit(1.0) - length)
    tall = h >= w
    return (
        pages.withColumn("crop_count", crop_count(w, h))
        .withColumn("crop_index", F.explode(F.sequence(F.lit(0), F.col("crop_count") - 1)))
        .withColumns(
            {
                "crop_x": F.when(tall, F.lit(0.0)).otherwise(origin),
                "crop_y": F.when(tall, origin).otherwise(F.lit(0.0)),
                "crop_w": F.when(tall, F.lit(1.0)).otherwise(length),
                "crop_h": F.when(tall, length).otherwise(F.lit(1.0)),
            }
        )
    )


def pixel_rect(x: Column, y: Column, w: Column, h: Column, iw: Column, ih: Column) -> Column:
    """Smallest whole-pixel rectangle around a normalised one, clipped to the image."""
    left = F.greatest(F.floor(x * iw), F.lit(0)).cast("int")
    top = F.greatest(F.floor(y * ih), F.lit(0)).cast("int")
    right = F.least(F.ceil(x * iw + w * iw), F.ceil(iw)).cast("int")
    bottom = F.least(F.ceil(y * ih + h * ih), F.ceil(ih)).cast("int")
    return F.struct(
        left.alias("left"),
        top.alias("top"),
        (right - left).alias("width"),
        (bottom - top).alias("height"),
    )
