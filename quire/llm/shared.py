"""Helpers of the training-data operators: scratch tables, text columns, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows, written as JSON, are proven to take at most this many bytes.
BROADCAST_BYTES = 16 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters outside A-Z that lower() would change.
_OTHER_CAPITALS = r"[[\p{IsUppercase}\p{IsTitlecase}]&&[^A-Z]]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only for a local master without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="quire-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def store(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: what follows survives a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Hint a broadcast when the bytes of the side are counted and few; else leave the join shuffled."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    size = df.agg(F.sum(width)).first()[0] or 0
    return (F.broadcast(df), True) if size <= limit else (df, False)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, compressed by byte planes, the upper of which are nearly empty."""
    planes = np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T)
    return values.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype="u1").reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, and faster, where no other capital occurs."""
    return F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def running_sums(values: Column) -> Column:
    """Prefix sums of an array of longs, in blocks of the root of its size."""
    zero = F.lit(0).cast("long")

    def total(array: Column) -> Column:
        return F.aggregate(array, zero, lambda a, b: a + b)

    def over(array: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(array))).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(array) - 1) / width).cast("int")),
            lambda i: F.slice(array, i * width + 1, width),
        )
        return let(
            blocks,
            lambda rows: let(
                F.transform(rows, total),
                lambda sums: F.flatten(
                    F.transform(
                        rows,
                        lambda row, i: let(
                            total(F.slice(sums, F.lit(1), i)),
                            lambda base: F.transform(row, lambda _, j: base + total(F.slice(row, F.lit(1), j + 1))),
                        ),
                    )
                ),
            ),
        )

    return let(values, lambda array: F.when(F.size(array) > 0, over(array)).otherwise(F.array().cast("array<bigint>")))


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, value); code points, end exclusive.

    ``value`` is the given group. The pieces between the matches carry the positions.
    """
    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = let(
        F.split(text, pattern),
        lambda pieces: let(
            whole,
            lambda found: let(
                running_sums(
                    F.transform(
                        found,
                        lambda _, i: (
                            F.length(pieces[i]) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)
                        ).cast("long"),
                    )
                ),
                lambda starts: F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value"))),
            ),
        ),
    )
    if group:
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        lengths = F.zip_with(lengths, inner, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
    return F.when(text.rlike(pattern), lengths.cast(kind)).otherwise(F.array().cast(kind))


def joined_spans(spans: Column) -> Column:
    """Spans of (start, place, kind, end) as kind:start:end by start, then place of the kind, comma-joined."""
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")
