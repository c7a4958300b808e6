"""Session-level helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups with more rows than this are never windowed in one task.
HOT_GROUP_ROWS = "quire.hotGroupRows"
#: Target rows per range slice of a hot group.
SLICE_ROWS = "quire.sliceRows"
#: A side is broadcast only when a bounded count proves it is at most this long and, written as JSON, this large.
BROADCAST_ROWS, BROADCAST_BYTES = "quire.broadcastRows", "quire.broadcastBytes"

#: Tables in key buckets: the column, and how many buckets there are.
BUCKET, BUCKETS = "_bucket", 64

DEFAULTS = {HOT_GROUP_ROWS: 1_000_000, SLICE_ROWS: 500_000, BROADCAST_ROWS: 200_000, BROADCAST_BYTES: 64 << 20}


def setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(DEFAULTS[key])))


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """Bucket of a key."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in ``spark.sql.shuffle.partitions`` partitions that stay apart.

    For narrow rows that are sorted next: they take many times their compressed size in a sort, but partitions are
    put together by compressed size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names.

    A private folder is made only for a local master with nothing configured.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="quire-checkpoint-")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Materialise a large frame as columns in the shared checkpoint folder; unlike :func:`cut` it is evaluated once.

    Row groups are small, so that few files are still read by many tasks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/quire-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """True when a bounded count proves the frame is small enough to broadcast, in rows and in bytes."""
    limit = setting(df.sparkSession, BROADCAST_ROWS)
    width = F.octet_length(F.to_json(F.struct("*")))
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= limit and size <= setting(df.sparkSession, BROADCAST_BYTES)


def broadcast_if_small(df: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast only when the side is proven small.

    ``probe`` is a cheaper frame known to be at least as large as ``df``.
    Beyond the bound the join stays a shuffled join that AQE may split.
    """
    return F.broadcast(df) if is_small(probe if probe is not None else df) else df
