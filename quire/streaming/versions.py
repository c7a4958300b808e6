"""Tables that streams keep up to date, as versions published by a pointer.

A version is a small JSON file that names the folders it consists of and, per stream, the last epoch it holds. It is
written under another name and renamed, so readers see whole versions only. Folders are never changed: an epoch
writes new ones and publishes them together with those that stay. An epoch that is repeated after a failure finds
itself applied already. A stream whose predecessor epoch is in no version lost it, which is an error. A stream with a
renewed checkpoint is another stream and starts from the newest version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..runtime import BUCKET, BUCKETS, bucket_of, cut

#: Older versions are removed, with the folders that only they name.
KEEP_VERSIONS = 20


class LostVersionError(RuntimeError):
    """A version or a folder that must be there is missing."""


def stream_id(spark: SparkSession) -> str:
    """Identity of the running stream; it lives as long as its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


class Versions:
    """The published versions below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/published")
        self._files = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _numbers(self) -> list[int]:
        if not self._files.exists(self._root):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._root)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def _load(self, number: int) -> dict:
        stream = self._files.open(self._named(f"{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> dict | None:
        """The newest version; None where none was published yet."""
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else None

    def before(self, stream: str, epoch: int) -> dict | None:
        """The version an epoch starts from; None for the first one, an error where the stream's last epoch is missing."""
        found = self.newest()
        last = -1 if found is None else found["applied"].get(stream, -1)
        if epoch > 0 and last < epoch - 1:
            raise LostVersionError(f"{self.path} holds no version after epoch {epoch - 1} of stream {stream}")
        return found

    def publish(
        self, before: dict | None, stream: str, epoch: int, folders: dict[str, str], schema: StructType, buckets: int = 0
    ) -> None:
        """Make a version out of ``folders`` (name to place) the newest one."""
        number = 1 if before is None else before["version"] + 1
        applied = {**({} if before is None else before["applied"]), stream: epoch}
        body = {"version": number, "applied": applied, "folders": folders, "schema": json.loads(schema.json()), "buckets": buckets}
        draft = self._named(f"{uuid.uuid4().hex}.draft")
        out = self._files.create(draft)
        out.write(json.dumps(body).encode())
        out.close()
        if self._files.exists(self._named(f"{number}.json")) or not self._files.rename(draft, self._named(f"{number}.json")):
            raise LostVersionError(f"version {number} of {self.path} was published by another writer")
        self._expire(number)

    def _expire(self, newest: int) -> None:
        old = [n for n in self._numbers() if n <= newest - KEEP_VERSIONS]
        for number in old:
            kept = set(self._load(number + 1)["folders"].values())
            for folder in set(self._load(number)["folders"].values()) - kept:
                self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
            self._files.delete(self._named(f"{number}.json"), False)

    def read(self, version: dict, names: Sequence[str] | None = None) -> DataFrame:
        """Rows of a version, or of some of its folders. A folder that is not there is an error."""
        schema = StructType.fromJson(version["schema"])
        wanted = sorted(version["folders"] if names is None else set(names) & set(version["folders"]))
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[version["folders"][name] for name in wanted])


def current(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest version."""
    versions = Versions(spark, path)
    newest = versions.newest()
    if newest is None:
        raise LostVersionError(f"nothing was published at {path}")
    return versions.read(newest)


def fold(
    batch: DataFrame, epoch: int, path: str, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS
) -> None:
    """Merge an epoch into a table in key buckets.

    ``merge`` reduces rows to those that stay and must keep their columns; it is applied to the batch, then to the batch
    with the stored rows of its buckets. Only buckets in which the batch has a key are read and written again.
    """
    spark, stream = batch.sparkSession, stream_id(batch.sparkSession)
    versions = Versions(spark, path)
    before = versions.before(stream, epoch)
    if before is not None and before["applied"].get(stream, -1) >= epoch:
        return
    folders = {} if before is None else dict(before["folders"])
    if before is not None and before["buckets"] != buckets:
        raise ValueError("the number of buckets of a table cannot be changed")
    fresh = cut(merge(batch))
    bucket = bucket_of(keys, buckets)
    touched = sorted(str(row[0]) for row in fresh.select(bucket).distinct().collect())
    if touched:
        rows = fresh if before is None else merge(versions.read(before, touched).unionByName(fresh))
        place = f"{versions.path}/data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket).repartition(min(buckets, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(place)
        folders |= {name: f"{place}/{BUCKET}={name}" for name in touched}
    versions.publish(before, stream, epoch, folders, fresh.schema, buckets)


def append(batch: DataFrame, epoch: int, path: str, compact: Callable[[DataFrame], DataFrame], most_deltas: int) -> None:
    """Add an epoch as a delta; beyond ``most_deltas`` they are compacted into one snapshot together with the last one."""
    spark, stream = batch.sparkSession, stream_id(batch.sparkSession)
    versions = Versions(spark, path)
    before = versions.before(stream, epoch)
    if before is not None and before["applied"].get(stream, -1) >= epoch:
        return
    folders = {} if before is None else dict(before["folders"])
    name = f"delta-{uuid.uuid4().hex}"
    rows = compact(batch)
    rows.write.parquet(f"{versions.path}/data/{name}")
    folders[name] = f"{versions.path}/data/{name}"
    if len(folders) > most_deltas + 1:
        whole = versions.read({"folders": folders, "schema": json.loads(rows.schema.json())})
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        compact(whole).write.parquet(f"{versions.path}/data/{snapshot}")
        folders = {snapshot: f"{versions.path}/data/{snapshot}"}
    versions.publish(before, stream, epoch, folders, rows.schema)
