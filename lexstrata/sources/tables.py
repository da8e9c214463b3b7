"""Tables that several writers change: a snapshot is a small file that names the folder of each bucket.

A change rewrites only the buckets of the keys it touches, into a new folder, and then publishes the next snapshot by
creating its file, which exactly one writer can. A writer that comes second starts again from the snapshot it lost to.
Readers see the last snapshot published: all of a change or nothing of it, and the old one after a failed run.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Others were first, as often as one was willing to try."""


def create_once(spark: SparkSession, path: str, said: str) -> bool:
    """Whether this call created the file, with all it says; False if it was there. On local disks a hard link decides,
    elsewhere a rename, which file systems such as HDFS refuse where the name is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, tmp = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(tmp, False)
    out.write(bytearray(said.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(tmp.toUri().getPath(), at.toUri().getPath())
            except FileExistsError:
                return False
            return True
        try:
            return not fs.exists(at) and fs.rename(tmp, at)
        except Py4JJavaError:
            return False
    finally:
        fs.delete(tmp, False)


class SnapshotTable:
    """Rows of distinct keys in so many buckets by their hash."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def head(self) -> dict:
        """The last snapshot: version, folders by bucket, the last batch of each stream; version 0 without any."""
        at, fs = self._fs(f"{self.path}/_snapshots")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []
        if not names:
            return {"version": 0, "folders": {}, "batches": {}}
        lines = self.spark.read.text(f"{self.path}/_snapshots/{names[-1]}").collect()  # one line: a name per bucket
        return json.loads(lines[0][0])

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._rows(sorted(self.head()["folders"].values()))

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def replaced(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        """The changes' rows, and the old ones of other keys; null keys are keys."""
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self.keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        return old.alias("o").join(changes.select(*self.keys).distinct().alias("c"), on, "left_anti").unionByName(changes)

    def upsert(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, batch: tuple[str, int] | None = None, tries: int = 20) -> int:
        """The version that holds the changes (rows with at least the keys); the present one if there are none.

        merge(old, changes) gives the new rows of the touched buckets from all their old ones, by default the changed rows
        instead of those of their keys; several changes of one key are merge's to settle. It may run more than once. With
        batch (stream, number), a batch that an earlier try has published, or an older one, changes nothing.
        """
        for _ in range(tries):
            head = self.head()
            if batch and head["batches"].get(batch[0], -1) >= batch[1]:
                return head["version"]
            touched = sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())  # as many as there are buckets at most
            folders, name = {}, f"data/{uuid.uuid4().hex}"
            if touched:
                old = self._rows([head["folders"][str(b)] for b in touched if str(b) in head["folders"]])
                new = (merge or self.replaced)(old, changes).withColumn("_bucket", self.bucket())
                new.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
                folders = {str(b): f"{name}/_bucket={b}" for b in touched}
            elif not batch:
                return head["version"]
            while True:
                at, fs = self._fs(f"{self.path}/_snapshots")
                fs.mkdirs(at)
                batches = head["batches"] | ({batch[0]: batch[1]} if batch else {})
                next_ = {"version": head["version"] + 1, "folders": head["folders"] | folders, "batches": batches}
                if create_once(self.spark, f"{self.path}/_snapshots/{next_['version']:012d}.json", json.dumps(next_)):
                    return next_["version"]
                now = self.head()
                mine = [str(b) for b in touched]
                if [now["folders"].get(b) for b in mine] != [head["folders"].get(b) for b in mine] or (batch and now["batches"].get(batch[0], -1) >= batch[1]):
                    break  # another writer changed the same buckets
                head = now  # only other buckets changed: the rows written still hold
            gone, fs = self._fs(f"{self.path}/{name}")
            fs.delete(gone, True)
        raise Conflict(f"{tries} tries to change {self.path}")

    def clean(self, keep: int = 2) -> None:
        """Drops snapshots but the last keep, and folders that none of those names. Not while others write or read older ones."""
        at, fs = self._fs(f"{self.path}/_snapshots")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        held = {f.split("/")[1] for n in names[-keep:] for f in json.loads(self.spark.read.text(f"{self.path}/_snapshots/{n}").collect()[0][0])["folders"].values()}
        for n in names[:-keep]:
            fs.delete(self._fs(f"{self.path}/_snapshots/{n}")[0], False)
        data, fs = self._fs(f"{self.path}/data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if s.getPath().getName() not in held:
                fs.delete(s.getPath(), True)
