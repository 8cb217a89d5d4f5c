"""A keyed table in hash buckets, whose versions are published on condition.

The rows of a bucket lie in a folder of their own. A version is a manifest: a small JSON file that names every bucket's folder and
the last batch of each source. A batch rewrites the folders of the buckets that it touches, in a new place, and then publishes the next
manifest, which fails if another writer has published that number meanwhile. The loser starts again from the
winner's version: folders that it has written stay good where the winner left the bucket alone. Readers follow
the newest manifest, so they see a whole version at any time, and a batch that is delivered again is known by its number.

Nothing but manifests passes the driver: their size is that of the list of buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder

#: Rows of a bucket, about, when a table is made; buckets that a table has at most; tries of a writer.
ROWS, MOST, ATTEMPTS = 1_000_000, 65_536, 5

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def settled(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: what several later steps read is computed once, and a lost executor costs a read."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(Exception):
    """Another writer was first, as often as was tried."""


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole, if there is none of that name; False if there is. It appears with its contents, or not at all."""
    jvm = spark._jvm
    fs, where = _path(spark, path)
    whole = jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(whole, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a rename would replace the file here
            parts = [jvm.java.io.File(x.toUri().getPath()).toPath() for x in (where, whole)]
            jvm.java.nio.file.Files.createLink(*parts)
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(whole, where, none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(whole, False)


class Versions:
    """The table at a path: `read`, `merge`, `vacuum`."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket_by: str) -> None:
        self.spark, self.path, self.schema, self.bucket_by = spark, path.rstrip("/"), schema, bucket_by

    def newest(self) -> dict | None:
        """The newest manifest."""
        numbers = self._numbers()
        return self.manifest(numbers[-1]) if numbers else None

    def _numbers(self) -> list[int]:
        fs, where = _path(self.spark, f"{self.path}/versions")
        if not fs.exists(where):
            return []
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(where) if x.getPath().getName().isdigit())

    def manifest(self, version: int) -> dict:
        fs, where = _path(self.spark, f"{self.path}/versions/{version:08d}")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; no rows before the first."""
        found = self.newest() if version is None else self.manifest(version)
        return self._rows(sorted(found["buckets"].values()) if found else [])

    def _buckets(self, count: int):
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(count)).cast("int")

    def _sent(self, incoming: DataFrame, count: int) -> list[int]:
        """The buckets that rows fall in; at most so many numbers."""
        return sorted(r[0] for r in incoming.select(self._buckets(count).alias("b")).distinct().collect())

    def _written(self, rows: DataFrame, count: int, touched: list[int]) -> dict[str, str]:
        """The folder of each touched bucket that has rows. A bucket's rows are dealt by adaptive execution, so a large one has several files."""
        folder = f"rows/{uuid.uuid4().hex}"
        dealt = rows.select(*[f.name for f in self.schema]).withColumn("_bucket", self._buckets(count))
        dealt.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, _ = _path(self.spark, self.path)
        there = {b: f"{folder}/_bucket={b}" for b in touched}
        return {str(b): f for b, f in there.items() if fs.exists(_path(self.spark, f"{self.path}/{f}")[1])}

    def merge(self, incoming: DataFrame, how: Merge, source: str = "", batch: int = 0, buckets: int | None = None, also: DataFrame | None = None) -> int:
        """Publish the version in which touched buckets are how(their rows, the incoming rows of them); returns its number.

        A batch that its source has already published changes nothing. also: further rows whose buckets are rewritten, such as boards
        whose listings may have to be closed. buckets: for a new table; else as many as its first batch has rows for. Raises Conflict after ATTEMPTS.
        """
        done: dict[int, tuple[str | None, str | None]] = {}  # bucket: the folder that was read, that which was written
        for _ in range(ATTEMPTS):
            now = self.newest() or {"version": -1, "count": buckets or max(1, min(MOST, -(-incoming.count() // ROWS))), "buckets": {}, "applied": {}}
            if now["applied"].get(source, -1) >= batch and source:
                return now["version"]
            count = now["count"]
            asked = incoming.select(self.bucket_by) if also is None else incoming.select(self.bucket_by).unionByName(also.select(self.bucket_by))
            touched = self._sent(asked, count)
            stale = [b for b in touched if b not in done or done[b][0] != now["buckets"].get(str(b))]
            if stale:
                before = {b: now["buckets"].get(str(b)) for b in stale}
                own = incoming.where(self._buckets(count).isin(stale))
                written = self._written(how(self._rows([f for f in before.values() if f]), own), count, stale)
                done |= {b: (before[b], written.get(str(b))) for b in stale}
            then = now["buckets"] | {str(b): done[b][1] for b in touched}
            manifest = {"version": now["version"] + 1, "count": count, "buckets": {b: f for b, f in then.items() if f}, "applied": now["applied"] | ({source: batch} if source else {})}
            if put_if_absent(self.spark, f"{self.path}/versions/{manifest['version']:08d}", json.dumps(manifest)):
                return manifest["version"]
        raise Conflict(f"{self.path}: {ATTEMPTS} tries")

    def vacuum(self, keep: int = 10) -> list[str]:
        """Delete older versions and the folders that only they name; those that writers have not yet published are not among them."""
        numbers = self._numbers()
        old, left = numbers[:-keep], numbers[-keep:]
        used = {f for n in left for f in self.manifest(n)["buckets"].values()}
        gone = sorted({f for n in old for f in self.manifest(n)["buckets"].values()} - used)
        fs, _ = _path(self.spark, self.path)
        for name in [*gone, *[f"versions/{n:08d}" for n in old]]:
            fs.delete(_path(self.spark, f"{self.path}/{name}")[1], True)
        return gone
