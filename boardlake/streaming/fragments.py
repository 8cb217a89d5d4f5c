"""The fragment log as a stream: a stream of JSON files, merged batch by batch into a versioned table in buckets.

A batch is idempotent: a version names the last batch of its stream, rows that come late change nothing, and a call without new
input reads what is there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import close_missing, latest, upsert
from ..operators.versions import Merge, Versions
from ..session import shared_folder


def fragments(spark: SparkSession, path: str, schema: str | StructType, files: int | None = None, bytes_: str | None = None, pattern: str = "*.json") -> DataFrame:
    """The log as a stream; a trigger takes at most so many files or bytes, and always one.

    Where the schema has a text column _corrupt, it holds lines that are no JSON (see `corrupt`).
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if bytes_:
        reader = reader.option("maxBytesPerTrigger", bytes_)
    return reader.json(path).withColumn("_fragment", F.input_file_name())


def parquet_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """One Parquet table of a folder as a stream of its files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def apply_batch(stored: DataFrame, batch: DataFrame, run: datetime, complete: DataFrame | None = None, tracked: DataFrame | None = None) -> DataFrame:
    """The table after a batch of postings: of each id the latest fragment's row is merged; boards that were read whole close what they omit."""
    incoming = latest(batch, "id", ["_fragment"]).drop("_fragment")
    merged = upsert(stored, incoming, run, tracked=tracked)
    return merged if complete is None else close_missing(merged, incoming, complete, run)


def run_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that there is, through foreachBatch; the checkpoint makes delivery at least once, handle makes it once."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_late(order: list[str], key: str) -> Merge:
    """Latest wins, whenever a row comes: one that is not newer than the stored one changes nothing."""
    return lambda stored, incoming: latest(stored.unionByName(incoming), key, order)


def latest_by_key(stream: DataFrame, name: str, key: str, order: list[str], folder: str | None = None, buckets: int | None = None) -> DataFrame:
    """The latest row of each key of all that a stream has had so far.

    A batch rewrites only the buckets of its keys, in a version that names the batch; delivered again, it is known and changes nothing, and
    a call without new input reads what is there. Neither driver nor memory holds the keys. folder keeps table and progress; without one
    they are new.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stored = Versions(spark, f"{folder}/table", stream.schema, key)

    def merged(batch: DataFrame, number: int) -> None:
        rows = latest(batch, key, order).select(*stream.columns)
        Versions(batch.sparkSession, f"{folder}/table", stream.schema, key).merge(rows, merge_late(order, key), "stream", number, buckets)

    run_once(stream, merged, f"{folder}/checkpoint").awaitTermination()
    return stored.read()


def apply_log(stream: DataFrame, stored: Versions, run: datetime, checkpoint: str, tracked: Callable[[], DataFrame] | None = None) -> Versions:
    """Merge a log of postings into a table that is bucketed by company, by the rules of every field.

    A row has id, company_domain, _fragment and _complete (whether its board was read whole), and `seq`, a number that rises with the
    fragments: a posting of a lower one than the stored row's comes late and changes nothing. A board that was read whole closes what
    it omits; its postings share a bucket, so that only this is rewritten.
    """

    def merged(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, stored.path, stored.schema, stored.bucket_by)
        rows = latest(batch, "id", ["seq", "_fragment"]).persist()
        known = tracked() if tracked else None

        def how(before: DataFrame, incoming: DataFrame) -> DataFrame:
            newer = incoming.join(before.select("id", F.col("seq").alias("_had")), "id", "left").where(F.col("_had").isNull() | (F.col("seq") > F.col("_had"))).drop("_had")
            after = upsert(before, newer.drop("_fragment", "_complete"), run, tracked=known)
            whole = newer.where("_complete").select("company_domain")
            return close_missing(after, incoming, whole, run)

        table.merge(rows, how, "log", number)
        rows.unpersist()

    run_once(stream, merged, checkpoint).awaitTermination()
    return stored


def corrupt(batch: DataFrame, path: str, number: int) -> DataFrame:
    """The batch without the lines that are no JSON, which are kept aside (fragment, line) under the batch's number."""
    aside = batch.where(F.col("_corrupt").isNotNull()).select("_fragment", "_corrupt")
    aside.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return batch.where(F.col("_corrupt").isNull()).drop("_corrupt")
