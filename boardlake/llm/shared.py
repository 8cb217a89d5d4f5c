"""What several operators need: tables in the shared folder, distributed ranks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import mixed

#: Rows that one task ranks or sorts at a time.
CHUNK = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset in a local session, as in tests, a temporary folder is made and set; on a cluster, where
    executors would not find such a folder again, a missing setting is an error (ValueError).
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    It cuts the lineage, so that a lost executor costs a read of files instead of the whole plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.stored_at = path
    for made in _SCRATCH:
        made.append(path)
    return again


#: The tables that were stored within each open `scratch`.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are stored within it are deleted at its end; for whoever writes a result there. What is to stay is taken from the list."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield made
    finally:
        _SCRATCH.remove(made)
        for path in made:
            dropped(spark, path)


#: Rows of a table of texts that a task's batch has; as many as Spark takes of itself are some 34 MB, held on both sides.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches have TEXT_ROWS rows in this session, unless it has a setting of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(TEXT_ROWS))


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a write go when the write has ended; for tables that are stored one after the other."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until df has no such column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def forget(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing will read again."""
    path = df.__dict__.get("stored_at")
    if path:
        dropped(df.sparkSession, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ranked(df: DataFrame, group: list[str], spread: Column, order: list[Column], rows: int, name: str = "rank", by: int = CHUNK) -> DataFrame:
    """df with a gapless rank (long, from 0) in each group, without ever sorting a group in one task.

    Rows are dealt to cells by `spread` (a long that is even over all rows), a cell is ranked
    in one task, and the cells' offsets come from one count per (group, cell). rows is the
    number of rows in df; it sets only how many cells there are, so a cell has about `by` rows
    of all groups together, however hot a group is.
    """
    cells = max(1, min(1 << 20, -(-rows // by)))
    dealt = df.withColumn("_cell", F.pmod(spread, F.lit(cells)))
    counts = dealt.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_cell", *group).orderBy(*order)
    local = dealt.withColumn("_local", F.row_number().over(within) - 1)
    on = F.lit(True)
    for c in [*group, "_cell"]:
        on = on & local[c].eqNullSafe(offsets[c])
    return (
        local.join(offsets, on, "left")
        .select(*[local[c] for c in df.columns], (F.col("_local") + F.col("_off")).cast("long").alias(name))
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable.

    Alternating large-star and small-star contraction: each round connects every node to the
    smallest node that it or its neighbours know, so the depth falls geometrically. Edges never
    multiply, hubs are met by an aggregate before a join, and each round is a stored table.
    """
    sides = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = stored(sides.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sign = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are a table of their own, so that adaptive execution can split the join at a hub, which is
        # always the smaller end here; below edges are met by their larger ends, of which none is hot
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        then = stored(small, "links")
        mark = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for table in (low, now):
            forget(table)
        now = then
        if mark == sign:
            break
        sign = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return linked.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Bits of the largest sieve; one with more keys lets more rows through, never fewer than it should.
SIEVE_BITS = 1 << 27
_PART = 1 << 16


def sieve(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A function of a long column: false only for values that are not among keys[key].

    It is a Bloom filter with two bits a key and about 16 bits of room for each, at most SIEVE_BITS / 8 bytes
    whatever the number of keys. Rows that it rejects need no shuffle to be known as strangers.
    """
    n = keys.count()
    bits = max(_PART, min(SIEVE_BITS, 1 << max(1, 16 * n - 1).bit_length()))

    def places(x: np.ndarray) -> np.ndarray:
        h = mixed(x.astype(np.int64).view(np.uint64))
        return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)

    def parts(batches):
        flags: dict[int, np.ndarray] = {}
        for batch in batches:
            at = places(batch.column(0).to_numpy()).ravel()
            for p in np.unique(at // _PART):
                flags.setdefault(int(p), np.zeros(_PART, bool))[at[at // _PART == p] % _PART] = True
        for p, f in flags.items():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([np.packbits(f).tobytes()], pa.binary())], ["p", "bits"])

    def either(group: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("bits").to_pylist()])
        return pa.table({"p": [group.column("p")[0].as_py()], "bits": pa.array([both.tobytes()], pa.binary())})

    table = np.zeros(bits // 8, np.uint8)
    found = keys.select(F.col(key).cast("long").alias("k")).where("k is not null").mapInArrow(parts, "p long, bits binary")
    for r in found.groupBy("p").applyInArrow(either, "p long, bits binary").collect():
        table[r["p"] * (_PART // 8) : (r["p"] + 1) * (_PART // 8)] = np.frombuffer(r["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(table.tobytes())

    @F.pandas_udf("boolean")
    def passes(x: pd.Series) -> pd.Series:
        flags = np.frombuffer(shared.value, np.uint8)
        at = places(x.fillna(0).to_numpy(np.int64))
        return pd.Series((flags[at >> 3] >> (7 - (at & 7)) & 1).all(0))

    return passes
