"""Lloyd's clustering with the dimensions in shards.

A vector's components are cut into blocks of `WIDTH` columns, and so is every centroid. The blocks of `CHUNK` vectors are
rows of a table that is bucketed by (block, chunk), so they never move again. In a round

1. a column-block task has the slice of all centroids that belongs to its block, and computes the exact partial distances of
   its vectors to it;
2. the blocks' partial distances are added up by chunk, and the smallest sum (of equal ones the first) is the assignment;
3. the assignments go back to the buckets, where each block adds up its own columns by cluster; what the tasks of a block have
   summed up meets once, as one row a task, and gives the block's next slice.

So no task, and not the driver, ever holds a whole vector set, a whole distance matrix or all centroids; each round ends in a
stored table of slices. Components are integers; those beyond what 64 bits can square and add are Python integers.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, forget, shared_dir, stored, tidied

#: Columns of a block; vectors of a chunk.
WIDTH, CHUNK = 16, 2048
#: Bytes of slices that are handed to every task; more of them are joined by their block.
SMALL = 16 << 20
MOST = (1 << 63) - 1


def whole(v: np.ndarray, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x), x as double: 64-bit integers, or Python integers if squares of differences could leave 64 bits."""
    x = np.floor(v.astype(np.float64) * scale)
    if np.abs(x).max(initial=0) < math.isqrt((1 << 60) // dims):
        return x.astype(np.int64)
    return np.array([int(a) for a in x.ravel()], object).reshape(x.shape)


def packed(x: np.ndarray) -> bytes:
    """A matrix as bytes: 64-bit integers, or JSON where they are Python integers."""
    return json.dumps(x.tolist()).encode() if x.dtype == object else b"\0" + np.ascontiguousarray(x).tobytes()


def unpacked(raw: bytes, columns: int) -> np.ndarray:
    if raw[:1] == b"\0":
        return np.frombuffer(raw, np.int64, offset=1).reshape(-1, columns)
    return np.array(json.loads(raw), object).reshape(-1, columns)


def narrow(x: np.ndarray, dims: int) -> np.ndarray:
    """Python integers as 64-bit ones where all are small enough."""
    return x.astype(np.int64) if np.abs(x).max(initial=0) < math.isqrt((1 << 60) // dims) else x


def _cut(dims: int, scale: int):
    """(chunk, block, ids, x): the columns of each block; the first block's row has the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                v = whole(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale, dims)
                blocks = [v[:, a : a + WIDTH] for a in range(0, dims, WIDTH)]
                ids = [part.column("vec_id").to_pylist()] + [None] * (len(blocks) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(blocks), (task << 32) | seq)), pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(ids, pa.list_(pa.int64())), pa.array([packed(x) for x in blocks], pa.binary())],
                    ["chunk", "block", "ids", "x"],
                )
                seq += 1

    return run


def _width(dims: int, block: int) -> int:
    return min(WIDTH, dims - block * WIDTH)


def _slices(dims: int):
    """One slice for each block from the rows of the first centroids."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        block = rows.column("block")[0].as_py()
        x = np.concatenate([unpacked(r, _width(dims, block)) for r in rows.column("x").to_pylist()])
        return pa.table({"block": pa.array([block], pa.int32()), "slice": pa.array([packed(x)], pa.binary())})

    return run


def _partial(dims: int):
    """The squared distances of a chunk's vectors to all centroids, as far as a block's columns go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, x, c in zip(*(batch.column(n).to_pylist() for n in ("block", "x", "slice")), strict=True):
                x, c = (unpacked(a, _width(dims, block)) for a in (x, c))
                out.append((len(c), packed((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None])))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([k for k, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], ["chunk", "k", "d"])

    return run


def _nearest(rows: pa.Table) -> pa.Table:
    """The blocks' distances added up, and of each vector the nearest centroid; a distance beyond 64 bits is given as the largest long."""
    k = rows.column("k")[0].as_py()
    parts = [unpacked(d, k) for d in rows.column("d").to_pylist()]
    total = sum(parts[1:], parts[0])
    at = total.argmin(1)
    least = [min(int(x), MOST) for x in total[np.arange(len(total)), at]]
    return pa.table({"chunk": rows.column("chunk")[:1].combine_chunks(), "cluster": pa.array([at], pa.list_(pa.int32())), "distance": pa.array([least], pa.list_(pa.int64()))})


def _sums(dims: int):
    """(block, n, sums) of a task: what its chunks' vectors add up to in each cluster, a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r, (block, x, k) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("block", "x", "k")), strict=True)):
                x, at = unpacked(x, _width(dims, block)), np.asarray(batch.column("cluster")[r].values)
                n, sums = held.setdefault(block, (np.zeros(k, np.int64), np.zeros((k, x.shape[1]), object)))
                own = np.zeros((k, x.shape[1]), x.dtype)
                np.add.at(own, at, x)
                held[block] = n + np.bincount(at, minlength=k), sums + own
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.list_(pa.int64())), pa.array([json.dumps(s.tolist()) for _, s in held.values()])], ["block", "n", "sums"]
            )

    return run


def _updated(dims: int):
    """A block's next slice: the floor of its clusters' means; an empty cluster's centroid stays."""

    def run(rows: pa.Table, before: pa.Table) -> pa.Table:
        block = before.column("block")[0].as_py()
        c = unpacked(before.column("slice")[0].as_py(), _width(dims, block)).astype(object)
        if rows.num_rows:
            n = sum(np.array(x, object) for x in rows.column("n").to_pylist())
            sums = sum(np.array(json.loads(x), object) for x in rows.column("sums").to_pylist())
            c = np.array([s // m if m else old for s, m, old in zip(sums, n, c, strict=False)], object).reshape(c.shape)
        return pa.table({"block": pa.array([block], pa.int32()), "slice": pa.array([packed(narrow(c, dims))], pa.binary())})

    return run


def _texts(dims: int):
    """(cluster, block, text) of each centroid's components in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("slice").to_pylist(), strict=True):
                c = unpacked(raw, _width(dims, block))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array([block] * len(c), pa.int32()), pa.array([",".join(map(str, x)) for x in c.tolist()])], ["cluster", "block", "text"])

    return run


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that is kept.

    Kept are vectors of exactly `dims` components, none null or not finite; others have no row. A component x is
    floor(scale * x). Centroids start as the k kept vectors with the smallest sha256 of '<seed>:<vec_id>' (ties of repeated ids: the
    smaller vector first), as many as there are if they are fewer. A row without an id is clustered like others; it starts a centroid
    only if too few rows have an id. Repeated rows count as often as they come. Each round assigns every vector to its nearest centroid
    (ties: the smaller number), then moves every centroid that has vectors to the floor of their mean. Distances and sums of
    them beyond 64 bits are given as the largest long. An empty table gives an empty result. Further columns are not read.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = own.where(F.coalesce((F.size("embedding") == dims) & fine, F.lit(False)))
    name, path = f"blocks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = kept.mapInArrow(_cut(dims, scale), "chunk long, block int, ids array<long>, x binary")
    with tidied(spark):
        cut.repartition(buckets, "block", "chunk").write.bucketBy(buckets, "block", "chunk").option("path", path).format("parquet").saveAsTable(name)
        try:
            assigned, slices = _rounds(spark.table(name), kept, k, rounds, dims, scale, seed)
            ids = spark.table(name).where("block = 0").select("chunk", "ids")
            each = assigned.join(ids, "chunk").select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("e")).select("e.ids", "e.cluster", "e.distance")
            found = stored(each, "assigned")
        finally:
            spark.sql(f"DROP TABLE {name}")
    dropped(spark, path)
    # a row for each centroid, of which there are k at most
    sha = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), ",").cast("binary"), 256)
    hashes = slices.mapInArrow(_texts(dims), "cluster int, block int, text string").groupBy("cluster").agg(sha.alias("centroid_sha256"))
    total = lambda x: F.least(F.sum(x), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = found.groupBy("cluster").agg(total(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.lit(found.agg(total(F.col("distance").cast("decimal(38,0)"))).first()[0]))
    return found.join(F.broadcast(sums.join(hashes, "cluster")), "cluster").select(F.col("ids").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(blocks: DataFrame, kept: DataFrame, k: int, rounds: int, dims: int, scale: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The last assignment (chunk, cluster, distance) and the last slices (block, slice), which are stored."""
    count = -(-dims // WIDTH)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(order.asc_nulls_last(), "embedding").limit(k)
    slices = stored(first.mapInArrow(_cut(dims, scale), "chunk long, block int, ids array<long>, x binary").groupBy("block").applyInArrow(_slices(dims), "block int, slice binary"), "slices")
    handed = F.broadcast if k * dims * 8 <= SMALL else (lambda df: df)

    def assigned(slices: DataFrame) -> DataFrame:
        near = blocks.select("block", "chunk", "x").join(handed(slices), "block").mapInArrow(_partial(dims), "chunk long, k int, d binary")
        return near.groupBy("chunk").applyInArrow(_nearest, "chunk long, cluster array<int>, distance array<long>")

    for _ in range(rounds):
        sent = assigned(slices).select("chunk", "cluster", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"))
        met = blocks.select("block", "chunk", "x").join(sent.hint("shuffle_hash"), ["block", "chunk"]).withColumn("k", F.lit(k))
        sums = met.mapInArrow(_sums(dims), "block int, n array<long>, sums string")
        then = stored(sums.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(_updated(dims), "block int, slice binary"), "slices")
        forget(slices)
        slices = then
    return assigned(slices), slices


def oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in SQL, round after round."""
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT r, CAST(min(d * {k} + c) % {k} AS INTEGER) AS c, min(d * {k} + c) // {k} AS d FROM (SELECT x.r, m.c, sum(CAST(x.x - m.x AS HUGEINT) * (x.x - m.x)) AS d FROM x JOIN m{i} m USING (j) GROUP BY x.r, m.c) GROUP BY r)"
    moved = lambda i: f"m{i + 1} AS MATERIALIZED (SELECT m.c, m.j, coalesce(s.x, m.x) AS x FROM m{i} m LEFT JOIN (SELECT a.c, x.j, CAST((sum(CAST(x.x AS HUGEINT)) - (sum(CAST(x.x AS HUGEINT)) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM a{i} a JOIN x USING (r) GROUP BY a.c, x.j) s USING (c, j))"
    steps = ", ".join(f"{near(i)}, {moved(i)}" for i in range(rounds))
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, embedding) - 1 AS r, embedding AS e
    FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dims}),
x AS MATERIALIZED (SELECT r, j, CAST(floor({scale} * CAST(e[j] AS DOUBLE)) AS BIGINT) AS x FROM v, range(1, {dims + 1}) g(j)),
m0 AS MATERIALIZED (SELECT r AS c, j, x FROM x WHERE r < {k}), {steps}, {near(rounds)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS s FROM m{rounds} GROUP BY c)
SELECT vec_id, a.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN h ON h.c = a.c"""
