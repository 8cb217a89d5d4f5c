"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors have cosine >= t just where their squared distance is at most 2 - 2t. A rotation
spreads that distance over the axes and keeps it; the axes are split into blocks, and a pair within
the whole budget is within the proportional budget in one block at least. So the union of the blocks'
range joins holds every pair, and few others; each of it is verified on the original vectors in double.

Equal vectors are one node with a multiplicity. Nodes are dealt to chunks of about `CHUNK` by a hash; every
two chunks meet in one task, in which each pair belongs to exactly one task, so links are
counted once. A task range-joins its chunks block by block, tile by tile (a tile pair is skipped in a
block whose bounding boxes lie farther apart than its budget), and returns a row for each node
with links: their number and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import starts, whole_groups
from .shared import components, stored

CHUNK, TILE, BLOCKS, LENGTHS = 8192, 512, 4, 10_000


def usable(v: Column) -> Column:
    """True for vectors with components that are all present and finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(d: int, seed: int = 1) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length in double; first scaled by their largest component, so that no square over- or underflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def linked_pairs(x: np.ndarray, y: np.ndarray | None, least: float, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of x, row of y) with cosine >= least, of one tile after the other; with no y, pairs i < j of x. Rows are unit vectors in double."""
    same = y is None
    y = x if same else y
    d = x.shape[1]
    r = rotation(d)
    cuts = np.linspace(0, d, min(blocks, d) + 1).astype(int)
    spans = [(a, b, (2 - 2 * least) * (b - a) / d) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    # tiles of rows that are near each other along the first axis of the rotation
    xr, yr = x @ r, y @ r
    ox, oy = np.argsort(xr[:, 0], kind="stable"), np.argsort(yr[:, 0], kind="stable")
    xs, ys = xr[ox].astype(np.float32), yr[oy].astype(np.float32)
    lo, hi = ([f.reduceat(ys, np.arange(0, len(ys), TILE), axis=0) for f in (np.minimum, np.maximum)] if len(ys) else (ys, ys))
    # a block's squared distance is one product: (-2 x, |x|^2, 1) times (y, 1, |y|^2)
    size = lambda v, a, b: (v[:, a:b] ** 2).sum(1, keepdims=True)
    left = [np.hstack((-2 * xs[:, a:b], size(xs, a, b), np.ones((len(xs), 1), np.float32))) for a, b, _ in spans]
    right = [np.ascontiguousarray(np.hstack((ys[:, a:b], np.ones((len(ys), 1), np.float32), size(ys, a, b))).T) for a, b, _ in spans]
    for i in range(0, len(xs), TILE):
        t = xs[i : i + TILE]
        tl, th = t.min(0), t.max(0)
        for j in range(i if same else 0, len(ys), TILE):
            k = j // TILE
            gap = np.maximum(0, np.maximum(tl - hi[k], lo[k] - th)) ** 2
            found = None
            for (a, b, most), p, q in zip(spans, left, right, strict=True):
                loose = most * 1.001 + 1e-5  # both are in single precision
                if gap[a:b].sum() > loose:
                    continue
                near = p[i : i + TILE] @ q[:, j : j + TILE] <= loose
                found = near if found is None else np.logical_or(found, near, out=found)
            if found is None:
                continue
            p, q = np.nonzero(found)
            p, q = ox[i + p], oy[j + q]
            if same:
                if i == j:  # a tile with itself meets each pair twice
                    p, q = p[p < q], q[p < q]
                else:
                    p, q = np.minimum(p, q), np.maximum(p, q)
            for s in range(0, len(p), 65536):
                a, b = p[s : s + 65536], q[s : s + 65536]
                sure = np.einsum("ij,ij->i", x[a], y[b]) >= least
                if sure.any():
                    yield a[sure], b[sure]


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all rows that the pairs link, also by way of earlier pairs, their smallest row as root."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _joined(least: float, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            at = starts(table, 3)
            lo, hi, last = (table.column(c).to_numpy() for c in ("lo", "hi", "last"))
            ids, mult, mine = (table.column(c).to_numpy() for c in ("rep", "mult", "mine"))
            for a, b in zip(at[:-1], at[1:], strict=True):
                part = table.slice(a, b - a)
                flat = part.column("embedding").combine_chunks()
                flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
                v = unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1))
                own, m = ids[a:b], mult[a:b]
                order = np.argsort(own, kind="stable")  # then the smallest row has the smallest id
                v, own, m, low = v[order], own[order], m[order], (mine[a:b] == lo[a])[order]
                first, second = np.flatnonzero(low), np.flatnonzero(~low)
                met = [(first, second)] if len(first) and len(second) else []
                # a chunk's own pairs belong to its task with the next chunk, the last one's to that before
                met += [(first, None)] if hi[a] - lo[a] <= 1 and len(first) else []
                met += [(second, None)] if hi[a] == last[a] and lo[a] + 1 == hi[a] and len(second) else []
                n, root = np.zeros(len(own), np.int64), np.arange(len(own))
                for x, y in met:
                    for p, q in linked_pairs(v[x], None if y is None else v[y], least, blocks):
                        # pairs are counted and united as they are found, and never held
                        p, q = x[p], (x if y is None else y)[q]
                        n += np.bincount(p, m[q], len(n)).astype(np.int64) + np.bincount(q, m[p], len(n)).astype(np.int64)
                        _united(root, p, q)
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(own[root[some]]), pa.array(n[some])], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; two rows are linked where their cosine in double is >= least.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths never link. Rows of equal vectors are linked with each other, repeated rows too;
    if one vec_id comes with several vectors, they share their links. Rows without an id count as no
    one's link, have 0 links, no component and are not kept. An empty table gives an empty result.
    Further columns are not read.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    fine = own.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    nodes = stored(fine.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "vectors").withColumn("dim", F.size("embedding"))
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    sizes = stored(sizes, "lengths")
    mine = F.pmod(F.xxhash64("rep", "embedding"), F.col("chunks"))
    # a row for each length of vectors: handed out while there are few, else left to adaptive execution
    dealt = nodes.join(F.broadcast(sizes) if sizes.count() <= LENGTHS else sizes, "dim").withColumn("mine", mine).withColumn("last", F.col("chunks") - 1)
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda j: j != F.col("mine")))
    tasks = dealt.withColumn("_o", F.explode(others)).select("dim", F.least("_o", "mine").alias("lo"), F.greatest("_o", "mine").alias("hi"), "mine", "last", "rep", "mult", "embedding")
    found = stored(tasks.repartition("dim", "lo", "hi").sortWithinPartitions("dim", "lo", "hi").mapInArrow(_joined(least, blocks), "a long, b long, n long"), "links")
    linked = found.groupBy("a").agg(F.sum("n").alias("n")).join(components(found.select("a", "b").distinct()), F.col("a") == F.col("node"), "left")
    of_node = nodes.join(linked, F.col("rep") == F.col("a"), "left").select(
        F.col("embedding").alias("_v"), (F.coalesce("n", F.lit(0).cast("long")) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id")
    )
    known = F.when(usable(F.col("embedding")) & F.col("vec_id").isNotNull(), F.col("embedding"))
    both = own.select("vec_id", known.alias("k")).join(of_node, F.col("k") == F.col("_v"), "left")
    group = F.when(F.col("vec_id").isNotNull(), F.coalesce("class_id", "vec_id"))
    return both.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), group.alias("component_id"), F.coalesce(F.col("vec_id") == group, F.lit(False)).alias("kept"))
