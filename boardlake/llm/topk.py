"""Exact top-k search with a bit-sliced index.

The index holds, for blocks of rows, one bitmap for each bit of each quantised attribute. A query's scores are
the sum of its attributes' slices, each as often as the query's bits say: bitmaps of equal weight are
added three to two (sum and carry) until one is left for each bit of the score. The top rows follow from
the most significant slice downward. The sum leaves out the `COARSE` lowest slices, which can change a
score by a known amount at most; rows within that of the k-th are the boundary, and their scores
are resolved exactly from all slices.

Lists of `BATCH` queries go to the blocks, a list and a block to a task; a block returns k rows a query. Components of any finite
size are summed exactly: where they leave 64 bits no room, slices and scores are Python integers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding_dedup import usable
from .shared import stored

ROWS, BATCH, COARSE = 16384, 2048, 2
#: Quantised components beyond this are Python integers, for whose products and sums 64 bits may be too few.
WIDE = 1 << 24
#: What a score of 64 bits can say.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(256 * x), x as double: 64-bit integers, or Python integers if one is WIDE."""
    whole = np.floor(v.astype(np.float64) * 256)
    if np.abs(whole).max(initial=0) < WIDE:
        return whole.astype(np.int64)
    return np.array([int(x) for x in whole.ravel()], object).reshape(whole.shape)


def packed(flags: np.ndarray) -> np.ndarray:
    """The last axis as bits of 64-bit words, padded with zeros."""
    pad = -flags.shape[-1] % 64
    return np.packbits(np.pad(flags, [(0, 0)] * (flags.ndim - 1) + [(0, pad)]), axis=-1, bitorder="little").view(np.uint64)


def set_places(words: np.ndarray) -> np.ndarray:
    """The places of the bits that are set."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(d: int) -> pa.RecordBatch:
        nonlocal seq
        ids, v = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
        low = v.min(0)
        u = v - low
        bits = max(1, int(u.max()).bit_length())
        slices = np.stack([packed(np.ascontiguousarray(((u >> b) & 1).T, bool)) for b in range(bits)], 1)
        seq += 1
        cols = [pa.array([(task << 24) | seq]), pa.array([d], pa.int32()), pa.array([bits], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([json.dumps(low.tolist())]), pa.array([slices.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["block", "dim", "bits", "ids", "low", "slices"])

    for batch in batches:
        dims = batch.column(2).to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            ids = part.column(0).to_numpy()
            for i in range(0, len(ids), ROWS):
                held.setdefault(int(d), []).append((ids[i : i + ROWS], quantised(v[i : i + ROWS])))
                if sum(len(x[0]) for x in held[int(d)]) >= ROWS:
                    yield block(int(d))
    for d in sorted(held):
        yield block(d)


class Block:
    """The bit-sliced index of some rows: slices[attribute, bit] are bitmaps over the rows."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray) -> None:
        self.ids, self.low, self.slices = ids, low, slices
        self.valid = packed(np.ones(len(ids), bool))

    def added(self, slices: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """The bitmaps, by bit, of the sum over attributes of weight * slices."""
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        bits, top = slices.shape[1], int(weight.max(initial=0)).bit_length()
        w = 0
        while w < bits + top - 1 or carried:
            rows = carried
            for b in range(max(0, w - top + 1), min(bits, w + 1)):
                has = (weight >> (w - b)) & 1 == 1
                if has.any():
                    rows.append(slices[has, b])
            carried = []
            m = np.concatenate(rows) if rows else np.zeros((0, len(self.valid)), np.uint64)
            while len(m) > 2:
                k = len(m) // 3
                x, y, z = m[:k], m[k : 2 * k], m[2 * k : 3 * k]
                xy = x ^ y
                carried.append((x & y) | (z & xy))
                m = np.concatenate([xy ^ z, m[3 * k :]])
            if len(m) == 2:
                carried.append((m[0] & m[1])[None])
                m = (m[0] ^ m[1])[None]
            out.append(m[0] if len(m) else np.zeros_like(self.valid))
            w += 1
        return out

    def search(self, query: int, q: np.ndarray, k: int, coarse: int = COARSE) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k rows with the highest scores, ties to smaller ids, without the query's own."""
        able = self.valid & ~packed(self.ids == query)
        n = int(np.bitwise_count(able).sum())
        if n > k:
            coarse = min(coarse, self.slices.shape[1] - 1)
            weight = np.abs(q)  # also of Python integers
            upper = np.where((q < 0)[:, None, None], ~self.slices[:, coarse:], self.slices[:, coarse:])
            sums = self.added(upper, weight)
            rest, need, at = able, k, 0
            for b in range(len(sums) - 1, -1, -1):
                has = rest & sums[b]
                c = int(np.bitwise_count(has).sum())
                if c >= need:
                    rest, at = has, at | 1 << b
                else:
                    rest, need = rest & ~sums[b], need - c
            # a score is 2**coarse * sum and (2**coarse - 1) * all weights at most above it
            least = max(0, at - (((1 << coarse) - 1) * int(weight.sum()) >> coarse))
            more, equal = np.zeros_like(able), able
            for b in range(len(sums) - 1, -1, -1):
                if least >> b & 1:
                    equal = equal & sums[b]
                else:
                    more, equal = more | (equal & sums[b]), equal & ~sums[b]
            able = more | equal
        rows = set_places(able)
        bit = (self.slices[:, :, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        if q.dtype == self.low.dtype == np.int64 and self.slices.shape[1] <= WIDE.bit_length():
            v = (bit.astype(np.int64) << np.arange(self.slices.shape[1])[None, :, None]).sum(1) + self.low[:, None]
            score = q @ v
            best = np.lexsort((self.ids[rows], -score))[:k]
            return self.ids[rows[best]], score[best]
        exact = self.low.astype(object)[:, None] + sum(bit[:, b].astype(object) << b for b in range(self.slices.shape[1]))
        score = [sum(x * y for x, y in zip(q.tolist(), exact[:, r].tolist(), strict=True)) for r in range(len(rows))]
        best = sorted(range(len(rows)), key=lambda r: (-score[r], self.ids[rows[r]]))[:k]
        return self.ids[rows[best]], np.array([score[r] for r in best], object)


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                d, bits = batch.column("dim")[r].as_py(), batch.column("bits")[r].as_py()
                raw = {c: batch.column(c)[r].as_buffer() for c in ("ids", "slices")}
                low = json.loads(batch.column("low")[r].as_py())
                low = np.array(low, np.int64 if max(map(abs, low), default=0) < WIDE else object)
                block = Block(np.frombuffer(raw["ids"], np.int64), low, np.frombuffer(raw["slices"], np.uint64).reshape(d, bits, -1))
                asked = batch.column("queries")[r].values
                v = asked.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                out: list[tuple[int, int, int]] = []
                for query, x in zip(asked.field("vec_id").to_pylist(), v, strict=True):
                    ids, score = block.search(query, quantised(x), k)
                    out += [(query, i, s) for i, s in zip(ids.tolist(), score.tolist(), strict=True)]
                who, what, score = zip(*out, strict=True) if out else ((), (), ())
                # the order of scores that no long holds is that of their digits' number and of the digits
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(what, pa.int64()), pa.array([min(max(s, LEAST), MOST) for s in score], pa.int64()), pa.array([sortable(s) for s in score], pa.string())], ["query_id", "vec_id", "score", "exact"])

    return run


def sortable(score: int) -> str | None:
    """A text that orders scores beyond 64 bits among each other; null for all others."""
    if LEAST < score < MOST:
        return None
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return key if score > 0 else "".join(str(9 - int(c)) for c in key)


def index(vectors: DataFrame) -> DataFrame:
    """The index of (vec_id, embedding, dim): a row for each block of at most 2 * ROWS rows of one length; no shuffle."""
    return vectors.mapInArrow(_indexed, "block long, dim int, bits int, ids binary, low string, slices binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest inner products of floor(256 * x) for each query row.

    Candidates are all rows but those with the query's id; ties go to the smaller vec_id. Vectors that are
    null, empty, or hold null or non-finite components take no part, as do rows without an id; zero
    vectors do. Only vectors of the query's length are candidates. Repeated rows are candidates of
    their own; a query id is asked once, with the smallest of its vectors. Components may have any finite size: ranks follow
    the exact scores, and a score beyond 64 bits is given as the nearest long. An empty table gives an empty result.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), is_query.alias("q"))
    zero = F.coalesce(F.forall("embedding", lambda x: x == 0), F.lit(False)) & (F.size("embedding") > 0)
    fine = own.where(F.col("vec_id").isNotNull() & (usable(F.col("embedding")) | zero))
    fine = fine.withColumn("dim", F.size("embedding"))
    blocks = stored(index(fine.select("vec_id", "embedding", "dim")), "slices")
    asked = stored(fine.where("q").groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding")), "queries")
    batches = max(1, -(-asked.count() // BATCH))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(batches)).cast("int")
    # about BATCH queries in a list, half as many bytes as a block's slices: either is moved once for so many of the other
    lists = asked.groupBy(F.col("dim").alias("_d"), group.alias("_b")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    pairs = blocks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    met = pairs.join(lists, (F.col("dim") == F.col("_d")) & (F.col("batch") == F.col("_b"))).select("block", "batch", "dim", "bits", "ids", "low", "slices", "queries")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.repartition(tasks, "block", "batch").mapInArrow(_searched(k), "query_id long, vec_id long, score long, exact string")
    high, low = F.col("score") == MOST, F.col("score") == LEAST
    beyond = [F.when(high, F.col("exact")).desc_nulls_last(), F.when(low, F.col("exact")).desc_nulls_last()]
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *beyond, "vec_id"))
    return found.withColumn("rank", at).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
