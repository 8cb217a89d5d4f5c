"""Orders of whole tables without one task that sorts them: gapless ranks, and chunks that are filled one after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versions import settled

#: Rows of a segment, which one task walks through.
SEGMENT = 20_000


def ranked(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their rank (long, from 0) in the order, which should end in a key so that it is one.

    Rows are dealt to ranges of the order, cut at a sample, and ranked there; the rows before a range come from one count of each. Rows that
    are equal in all of the order share a range.
    """
    dealt = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_at", at).join(F.broadcast(offsets), "_range").select(*rows.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


def _next(size: np.ndarray, most: int, most_size: int) -> np.ndarray:
    """Where a chunk that begins at each row ends: it has `most` rows and most_size of size at most, and one row at least."""
    total = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(len(size))
    fit = np.searchsorted(total, total[:-1] + most_size, "right") - 1
    return np.minimum(np.maximum(fit, at + 1), at + most)


def chunks(rows: DataFrame, order: list[Column | str], size: Column, most: int, most_size: int, name: str = "chunk", segment: int | None = None) -> DataFrame:
    """rows with rank and chunk (long, from 0): in their order, each chunk takes rows until it has `most` or the next would take it over most_size.

    A row that is larger than most_size is a chunk of its own. Where a chunk begins depends on all rows before, but only by one of `most`
    places in a segment: so each segment tells for every place where a chunk might first begin in it how many chunks it begins and where the
    next segment's first begins; these few numbers are followed from segment to segment, and then each segment numbers its rows.
    """
    segment = max(segment or SEGMENT, most)
    known = settled(ranked(rows.withColumn("_size", size.cast("long")), order), "ranked")
    narrow = known.select("rank", "_size")
    own = F.floor(F.col("rank") / segment).cast("long")
    # a chunk may reach into the next segment: its first rows are lent to the one before
    shared = F.when((F.pmod("rank", F.lit(segment)) < most) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = narrow.withColumn("seg", F.explode(shared))

    def ends(table: pd.DataFrame) -> tuple[np.ndarray, int, int]:
        table = table.sort_values("rank")
        first = int(table["seg"].iloc[0]) * segment
        mine = int((table["rank"] < first + segment).sum())
        return _next(table["_size"].to_numpy(np.int64), most, most_size)[:mine], mine, first

    def told(table: pd.DataFrame) -> pd.DataFrame:
        then, n, _ = ends(table)
        out, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):  # from the last row on
            j = then[i]
            out[i], count[i] = (out[j], count[j] + 1) if j < n else (j - n, 1)
        some = min(most, n)
        return pd.DataFrame({"seg": [table["seg"].iloc[0]], "out": [out[:some].tolist()], "count": [count[:some].tolist()]})

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, before = 0, 0
        for batch in batches:
            found = []
            for seg, out, count in zip(*(batch.column(c).to_pylist() for c in ("seg", "out", "count")), strict=True):
                found.append((seg, entry, before))
                if entry < len(out):
                    entry, before = out[entry], before + count[entry]
                else:  # a last segment that the chunk before fills
                    entry = 0
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3, ["seg", "entry", "before"])

    maps = dealt.groupBy("seg").applyInPandas(told, "seg long, out array<long>, count array<long>")
    starts = settled(maps.orderBy("seg").coalesce(1).mapInArrow(followed, "seg long, entry long, before long"), "starts")  # a row for each segment

    def numbered(key: tuple, table: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(table) or not len(start):
            return pd.DataFrame({"rank": [], name: []})
        then, n, first = ends(table)
        begins = np.zeros(n, np.int64)
        i = int(start["entry"].iloc[0])
        while i < n:
            begins[i] = 1
            i = int(then[i])
        return pd.DataFrame({"rank": np.arange(first, first + n), name: int(start["before"].iloc[0]) - 1 + np.cumsum(begins)})

    places = dealt.groupBy("seg").cogroup(starts.groupBy("seg")).applyInPandas(numbered, f"rank long, {name} long")
    return known.join(places, "rank").select(*rows.columns, "rank", name)
