"""Exact order statistics of any number of values, without their rows ever meeting in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .versions import settled

#: Bins of a histogram that the driver sees; ranges of values that are summed up apart.
BINS, CELLS = 4096, 100
#: Rows for each further range, and ranges at most.
CELL_ROWS, MOST_CELLS = 500_000, 2000
#: Rows whose values one task may hold, so that a median of no more is one pass.
FEW = 200_000


def middle(rows: DataFrame, value: Column, weight: Column | None = None) -> float | None:
    """The median, between the two middle values where there are two; None without values. A row counts weight times.

    A median of FEW rows is one pass more than their count. Of others, each pass counts the values of a range in BINS bins and goes on in that with the middle, so three or four passes find
    it among any number, and no task or driver holds more than the bins.
    """
    v = rows.select(value.cast("double").alias("v"), (F.lit(1) if weight is None else weight).cast("long").alias("w")).where("v is not null and not isnan(v) and w > 0")
    total, low, high = v.agg(F.sum("w"), F.min("v"), F.max("v")).first()
    if not total:
        return None
    if total <= FEW:
        return v.agg(F.expr("percentile(v, 0.5D, w)")).first()[0]
    first, second, before = (total - 1) // 2, total // 2, 0
    while low < high:
        step = max((high - low) / BINS, 5e-324)
        bins = v.where(F.col("v").between(low, high)).groupBy(F.least(F.floor((F.col("v") - low) / step), F.lit(BINS - 1)).alias("bin")).agg(F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        found = bins.orderBy("bin").collect()
        for here, after in zip(found, [*found[1:], None], strict=True):
            if before + here["n"] > first:
                if before + here["n"] <= second:
                    return (here["high"] + after["low"]) / 2
                low, high = here["low"], here["high"]
                break
            before += here["n"]
    return low


def ranged(rows: DataFrame, value: str, cells: int | None = None) -> DataFrame:
    """rows with _cell, the range of their value: ranges are cut at a sketch's quantiles, and greater values are never in a lower range.

    Ranges follow the rows, one for CELL_ROWS of them, at least CELLS and as many as the sketch tells apart. A row without a value has none.
    """
    cells = cells or max(CELLS, min(MOST_CELLS, rows.where(F.col(value).isNotNull()).count() // CELL_ROWS))
    cuts = sorted({x for x in rows.approxQuantile(value, [i / cells for i in range(1, cells)], 0.5 / cells) if abs(x) != float("inf")})
    if not cuts:
        return rows.withColumn("_cell", F.when(F.col(value).isNotNull(), 0))
    sieve = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_v", outputCol="_at", handleInvalid="keep")
    return sieve.transform(rows.withColumn("_v", F.col(value).cast("double") + 0.0)).withColumn("_cell", F.when(F.col(value).isNotNull(), F.col("_at").cast("int"))).drop("_v", "_at")


def cumulative(rows: DataFrame, keys: list[str], value: str, cells: int | None = None, weight: str | None = None) -> DataFrame:
    """(keys, value, c, before, n) for each different value of a key: its rows, the key's rows with smaller values, all of the key's.

    Equal values are counted before they are shuffled, and a key's values are summed up in ranges, so a hot key is many tasks' work. A row counts weight times.
    """
    known = ranged(rows.where(F.col(value).isNotNull()), value, cells)
    counts = known.groupBy(*keys, "_cell", value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("c"))
    per = counts.groupBy(*keys, "_cell").agg(F.sum("c").alias("_m"))
    sofar = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*keys, "_cell", F.coalesce(F.sum("_m").over(sofar), F.lit(0)).alias("_off"), F.sum("_m").over(Window.partitionBy(*keys)).alias("n"))
    within = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("_sum", F.coalesce(F.sum("c").over(within), F.lit(0)))
    return local.join(offsets, [*keys, "_cell"]).select(*keys, value, "c", (F.col("_off") + F.col("_sum")).alias("before"), "n")


def picked(rows: DataFrame, keys: list[str], value: str, positions: dict[str, Callable[[Column], Column]], least: int = 1, folds: int = 0) -> DataFrame:
    """(keys, n, least, most, and a value for each name of positions): the values at places of a key's order that follow from its n rows.

    rows come from `ranged`. The rows of each range are counted, and only those of ranges in which a place falls are shuffled and sorted. Keys
    with fewer rows than least are left out. folds: rows have a _fold below that, and (keys, _fold, n, names) tells of a key's rows in all other
    folds; rows are counted once for all folds, never copied.
    """
    known = rows.where(F.col(value).isNotNull())
    own = [F.count_if(F.col("_fold") == f) for f in range(folds)] or [F.count(F.lit(1))]
    ends = [] if folds else [F.min(value).alias("_least"), F.max(value).alias("_most")]
    bounds = [] if folds else [F.min("_least").over(Window.partitionBy(*keys)).alias("least"), F.max("_most").over(Window.partitionBy(*keys)).alias("most")]
    others = F.transform("_own", lambda x: F.aggregate("_own", F.lit(0).cast("long"), lambda a, y: a + y) - x) if folds else F.col("_own")
    per = known.groupBy(*keys, "_cell").agg(F.array(*own).alias("_own"), *ends).select("*", F.posexplode(others).alias("_fold", "_m")).where("_m > 0")
    each = [*keys, "_fold"]
    sofar = Window.partitionBy(*each).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*each, "_cell", "_m", *bounds, F.coalesce(F.sum("_m").over(sofar), F.lit(0)).alias("_off"), F.sum("_m").over(Window.partitionBy(*each)).alias("n")).where(F.col("n") >= least)
    here = lambda p: F.when((F.col("_off") <= p) & (p < F.col("_off") + F.col("_m")), p - F.col("_off"))
    fell = offsets.withColumn("_places", F.array(*[here(p(F.col("n"))) for p in positions.values()])).where(F.exists("_places", lambda p: p.isNotNull()))
    asked = fell.groupBy(*keys, "_cell").agg(F.collect_list(F.struct("_fold", "n", "_places", *(["least", "most"] if bounds else []))).alias("_asked"))
    asked = settled(asked, "places")
    met = known.join(asked.select(*keys, "_cell"), [*keys, "_cell"], "left_semi")
    values = met.groupBy(*keys, "_cell", value).agg(F.array(*own).alias("_own")).join(asked, [*keys, "_cell"]).select(*keys, "_cell", value, others.alias("_c"), F.explode("_asked").alias("_a"))
    values = values.select(*keys, "_cell", value, "_a.*", F.get("_c", F.col("_a._fold")).alias("c")).where("c > 0")
    within = Window.partitionBy(*each, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.coalesce(F.sum("c").over(within), F.lit(0)))
    found = values.groupBy(*each).agg(F.max("n").alias("n"), *[F.max(c).alias(c) for c in ("least", "most") if bounds], *[at(F.get("_places", F.lit(i)), value).alias(x) for i, x in enumerate(positions)])
    return found if folds else found.drop("_fold")


def at(position: Column, value: str) -> Column:
    """Aggregate over rows of `cumulative`: the key's value at a position from 0."""
    return F.max(F.when((F.col("before") <= position) & (position < F.col("before") + F.col("c")), F.col(value)))
