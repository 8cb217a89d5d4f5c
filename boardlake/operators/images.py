"""Near copies of images by 64-bit shapes.

A shape is an average hash: of 8 x 8 grey pixels, a bit for each that is above their mean. Shapes that differ in few bits meet in an equi-join:
cut into `pieces` pieces, two shapes within a distance differ by at most distance // pieces bits in one piece, so one side asks for
its own pieces and the other for its pieces and all that differ from them by so little. What meets is counted exactly. Both sides are
shuffled: statistics do not know how many rows a shape becomes, and would send them all through the driver.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import image_distance

# Fixed value: bits by which versions of one image differ at most.
SHAPE_DISTANCE = 6
PIECES = 4


def shape(pixels: Column) -> Column:
    """The shape of 64 grey values, row by row: the first is the lowest bit. Null unless there are 64, all known."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / 64
    bits = F.transform(pixels, lambda x, i: F.when(x > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    whole = (F.size(pixels) == 64) & F.forall(pixels, lambda x: x.isNotNull())
    return F.when(whole, F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


def _pieces(code: Column, pieces: int) -> list[tuple[int, Column]]:
    """(bits, value) of each piece, from the lowest bits."""
    cuts = [64 * k // pieces for k in range(pieces + 1)]
    return [(b - a, F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def near_pairs(left: DataFrame, right: DataFrame, distance: int = SHAPE_DISTANCE, pieces: int = PIECES) -> DataFrame:
    """(a, b, distance): all pairs of different or equal shapes a of left and b of right (a column shape each) within the distance, once.

    Shapes are made distinct first, so copies cost nothing. Null shapes are near nothing.
    """
    own, other = (df.where("shape is not null").select("shape").distinct() for df in (left, right))
    near = distance // pieces
    asked = []
    for k, (bits, value) in enumerate(_pieces(F.col("shape"), pieces)):
        flips = [sum(1 << i for i in some) for n in range(near + 1) for some in combinations(range(bits), n)]
        asked += [F.struct(F.lit(k).alias("k"), value.bitwiseXOR(F.lit(f)).alias("v")) for f in flips]
    told = [F.struct(F.lit(k).alias("k"), value.alias("v")) for k, (_, value) in enumerate(_pieces(F.col("shape"), pieces))]
    a = own.select(F.col("shape").alias("a"), F.explode(F.array(*told)).alias("x")).select("a", "x.k", "x.v")
    b = other.select(F.col("shape").alias("b"), F.explode(F.array(*asked)).alias("x")).select("b", "x.k", "x.v")
    met = a.join(b.hint("merge"), ["k", "v"]).withColumn("distance", image_distance(F.col("a"), F.col("b"))).where(F.col("distance") <= distance)
    # a pair that meets at several pieces counts at the first of them
    parts = list(zip(_pieces(F.col("a"), pieces), _pieces(F.col("b"), pieces), strict=True))
    first = F.lit(None)
    for k in range(pieces - 1, -1, -1):
        first = F.when(F.bit_count(parts[k][0][1].bitwiseXOR(parts[k][1][1])) <= near, k).otherwise(first)
    return met.where(F.col("k") == first).select("a", "b", "distance")


def placeholders(images: DataFrame, known: DataFrame, distance: int = SHAPE_DISTANCE) -> DataFrame:
    """images (with a shape) and `placeholder`: what the nearest known shape (shape, label) within the distance shows, of equally near ones the first label."""
    pairs = near_pairs(images, known, distance).join(known.select(F.col("shape").alias("b"), "label"), "b")
    best = pairs.groupBy(F.col("a").alias("_a")).agg(F.min(F.struct("distance", "label")).alias("x"))
    return images.join(best, F.col("shape") == F.col("_a"), "left").select(*images.columns, F.col("x.label").alias("placeholder"))


def first_of_shapes(rows: DataFrame, order: list[Column], distance: int = SHAPE_DISTANCE) -> DataFrame:
    """rows without those whose shape is within the distance of a row's before it in the order; rows without a shape stay.

    The order should end in a key. Meant for a list that is shown, whose rows are few: they are numbered in one task.
    """
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    first = numbered.where("shape is not null").groupBy("shape").agg(F.min("_n").alias("m"))
    pairs = near_pairs(rows, rows, distance)
    before = pairs.join(first.select(F.col("shape").alias("b"), "m"), "b").groupBy(F.col("a").alias("_a")).agg(F.min("m").alias("_m"))
    return numbered.join(before, F.col("shape") == F.col("_a"), "left").where(F.col("_m").isNull() | (F.col("_n") <= F.col("_m"))).drop("_n", "_a", "_m")
