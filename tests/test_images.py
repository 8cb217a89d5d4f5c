"""Near shapes against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from boardlake.operators import facets, images


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def codes(n, seed=1):
    rng, out = random.Random(seed), []
    for _ in range(n):
        c = rng.getrandbits(64)
        out.append(c)
        for k in (1, 3, 6, 7, 12):
            out.append(c ^ sum(1 << i for i in rng.sample(range(64), k)))
    return [signed(c) for c in out]


@pytest.mark.parametrize(("distance", "pieces"), [(6, 4), (6, 7), (0, 4), (3, 2), (12, 5)])
def test_all_pairs_within_the_distance(spark, distance, pieces):
    a, b = codes(30), codes(10, 2) + codes(30)[:40]
    frame = lambda x: spark.createDataFrame([(c,) for c in x] + [(None,)] + [(x[0],)] * 3, "shape long")
    got = [tuple(r) for r in images.near_pairs(frame(a), frame(b), distance, pieces).collect()]
    want = {(x, y, bin((x ^ y) & (2**64 - 1)).count("1")) for x in a for y in b}
    assert sorted(got) == sorted(w for w in want if w[2] <= distance) and len(got) >= 40


def test_pieces_are_not_broadcast(spark):
    shapes = spark.range(500).select((F.col("id") * 7919).alias("shape"))
    pairs = images.near_pairs(shapes, shapes, 2)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    values = [i * 7919 for i in range(500)]
    assert pairs.count() == sum(bin(x ^ y).count("1") <= 2 for x in values for y in values)


def test_shape_of_pixels(spark):
    rng = random.Random(3)
    pixels = [[rng.randrange(256) for _ in range(64)] for _ in range(5)]
    got = [r["s"] for r in spark.createDataFrame([(p,) for p in [*pixels, [7] * 64, pixels[0][:63], None, [None, *pixels[0][1:]]]], "p array<int>").select(images.shape(F.col("p")).alias("s")).collect()]
    assert got == [signed(sum(1 << i for i, x in enumerate(p) if x > sum(p) / 64)) for p in pixels] + [0, None, None, None]


def test_placeholders_and_rows_of_logos(spark):
    base = codes(1)[0]
    known = spark.createDataFrame([(base, "parked"), (base ^ 1, "also parked")], "shape long, label string")
    rows = spark.createDataFrame([("a", base ^ 3), ("b", base ^ (2**20 - 1)), ("c", None), ("d", base)], "id string, shape long")
    assert {r["id"]: r["placeholder"] for r in images.placeholders(rows, known).collect()} == {"a": "also parked", "b": None, "c": None, "d": "parked"}
    companies = spark.createDataFrame([("a.com", "A", "u1", base), ("b.com", "B", "u2", base ^ 7), ("c.com", "C", "u3", None), ("d.com", "D", "u4", ~base)], "domain string, company_name string, logo_url string, logo_shape long")
    jobs = spark.createDataFrame([(d, None) for d in ["b.com"] * 3 + ["a.com"] * 2 + ["c.com", "d.com"]], "company_domain string, closed_at timestamp")
    assert [r["domain"] for r in facets.logo_row(jobs, companies, []).collect()] == ["b.com", "c.com", "d.com"]
    assert [r["domain"] for r in facets.logo_row(jobs, companies, ["a.com"]).collect()] == ["a.com", "c.com", "d.com"]
    assert len(facets.logo_row(jobs, companies.drop("logo_shape"), []).collect()) == 4
