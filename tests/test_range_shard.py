"""Ordered shards without a task that sees every row."""

import re

import pytest
from pyspark.sql import functions as F

from boardlake.operators import merge


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_range_shard_ranks_in_ranges(spark, n):
    rows = spark.range(n).select(F.when(F.col("id") % 1000 != 7, F.col("id") * 37 % 5003).alias("k"))
    got = merge.range_shard(rows, "k", size=50)
    keys = sorted([r["k"] for r in rows.collect()], key=lambda k: (k is not None, k or 0))
    want = sorted(((k, i // 50) for i, k in enumerate(keys)), key=str)
    assert sorted(((r["k"], r["shard"]) for r in got.collect()), key=str) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(_range", plan) or not n
