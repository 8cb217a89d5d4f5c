"""Every registered query of the listing engine against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from boardlake.plans.catalogue import ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "embeddings"]
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if type(v) is datetime.date else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df, rel = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert [KINDS[t] for _, t in sorted(df.dtypes)] == [str(t) for _, t in sorted(zip(rel.columns, rel.types, strict=True))]
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in cols) for r in rel.fetchall()), key=str)
    assert ours == theirs


def test_queries_without_sql(spark):
    rows = QUERIES["q42_hash_shard"](spark, SF).collect()
    import zlib

    names = {r["c_custkey"]: r["c_name"] for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    assert all(r["shard"] == zlib.crc32(names[r["c_custkey"]].encode()) % 16 for r in rows)
    assert set(QUERIES) - set(ORACLE_SQL) == {"q42_hash_shard"}
    told = QUERIES["q91_learned_estimates"](spark, SF).collect()
    assert len(told) == spark.read.parquet(f"{SF}/orders.parquet").count() and all(r["level"] is None or r["low"] <= r["high"] for r in told)
    b = QUERIES["q92_backtest"](spark, SF).first()
    assert b["rows"] == len(told) and 0 <= b["coverage"] <= 1
    assert QUERIES["q94_stable_content_hash"](spark, SF).collect() == QUERIES["q94_stable_content_hash"](spark, SF).collect()


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    """The age and priority filters of a page are pushed to the Parquet reader, which reads few columns."""
    plan = QUERIES["q02_listing_filters_in"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "o_orderpriority" in plan.split("PushedFilters", 1)[1] and "o_totalprice" not in plan
