"""The driver's tables under the names of listings. Columns are renamed or derived row by row; the SQL twins are for the oracle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: The clocks of the queries: just past the last event, and near the last order.
AS_EV, AS_OR = datetime(2024, 1, 31), datetime(2001, 8, 2)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings of their customers; a tenth of the columns carry nulls by the order key.

    Nation and region are 25 and 5 rows by definition of the schema, so they are broadcast.
    """
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    paid = key % 5 != 0
    return both.select(
        F.substring(F.md5(key.cast("string").cast("binary")), 1, 16).alias("id"), key.alias("order_key"), F.col("c_custkey").cast("string").alias("company_domain"), F.col("c_name").alias("company_name"),
        F.col("o_orderpriority").alias("ats"), F.col("c_mktsegment").alias("category"), F.when(key % 3 != 0, F.col("o_orderpriority")).alias("seniority"), F.when(key % 2 == 0, F.col("o_orderstatus")).alias("workplace_type"),
        F.col("n_name").alias("location"), F.array("r_name").alias("country"), F.array("n_name").alias("city"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("department"),
        F.when(key % 11 != 0, F.col("o_orderdate")).alias("posted_at"), F.col("o_orderdate").alias("first_seen"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval((key % 90).cast("int"))).alias("closed_at"),
        F.when(key % 7 == 0, "best_effort").otherwise("verified").alias("confidence"), F.when(paid, F.col("o_totalprice")).alias("salary_min_ils"), F.when(paid, F.col("o_totalprice") * 1.25).alias("salary_max_ils"),
        F.when(paid, F.when(key % 2 == 0, "disclosed").otherwise("table")).alias("salary_source"), F.col("o_totalprice").alias("pay"), F.col("o_orderstatus").alias("status"),
    )


LISTINGS = """l AS (
    SELECT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16) AS id, o_orderkey AS order_key, CAST(c_custkey AS VARCHAR) AS company_domain, c_name AS company_name,
        o_orderpriority AS ats, c_mktsegment AS category, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS seniority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS workplace_type,
        n_name AS location, r_name AS country, n_name AS city, c_name AS title, c_mktsegment AS department,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS posted_at, o_orderdate AS first_seen,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 90 AS INTEGER)) END AS closed_at,
        CASE WHEN o_orderkey % 7 = 0 THEN 'best_effort' ELSE 'verified' END AS confidence,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS salary_min_ils, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice * 1.25 END AS salary_max_ils,
        CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'disclosed' ELSE 'table' END END AS salary_source, o_totalprice AS pay, o_orderstatus AS status
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
#: Open, verified and fresh at AS_OR.
OPEN = "closed_at IS NULL AND confidence = 'verified' AND (posted_at IS NULL OR posted_at >= TIMESTAMP '2000-08-02 00:00:00')"


def skill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_key, skill, line): a part's brand as a skill of the order. The sides are equi-joined; statistics decide how."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("order_key"), F.col("p_brand").alias("skill"), F.col("l_linenumber").alias("line"))


SKILLS = "k AS (SELECT l_orderkey AS order_key, p_brand AS skill, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listings with a title (their first 60 characters) and a description."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("company_domain"), F.col("lang").alias("location"), F.lit(None).cast("string").alias("department"), F.col("text").alias("description"))


DOCUMENTS = "d AS (SELECT doc_id AS id, substr(text, 1, 60) AS title, source AS company_domain, lang AS location, text AS description FROM documents)"
