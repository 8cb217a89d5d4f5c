"""Registered queries of the listing engine and their SQL.

Every query reads the driver's tables whole, under the names of listings (see views), and calls the
operators of this library. Names follow the survey's catalogue.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, status, taxonomy, text
from ..operators import alerts, evaluate, explore, facets, listing, merge, postings, predicates, publish, search, stats
from ..sources.tables import table
from ..streaming.fragments import latest_by_key, parquet_stream
from .views import AS_EV, AS_OR, DOCUMENTS, LISTINGS, OPEN, SKILLS, documents, listings, skill_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
T_OR, T_EV = "TIMESTAMP '2001-08-02 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"
AGE = f"(epoch_us({T_OR}) - epoch_us(posted_at)) / 86400000000.0"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


PAGE = ["id", "company_domain", "company_name", "ats", "category", "posted_at"]


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("domain"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("ats"))


@query("q01_listing_page_newest", f"WITH {LISTINGS} SELECT id, company_domain, company_name, ats, category, posted_at FROM l WHERE {OPEN} ORDER BY posted_at DESC NULLS LAST, id DESC LIMIT 100 OFFSET 50")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest open listings, second half page."""
    rows = listings(spark, sf_dir).drop("company_name").withColumn("description", F.lit(None).cast("string"))
    return listing.page(rows, companies(spark, sf_dir), {"offset": "50"}, AS_OR).select(*PAGE)


@query("q02_listing_filters_in", f"WITH {LISTINGS} SELECT id, ats, category, company_domain FROM l WHERE closed_at IS NULL AND confidence = 'verified' AND ats IN ('1-URGENT', '2-HIGH') AND category IN ('BUILDING', 'MACHINERY') AND (posted_at IS NULL OR posted_at >= TIMESTAMP '2000-08-02 00:00:00')")
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sets of values at once."""
    return listings(spark, sf_dir).where(predicates.compile_filters({"ats": "1-URGENT,2-HIGH", "department": "BUILDING, MACHINERY"}, AS_OR)).select("id", "ats", "category", "company_domain")


@query("q03_listing_join_company_name", f"WITH {LISTINGS} SELECT id, coalesce(company_name, company_domain) AS company FROM l WHERE {OPEN}")
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings with the company's name, or else its domain."""
    rows = stats.open_rows(listings(spark, sf_dir).drop("company_name"), AS_OR)
    return listing.with_company(rows, companies(spark, sf_dir)).select("id", F.coalesce("company_name", "company_domain").alias("company"))


@query("q04_listing_sort_text", "SELECT c_custkey AS id, c_name AS title FROM customer ORDER BY lower(trim(c_name)) ASC NULLS LAST, c_custkey DESC LIMIT 500")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by trimmed, case-folded text."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(None).cast("timestamp").alias("posted_at"))
    return rows.orderBy(*listing.order({"sort": "title", "order": "asc"}, AS_OR)).limit(500).select("id", "title")


@query("q05_age_window_filter", f"WITH {LISTINGS} SELECT id, posted_at FROM l WHERE {OPEN} AND posted_at IS NOT NULL AND {AGE} >= 30 AND {AGE} <= 200")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings between 30 and 200 days old."""
    return listings(spark, sf_dir).where(predicates.compile_filters({"min_age_days": "30", "max_age_days": "200"}, AS_OR)).select("id", "posted_at")


@query("q06_pay_overlap_filter", f"WITH {LISTINGS} SELECT id, salary_min_ils, salary_max_ils FROM l WHERE {OPEN} AND (salary_max_ils >= 100000 OR salary_max_ils IS NULL) AND (salary_min_ils <= 150000 OR salary_min_ils IS NULL)")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay that overlaps an interval; unknown pay stays."""
    return listings(spark, sf_dir).where(predicates.compile_filters({"salary_min": "100000", "salary_max": "150000"}, AS_OR)).select("id", "salary_min_ils", "salary_max_ils")


@query("q07_ids_filter", f"WITH {LISTINGS} SELECT id, order_key FROM l WHERE id IN ('c4ca4238a0b92382', 'c81e728d9d4c2f63', 'eccbc87e4b5ce2fe', 'a87ff679a2f3e71d', 'e4da3b7fbbce2345')")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by id; what is no id is dropped from the list."""
    p = {"ids": "c4ca4238a0b92382,c81e728d9d4c2f63,eccbc87e4b5ce2fe,a87ff679a2f3e71d,e4da3b7fbbce2345,nope", "include_closed": "1", "confidence": "all", "include_outdated": "1"}
    return listings(spark, sf_dir).where(predicates.compile_filters(p, AS_OR)).select("id", "order_key")


@query("q10_facet_category", f"WITH {LISTINGS} SELECT category AS value, count(*) AS n FROM l WHERE {OPEN} AND ats IN ('1-URGENT') AND trim(category) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 60")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories under the filters but their own."""
    rows = listings(spark, sf_dir).where(predicates.compile_filters({"ats": "1-URGENT", "department": "BUILDING"}, AS_OR, drop=["department"]))
    return facets.counted(rows, F.col("category"))


@query("q11_facet_company", f"WITH {LISTINGS} SELECT company_domain AS value, count(*) AS n FROM l WHERE {OPEN} GROUP BY 1 ORDER BY n DESC, value LIMIT 500")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest companies."""
    return facets.counted(listings(spark, sf_dir).where(predicates.compile_filters({"company": "1,2"}, AS_OR, drop=["company"])), F.col("company_domain"), facets.COMPANIES)


@query("q12_facet_country_city_tree", f"""WITH {LISTINGS}, c AS (SELECT country, count(*) AS country_n FROM l WHERE {OPEN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40),
p AS (SELECT country, city, count(*) AS n FROM l WHERE {OPEN} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, city) AS rn FROM p)
SELECT r.country, r.city, r.n, c.country_n FROM r JOIN c ON r.country = c.country WHERE rn <= 3""")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three leading cities of each leading country."""
    return facets.place_tree(stats.open_rows(listings(spark, sf_dir), AS_OR), cities=3)


@query("q13_facet_multivalue", "SELECT lower(trim(v)) AS value, count(*) AS n FROM (SELECT unnest(string_split(replace(p_type, ' ', ','), ',')) AS v FROM part) WHERE trim(v) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 60")
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the single values of lists."""
    values = F.transform(F.split(F.replace("p_type", F.lit(" "), F.lit(",")), ","), lambda v: F.lower(F.trim(v)))
    return facets.counted(table(spark, sf_dir, "part"), F.explode(values))


@query("q14_pay_bounds_median", f"WITH {LISTINGS} SELECT min(salary_min_ils) AS low, max(salary_max_ils) AS high, count(*) FILTER (WHERE salary_min_ils IS NOT NULL) AS known, median((salary_min_ils + salary_max_ils) / 2) AS median FROM l WHERE {OPEN}")
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and exact median of pay."""
    return facets.pay_bounds(stats.open_rows(listings(spark, sf_dir), AS_OR))


SCOPED = f"""SELECT count(*) AS total, count(DISTINCT company_domain) AS companies, median({AGE}) AS median_age, max({AGE}) AS oldest,
count(*) FILTER (WHERE first_seen >= {T_OR} - INTERVAL 24 HOUR) AS added_24h, count(*) FILTER (WHERE first_seen >= {T_OR} - INTERVAL 7 DAY) AS added_7d,
count(*) FILTER (WHERE closed_at >= {T_OR} - INTERVAL 24 HOUR) AS closed_24h, count(*) FILTER (WHERE closed_at >= {T_OR} - INTERVAL 7 DAY) AS closed_7d"""


@query("q15_scoped_stats", f"WITH {LISTINGS} {SCOPED} FROM l WHERE confidence = 'verified' AND (posted_at IS NULL OR posted_at >= TIMESTAMP '2000-08-02 00:00:00')")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of a scope in one pass."""
    return stats.scoped(listings(spark, sf_dir).where(predicates.compile_filters({"include_closed": "1"}, AS_OR)), AS_OR)


@query("q16_throughput_24h_7d", f"""SELECT count(*) FILTER (WHERE ts >= {T_EV} - INTERVAL 24 HOUR) AS added_24h, count(*) FILTER (WHERE ts >= {T_EV} - INTERVAL 7 DAY) AS added_7d,
count(*) FILTER (WHERE c >= {T_EV} - INTERVAL 24 HOUR) AS closed_24h, count(*) FILTER (WHERE c >= {T_EV} - INTERVAL 7 DAY) AS closed_7d FROM (SELECT ts, CASE WHEN event_type = 'error' OR value > 50 THEN ts END AS c FROM events)""")
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added and closed in a day and in a week."""
    e = table(spark, sf_dir, "events").withColumn("c", F.when((F.col("event_type") == "error") | (F.col("value") > 50), F.col("ts")))
    return stats.throughput(e, AS_EV, "ts", "c")


@query("q17_age_avg_median_oldest", f"WITH {LISTINGS} SELECT avg({AGE}) AS mean, median({AGE}) AS median, max({AGE}) AS oldest FROM l WHERE {OPEN} AND posted_at IS NOT NULL")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and greatest age."""
    return stats.ages(stats.open_rows(listings(spark, sf_dir), AS_OR).where("posted_at is not null"), AS_OR)


@query("q18_cross_tab_category_level", f"WITH {LISTINGS} SELECT category, coalesce(seniority, 'unstated') AS seniority, count(*) AS n FROM l WHERE {OPEN} AND category IS NOT NULL GROUP BY 1, 2")
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by level, the unstated level as its own."""
    return stats.cross_tab(stats.open_rows(listings(spark, sf_dir), AS_OR))


@query("q19_category_rollup", f"WITH {LISTINGS} SELECT category, count(*) AS n FROM l WHERE {OPEN} AND category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories from the cross-tab, without another scan."""
    return stats.rolled_up(stats.cross_tab(stats.open_rows(listings(spark, sf_dir), AS_OR))).withColumn("n", F.col("n").cast("long"))


@query("q20_unstated_bucket", f"WITH {LISTINGS} SELECT coalesce(workplace_type, 'unstated') AS workplace_type, count(*) AS n FROM l WHERE {OPEN} GROUP BY 1")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workplaces, with those that say nothing."""
    return stats.with_unstated(stats.open_rows(listings(spark, sf_dir), AS_OR), "workplace_type")


@query("q21_skill_frequency", f"WITH {SKILLS} SELECT lower(trim(skill)) AS skill, count(*) AS n FROM k WHERE trim(skill) <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 30")
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent skills over all listings."""
    return stats.skill_frequency(skill_rows(spark, sf_dir), F.array("skill"))


@query("q22_movers_7d", f"SELECT user_id AS company_domain, count(*) AS n FROM events WHERE ts >= {T_EV} - INTERVAL 7 DAY GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the most new rows in a week."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("company_domain"), F.col("ts").alias("first_seen"), F.col("ts").alias("posted_at"), F.lit("verified").alias("confidence"))
    return stats.movers(e, AS_EV)


@query("q23_dormant_share", f"WITH {LISTINGS} SELECT count(*) FILTER (WHERE {AGE} > 60) AS dormant, count(posted_at) AS sample, round(count(*) FILTER (WHERE {AGE} > 60) / count(posted_at), 4) AS share FROM l WHERE {OPEN}")
def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings older than 60 days."""
    return stats.dormant(stats.open_rows(listings(spark, sf_dir), AS_OR), AS_OR)


@query("q24_daily_series_zero_filled", """WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-18', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE value > 50 GROUP BY 1)
SELECT d.day, coalesce(a.n, 0) AS added, coalesce(b.n, 0) AS closed FROM d LEFT JOIN a ON a.day = d.day LEFT JOIN b ON b.day = d.day""")
def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen days, empty ones with 0."""
    e = table(spark, sf_dir, "events").withColumn("c", F.when(F.col("value") > 50, F.col("ts")))
    return stats.daily_series(e, AS_EV, {"added": "ts", "closed": "c"})


@query("q25_open_history", f"""WITH {LISTINGS}, d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-07-20', TIMESTAMP '2001-08-02', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, count(l.id) AS open FROM d LEFT JOIN l ON l.confidence = 'verified' AND l.first_seen <= d.day AND (l.closed_at IS NULL OR l.closed_at > d.day) GROUP BY day""")
def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings on each of fourteen days, from first and last sights."""
    return stats.open_history(listings(spark, sf_dir).where("confidence = 'verified'"), AS_OR)


@query("q26_shared_timestamp_anomaly", f"WITH {LISTINGS} SELECT posted_at, count(*) AS n, count(DISTINCT company_domain) AS companies FROM l WHERE posted_at IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT company_domain) >= 2")
def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that several companies share; orders are dated at midnight, which therefore counts."""
    return stats.shared_timestamps(listings(spark, sf_dir), keep_midnight=True)


@query("q26b_shared_timestamp_not_midnight", "SELECT date_trunc('hour', ts) AS posted_at, count(*) AS n, count(DISTINCT user_id) AS companies FROM events WHERE strftime(date_trunc('hour', ts), '%H:%M:%S') <> '00:00:00' GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT user_id) >= 2")
def q26b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that several users share, without midnight, which says no more than a day."""
    return stats.shared_timestamps(table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("posted_at"), F.col("user_id").alias("company_domain")))


@query("q27_tech_share_having", f"WITH {LISTINGS} SELECT company_domain, count(*) FILTER (WHERE seniority IS NOT NULL) AS decided, count(*) FILTER (WHERE seniority IN ('1-URGENT', '2-HIGH')) AS software, count(*) FILTER (WHERE seniority IN ('1-URGENT', '2-HIGH')) / count(*) FILTER (WHERE seniority IS NOT NULL) AS share FROM l WHERE closed_at IS NULL GROUP BY 1 HAVING decided >= 3 AND software >= 2")
def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of companies with enough decided rows."""
    rows = listings(spark, sf_dir).where("closed_at is null")
    return stats.tech_share(rows, F.col("seniority").isNotNull(), F.coalesce(F.col("seniority").isin("1-URGENT", "2-HIGH"), F.lit(False)))


def _mart(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = listings(spark, sf_dir).withColumn("days_open", dates.days_open(F.col("first_seen"), F.col("closed_at"), F.lit(AS_OR))).withColumn("country", F.element_at("country", 1))
    return {"jobs": rows, "job_skills": rows.join(skill_rows(spark, sf_dir).select("order_key", "skill").distinct(), "order_key")}


@query("q28_builder_share_of_status", f"WITH {LISTINGS}, o AS (SELECT * FROM l WHERE closed_at IS NULL) SELECT category AS value, round(100.0 * count(*) / (SELECT count(*) FROM o), 1) AS metric FROM o WHERE country IN ('EUROPE', 'ASIA') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A builder question: shares of all open listings under a filter."""
    return explore.build({"status": "open", "group": "category", "metric": "share", "filters": [{"field": "country", "values": ["EUROPE", "ASIA"]}]}, _mart(spark, sf_dir))


@query("q29_builder_distinct_by_skill", f"WITH {LISTINGS}, {SKILLS}, x AS (SELECT DISTINCT l.id, l.category FROM l JOIN k ON l.order_key = k.order_key WHERE k.skill IN ('Brand#11', 'Brand#12', 'Brand#13')) SELECT category AS value, count(*) AS n FROM x GROUP BY 1")
def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with any of some skills, each counted once."""
    rows = _mart(spark, sf_dir)["job_skills"].where(F.col("skill").isin("Brand#11", "Brand#12", "Brand#13"))
    return explore.distinct_listings(rows, ["id", "category"], F.col("category"))


@query("q29b_builder_by_skill", f"WITH {LISTINGS}, {SKILLS}, s AS (SELECT DISTINCT order_key, skill FROM k) SELECT skill AS value, round(avg(round((epoch_us(coalesce(closed_at, {T_OR})) - epoch_us(first_seen)) / 86400000000.0, 2)), 1) AS metric FROM l JOIN s USING (order_key) WHERE closed_at IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def q29b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean days open of closed listings by skill."""
    return explore.build({"status": "closed", "group": "skill", "metric": "avg_days_open"}, _mart(spark, sf_dir))


@query("q29c_builder_by_week", f"WITH {LISTINGS} SELECT strftime(first_seen, '%Y-W%W') AS value, count(*) AS metric FROM l GROUP BY 1 ORDER BY 1 LIMIT 5000")
def q29c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by the week of their first sight."""
    return explore.build({"status": "all", "group": "week", "metric": "count", "limit": 99999}, _mart(spark, sf_dir))


@query("q29d_disclosed_share_having", f"WITH {LISTINGS} SELECT ats, count(*) AS n, count(*) FILTER (WHERE salary_source = 'disclosed') AS hits, count(*) FILTER (WHERE salary_source = 'disclosed') / count(*) AS share FROM l WHERE closed_at IS NULL GROUP BY 1 HAVING count(*) > 300")
def q29d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of disclosed pay by board kind, for kinds with more than 300 rows."""
    rows = listings(spark, sf_dir).where("closed_at is null")
    return explore.having_share(rows, "ats", F.coalesce(F.col("salary_source") == "disclosed", F.lit(False)), 300)


def _like(term: str, fields: tuple[str, ...] = ("title", "company_domain", "location", "description")) -> str:
    return "(" + " OR ".join(f"lower({f}) LIKE '%{term}%'" for f in fields) + ")"


FREE = {"include_closed": "1", "confidence": "all", "include_outdated": "1"}


@query("q30_search_all_terms", f"WITH {DOCUMENTS} SELECT id FROM d WHERE {_like('thing')} AND {_like('license')}")
def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all terms in any field."""
    return documents(spark, sf_dir).where(predicates.compile_filters(FREE | {"search": "thing License"}, AS_OR)).select("id")


@query("q31_search_any", f"WITH {DOCUMENTS} SELECT id FROM d WHERE {_like('src13')} OR {_like('license')}")
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any of the terms."""
    return documents(spark, sf_dir).where(predicates.compile_filters(FREE | {"search": "src13 license", "search_mode": "any"}, AS_OR)).select("id")


@query("q32_search_phrase", f"WITH {DOCUMENTS} SELECT id FROM d WHERE {_like('of the')}")
def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quoted phrase."""
    return documents(spark, sf_dir).where(predicates.compile_filters(FREE | {"search": '"of the"'}, AS_OR)).select("id")


def _weight(term: str) -> str:
    return f"CASE WHEN lower(title) LIKE '%{term}%' THEN 10 ELSE 0 END + CASE WHEN lower(company_domain) LIKE '%{term}%' THEN 7 ELSE 0 END + CASE WHEN lower(location) LIKE '%{term}%' THEN 6 ELSE 0 END + CASE WHEN lower(description) LIKE '%{term}%' THEN 2 ELSE 0 END"


@query("q33_relevance_ranking", f"""WITH {DOCUMENTS} SELECT id, {_weight('and')} + {_weight('the')} + CASE WHEN {_like('and the')} THEN 40 ELSE 0 END
+ CASE WHEN lower(title) LIKE '%and%' AND lower(title) LIKE '%the%' THEN 30 ELSE 0 END AS score FROM d ORDER BY score DESC, id DESC LIMIT 100""")
def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most relevant documents for two terms."""
    return documents(spark, sf_dir).select("id", search.relevance("and the").alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(100)


@query("q34_whole_word_tokens", f"WITH {DOCUMENTS} SELECT id FROM d WHERE list_contains(regexp_split_to_array(lower(description), '[^\\p{{L}}\\p{{N}}]+'), 'moron')")
def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a whole word, from the stored index."""
    return postings.phrase(scale.documents_index(spark, sf_dir), "moron", ["description"]).select(F.col("number").alias("id"))


@query("q34b_phrase_tokens", f"WITH {DOCUMENTS} SELECT id FROM d WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(description), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ', ' of the ')")
def q34b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two whole words next to each other, from the stored index."""
    return postings.phrase(scale.documents_index(spark, sf_dir), "of the", ["description"]).select(F.col("number").alias("id"))


@query("q35_company_contains_search", f"WITH {LISTINGS} SELECT company_domain AS domain, min(company_name) AS company_name, count(*) AS n FROM l WHERE closed_at IS NULL AND (contains(lower(company_domain), '00001') OR contains(lower(company_name), '00001')) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50")
def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by a piece of their name."""
    return facets.company_search(listings(spark, sf_dir).drop("company_name"), companies(spark, sf_dir), "00001").select("domain", "company_name", "n")


@query("q36_match_overlap_score", f"WITH {SKILLS}, s AS (SELECT order_key, list_distinct(list(skill)) AS skills FROM k GROUP BY 1) SELECT order_key, CAST(len(list_intersect(skills, ['Brand#11', 'Brand#22', 'Brand#33', 'Brand#44'])) AS INTEGER) AS score FROM s WHERE list_has_any(skills, ['Brand#11', 'Brand#22', 'Brand#33', 'Brand#44'])")
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of four wanted skills each listing has."""
    wanted = ["Brand#11", "Brand#22", "Brand#33", "Brand#44"]
    rows = skill_rows(spark, sf_dir).groupBy("order_key").agg(F.collect_set("skill").alias("skills"))
    return rows.where(F.arrays_overlap("skills", F.array(*map(F.lit, wanted)))).select("order_key", listing.match_score(wanted).alias("score"))


@query("q37_keyword_semicolon_and", f"WITH {DOCUMENTS} SELECT id FROM d WHERE {_like('tion', ('title', 'description'))} AND {_like('is the', ('title', 'description'))}")
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all keywords in title or text."""
    return documents(spark, sf_dir).where(predicates.compile_filters(FREE | {"keywords": "tion; is the"}, AS_OR)).select("id")


@query("q40_stable_id", "SELECT o_orderkey, substr(md5(CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority || '|' || CAST(o_orderkey AS VARCHAR)), 1, 16) AS id FROM orders")
def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable identifiers."""
    s = lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.job_id(s("o_custkey"), s("o_orderpriority"), s("o_orderkey")).alias("id"))


@query("q41_content_hash", "SELECT doc_id, substr(sha256(text), 1, 32) AS sha FROM documents")
def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.description_sha(F.col("text")).alias("sha"))


@query("q42_hash_shard")
def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies in shards by crc32."""
    return table(spark, sf_dir, "customer").select("c_custkey", merge.hash_shard(F.col("c_name"), 16).alias("shard"))


@query("q43_range_shard", "SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 50) AS BIGINT) AS shard FROM customer")
def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies in ordered shards of 50."""
    return merge.range_shard(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").withColumn("shard", F.col("shard").cast("long"))


@query("q44_week_month_keys", "SELECT o_orderkey, strftime(o_orderdate, '%Y-W%W') AS week, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week, month and day keys."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.week_key(d).alias("week"), dates.month_key(d).alias("month"), dates.day_key(d).alias("day"))


@query("q45_days_open", f"WITH {LISTINGS} SELECT id, round((epoch_us(coalesce(closed_at, {T_OR})) - epoch_us(first_seen)) / 86400000000.0, 2) AS days_open FROM l")
def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days open of every listing."""
    return listings(spark, sf_dir).select("id", dates.days_open(F.col("first_seen"), F.col("closed_at"), F.lit(AS_OR)).alias("days_open"))


def first_match_sql(column: str, rules: list[tuple[str, list[str]]]) -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, '{taxonomy.whole_words(n)}') THEN '{label}'" for label, n in rules)
    return f"CASE {cases} END"


PRIORITY_RULES = [("exec", ["urgent"]), ("senior", ["high"]), ("mid", ["medium"]), ("junior", ["low"])]


@query("q46_level_first_match", f"SELECT o_orderkey, {first_match_sql('o_orderpriority', PRIORITY_RULES)} AS level FROM orders")
def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by the first rule that matches."""
    return table(spark, sf_dir, "orders").select("o_orderkey", taxonomy.first_match(F.col("o_orderpriority"), PRIORITY_RULES).alias("level"))


TYPE_RULES = [("remote", ["polished", "burnished"]), ("hybrid", ["plated"]), ("onsite", ["steel", "tin"])]


@query("q47_type_first_match", f"SELECT p_partkey, {first_match_sql('p_type', TYPE_RULES)} AS workplace FROM part")
def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workplaces by the first rule that matches."""
    return table(spark, sf_dir, "part").select("p_partkey", taxonomy.first_match(F.col("p_type"), TYPE_RULES).alias("workplace"))


@query("q48_html_to_text", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<h[1-6]\b[^>]*>', E'\n## ', 'g'), '(?i)<li\b[^>]*>', E'\n- ', 'g'), '(?i)</?(p|br|li|ul|ol|h[1-6]|div|tr|table)\b[^>]*>', E'\n', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, md5(t) AS digest, length(t) AS chars FROM a""")
def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to text, before entities are decoded."""
    t = text.strip_markup(F.regexp_replace("html", r"(?is)<p\b[^>]*>\s*<(strong|b)\b", "<p><$1 "))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("chars"))


@query("q49_url_host_token", "WITH h AS (SELECT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, regexp_extract(url, '://[^/]+/([^/?#]+)', 1) AS site FROM pages), c AS (SELECT host, site, count(*) AS n FROM h WHERE host <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, site DESC) AS k, sum(n) OVER (PARTITION BY host) AS s FROM c) SELECT host AS token, site, CAST(s AS BIGINT) AS n FROM r WHERE k = 1")
def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with the first path segment that most of their urls have."""
    from ..sources.boards import tokens_in_urls

    return tokens_in_urls(table(spark, sf_dir, "pages"), r"://([^/?#:]+)(?:/([^/?#]+))?")


@query("q50_amounts_in_text", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS INTEGER) AS n FROM documents WHERE regexp_matches(text, '[0-9]')")
def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many figures each text has."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("n"))


@query("q51_status_policy", f"WITH {LISTINGS} SELECT id, CASE WHEN order_key % 13 = 0 THEN 404 WHEN order_key % 17 = 0 THEN 301 WHEN closed_at < {T_OR} - INTERVAL 30 DAY THEN 410 ELSE 200 END AS code FROM l")
def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each listing's page."""
    k = F.col("order_key")
    return listings(spark, sf_dir).select("id", status.page_status(k % 13 != 0, F.when(k % 17 == 0, F.lit("other")), F.col("closed_at"), F.lit(AS_OR)).alias("code"))


@query("q52_json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of JSON properties."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


LEVELS = [("segment-priority-nation", ["category", "ats", "location"]), ("segment-priority", ["category", "seniority"]), ("segment", ["category"])]


def _cell_sql(name: str, keys: list[str]) -> str:
    whole = " AND ".join(f"{k} IS NOT NULL AND {k} <> ''" for k in keys)
    return f"SELECT '{name}' AS level, {' || chr(124) || '.join(keys)} AS key, list_sort(list(pay)) AS pays FROM l WHERE {whole} GROUP BY {', '.join(keys)} HAVING count(*) >= 5"


CELLS = "c AS (" + " UNION ALL ".join(_cell_sql(*x) for x in LEVELS) + ")"


@query("q53_cells_backoff_levels", f"WITH {LISTINGS}, {CELLS} SELECT level, key, CAST(len(pays) AS BIGINT) AS n, pays[1] AS least, pays[len(pays)] AS most FROM c")
def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay cells of each level of a chain."""
    return evaluate.cells(listings(spark, sf_dir), LEVELS, "pay").select("level", "key", "n", "least", "most")


def _quantile_sql(q: int) -> str:
    j = f"greatest(least(CAST(floor({q} * (n + 1) / 100) AS BIGINT), n - 1), 1)"
    return f"(v[{j}] * (100 - ({q} * (n + 1) - {j} * 100)) + v[{j} + 1] * ({q} * (n + 1) - {j} * 100)) / 100.0"


@query("q54_exclusive_band", f"WITH {LISTINGS}, {CELLS}, x AS (SELECT level, key, pays AS v, len(pays) AS n FROM c) SELECT level, key, round({_quantile_sql(15)}, 4) AS low, round({_quantile_sql(85)}, 4) AS high FROM x")
def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15th and 85th percentiles of each cell, by the exclusive rule."""
    return evaluate.cells(listings(spark, sf_dir), LEVELS, "pay").select("level", "key", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def predict_sql(rows: str, widest: float, folds: int = 1) -> str:
    """CTEs from c (pays by fold, level and key; a fold's cells are of the other folds) to t: rows with level, low and high."""
    other = "l.fold <> f.f" if folds > 1 else "true"
    cell = " UNION ALL ".join(f"SELECT f.f, '{name}' AS level, {' || chr(124) || '.join(keys)} AS key, list_sort(list(pay)) AS v FROM {rows} l JOIN f ON {other} WHERE {' AND '.join(f"{k} <> ''" for k in keys)} GROUP BY f.f, {', '.join(keys)} HAVING count(*) >= 5" for name, keys in LEVELS)
    joins = " ".join(f"LEFT JOIN b b{i} ON b{i}.f = l.fold AND b{i}.level = '{name}' AND b{i}.key = {' || chr(124) || '.join(f'l.{k}' for k in keys)}" for i, (name, keys) in enumerate(LEVELS))
    pick = lambda c: "CASE " + " ".join(f"WHEN b{i}.low IS NOT NULL THEN b{i}.{c}" for i in range(len(LEVELS))) + " END"
    return f"""f AS (SELECT unnest(range({folds})) AS f), c AS ({cell}), x AS (SELECT f, level, key, v, len(v) AS n FROM c),
b AS (SELECT * FROM (SELECT f, level, key, {_quantile_sql(15)} AS low, {_quantile_sql(85)} AS high FROM x) WHERE low > 0 AND (high - low) / low <= {widest}),
t AS (SELECT l.*, {pick('level')} AS level, {pick('low')} AS low, {pick('high')} AS high FROM {rows} l {joins})"""


@query("q55_leave_one_out_error", f"""WITH {LISTINGS}, g AS (SELECT location, list_sort(list(pay)) AS v FROM l GROUP BY 1 HAVING count(*) >= 5), e AS (SELECT v, unnest(v) AS p FROM g),
o AS (SELECT p, CASE WHEN len(list_filter(v, lambda x: x <> p)) > 0 THEN list_filter(v, lambda x: x <> p) ELSE v END AS r FROM e),
s AS (SELECT p, abs((r[CAST(floor((len(r) - 1) / 2) AS BIGINT) + 1] + r[CAST(floor(len(r) / 2) AS BIGINT) + 1]) / 2 - p) / p AS err FROM o)
SELECT count(*) AS covered, round(median(err), 6) AS error, round(median(abs((SELECT median(p) FROM s) - p) / p), 6) AS flat_error FROM s""")
def q55(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each place's median with the row's own pay left out."""
    r = evaluate.leave_one_out(listings(spark, sf_dir), "location", "pay")
    return r.select("covered", F.round("error", 6).alias("error"), F.round("flat_error", 6).alias("flat_error"))


@query("q56_confusion_matrix", """WITH x AS (SELECT quality = 1 AS t, length(text) > 500 AS v FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT count(*) FILTER (WHERE t AND v) AS tp, count(*) FILTER (WHERE NOT t AND v) AS fp, count(*) FILTER (WHERE t AND NOT v) AS fn, count(*) FILTER (WHERE NOT t AND NOT v) AS tn,
count(*) FILTER (WHERE t AND v) / count(*) FILTER (WHERE v) AS precision, count(*) FILTER (WHERE t AND v) / count(*) FILTER (WHERE t) AS recall, 0.0::DOUBLE AS unknown_share FROM x""")
def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on length against the quality labels."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null")
    return evaluate.confusion(rows, F.col("quality") == 1, F.length("text") > 500, F.lit(False))


@query("q60_latest_wins", "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def q60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user."""
    return merge.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The latest events of each user before and after a day, as stored and incoming listings with all fields that have rules; every fifth user is new."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    row = lambda d: merge.latest(d.select(F.col("user_id").alias("id"), "ts", "event_id", F.col("event_type").alias("title"), F.col("props").alias("description"), F.col("ts").alias("posted_at")), "id", ["ts", "event_id"])
    k, cut = F.col("event_id"), F.lit(AS_EV - timedelta(days=15)).cast("timestamp_ntz")

    def full(rows: DataFrame) -> DataFrame:
        board = F.element_at(F.array(*map(F.lit, ["workday", "comeet", "lever", "ashby"])), (F.floor(k / 3) % 4 + 1).cast("int"))
        text = F.when(k % 5 != 0, F.concat(F.lit("$"), (k % 1000).cast("string"))).when(k % 10 == 0, "")
        source = F.when(k % 3 == 0, "disclosed").when(k % 3 == 1, "table").otherwise("estimated")
        return rows.withColumns({
            "department": F.concat(F.lit("team "), (k % 2).cast("string")), "ats": board, "company_domain": F.concat(F.lit("c"), (F.col("id") % 71).cast("string")), "skills": F.when(k % 7 != 0, F.array("title")).otherwise(F.array().cast("array<string>")), "salary_text": text,
            "salary_is_estimate": k % 3 != 0, "salary_source": F.when(text != "", source),
        })

    old = full(row(e.where((F.col("ts") < cut) & (F.col("user_id") % 5 != 0)))).withColumns({"first_seen": F.col("ts"), "last_seen": F.col("ts"), "closed_at": F.when(k % 3 == 0, F.col("ts")), "category": F.lit("known")})
    new = full(row(e.where(F.col("ts") >= cut))).withColumn("description", F.when(k % 2 == 0, F.col("description")).when(k % 4 == 1, ""))
    return old.drop("ts"), new.drop("ts")


def _half_sql(where: str) -> str:
    return f"""SELECT *, 'team ' || (event_id % 2) AS department, 'c' || (id % 71) AS company_domain, (['workday', 'comeet', 'lever', 'ashby'])[event_id // 3 % 4 + 1] AS ats, CASE WHEN event_id % 7 <> 0 THEN [title] ELSE CAST([] AS VARCHAR[]) END AS skills,
    CASE WHEN event_id % 5 <> 0 THEN '$' || (event_id % 1000) WHEN event_id % 10 = 0 THEN '' END AS salary_text, event_id % 3 <> 0 AS salary_is_estimate,
    CASE WHEN event_id % 5 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'disclosed' WHEN 1 THEN 'table' ELSE 'estimated' END END AS salary_source
    FROM (SELECT user_id AS id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS title, arg_max(props, ts) AS description FROM events WHERE user_id IS NOT NULL AND {'user_id % 5 <> 0 AND ' if where == '<' else ''}ts {where} TIMESTAMP '2024-01-16' GROUP BY 1)"""


def _pay_sql(column: str, gone: str) -> str:
    """The pay ladder, branch by branch."""
    return f"""CASE WHEN n.id IS NULL THEN a.{column} WHEN a.id IS NULL THEN n.{column} WHEN n.salary_text <> '' AND NOT n.salary_is_estimate THEN n.{column} WHEN n.salary_text <> '' AND n.description <> '' THEN n.{column}
    WHEN n.salary_source = 'estimated' AND a.salary_is_estimate THEN n.{column} WHEN a.salary_text IS NULL AND n.salary_text <> '' THEN n.{column}
    WHEN coalesce(n.salary_text, '') = '' AND n.description <> '' AND a.salary_is_estimate THEN {gone} ELSE a.{column} END AS {column}"""


@query("q61_upsert_merge", f"""WITH a AS ({_half_sql('<')}),
n AS (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN description WHEN event_id % 4 = 1 THEN '' END AS description) FROM ({_half_sql('>=')}))
SELECT coalesce(a.id, n.id) AS id, coalesce(n.event_id, a.event_id) AS event_id, coalesce(n.title, a.title) AS title, coalesce(n.department, a.department) AS department, coalesce(n.ats, a.ats) AS ats, coalesce(n.company_domain, a.company_domain) AS company_domain,
CASE WHEN n.id IS NOT NULL AND (a.id IS NULL OR n.description <> '') THEN n.description ELSE a.description END AS description,
array_to_string(CASE WHEN n.id IS NOT NULL AND (a.id IS NULL OR len(n.skills) > 0) THEN n.skills ELSE a.skills END, ',') AS skills,
CASE WHEN a.id IS NULL AND n.ats = 'comeet' AND n.company_domain IN (SELECT company_domain FROM a WHERE ats = 'comeet') THEN {T_EV} WHEN a.id IS NOT NULL AND n.ats IN ('workday', 'comeet') THEN a.ts ELSE coalesce(n.ts, a.ts) END AS posted_at,
{_pay_sql('salary_text', 'NULL')}, {_pay_sql('salary_is_estimate', 'false')}, {_pay_sql('salary_source', 'NULL')},
CASE WHEN a.id IS NOT NULL THEN a.ts ELSE {T_EV} END AS first_seen, CASE WHEN n.id IS NOT NULL THEN {T_EV} ELSE a.ts END AS last_seen,
CASE WHEN n.id IS NULL AND a.event_id % 3 = 0 THEN a.ts END AS closed_at, CASE WHEN a.id IS NOT NULL AND (n.id IS NULL OR n.title = a.title AND n.department = a.department) THEN 'known' END AS category
FROM a FULL JOIN n ON a.id = n.id""")
def q61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the events as stored rows, merged with the second by the rules of every field; companies are tracked that had a comeet listing."""
    old, new = _halves(spark, sf_dir)
    tracked = merge.tracked_domains(old.select(F.col("company_domain").alias("domain"), "ats"))
    return merge.upsert(old, new, AS_EV, tracked=tracked).withColumn("skills", F.array_join("skills", ","))


@query("q62_close_missing", f"""WITH {LISTINGS}, whole AS (SELECT DISTINCT company_domain FROM l WHERE order_key % 4 = 0), seen AS (SELECT id FROM l WHERE order_key % 2 = 0)
SELECT id, CASE WHEN closed_at IS NULL AND company_domain IN (SELECT company_domain FROM whole) AND id NOT IN (SELECT id FROM seen) THEN {T_OR} ELSE closed_at END AS closed_at FROM l""")
def q62(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings that a whole read of their board omits are closed."""
    rows = listings(spark, sf_dir).select("id", "order_key", "company_domain", "closed_at")
    return merge.close_missing(rows, rows.where("order_key % 2 = 0"), rows.where("order_key % 4 = 0"), AS_OR).select("id", F.col("closed_at").cast("timestamp_ntz").alias("closed_at"))


@query("q63_alias_owner", "WITH r AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY length(s_name), s_name) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_nationkey AS ats, s_name AS owner, n FROM r WHERE k = 1 AND n > 1")
def q63(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of each board that several domains share."""
    return merge.alias_owner(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("ats"), F.col("s_name").alias("domain")), ["ats"]).select("ats", "owner", "n")


@query("q64_adopt_min_age", "WITH o AS (SELECT o_custkey, o_orderpriority, min(o_orderdate) AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2) SELECT n.o_orderkey, least(n.o_orderdate, coalesce(o.m, n.o_orderdate)) AS first_seen FROM orders n LEFT JOIN o ON o.o_custkey = n.o_custkey AND o.o_orderpriority = n.o_orderpriority WHERE n.o_orderkey % 2 = 1")
def q64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows take the age of the old rows of the same posting."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").alias("first_seen"))
    return merge.adopt_ages(o.where("o_orderkey % 2 = 1"), o.where("o_orderkey % 2 = 0"), ["o_custkey", "o_orderpriority"]).select("o_orderkey", "first_seen")


@query("q65_due_queue", f"WITH s AS (SELECT user_id, CASE WHEN user_id % 10 <> 0 THEN max(ts) + INTERVAL 6 HOUR END AS next_at FROM events GROUP BY 1) SELECT user_id AS domain, next_at FROM s WHERE next_at IS NULL OR next_at <= {T_EV} ORDER BY next_at NULLS FIRST, user_id LIMIT 900")
def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards to poll, the most overdue first."""
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("domain")).agg((F.max("ts") + F.expr("INTERVAL 6 HOUR")).alias("next_at"))
    return merge.due(s.withColumn("next_at", F.when(F.col("domain") % 10 != 0, F.col("next_at"))), AS_EV)


@query("q66_archive_by_month", f"WITH {LISTINGS} SELECT strftime(closed_at, '%Y-%m') AS closed_month, count(*) AS n FROM l WHERE closed_at < {T_OR} - INTERVAL 30 DAY GROUP BY 1")
def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old closed listings by the month of their close."""
    old, _ = publish.archived(listings(spark, sf_dir), AS_OR)
    return old.groupBy("closed_month").agg(F.count(F.lit(1)).alias("n"))


@query("q67_stream_replay_equals_batch", "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, by a stream over the table's files."""
    schema = table(spark, sf_dir, "events").schema
    stream = parquet_stream(spark, sf_dir, "events", schema).select("user_id", "ts", "event_id")
    return latest_by_key(stream, "latest_events", "user_id", ["ts", "event_id"])


@query("q68_alert_new_matches", f"""WITH {LISTINGS}, m AS (SELECT 'urgent' AS alert_id, * FROM l WHERE {OPEN} AND ats IN ('1-URGENT') AND first_seen > TIMESTAMP '2001-01-01 00:00:00'
UNION ALL SELECT 'building' AS alert_id, * FROM l WHERE {OPEN} AND category IN ('BUILDING') AND first_seen > TIMESTAMP '2001-06-01 00:00:00'),
r AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY first_seen DESC, id DESC) AS k FROM m) SELECT alert_id, id, company_domain, title, first_seen FROM r WHERE k <= 50""")
def q68(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest listings of each alert since its last answer."""
    asked = [
        {"alert_id": "urgent", "filter": {"ats": "1-URGENT"}, "last_notified_at": AS_OR.replace(month=1, day=1)},
        {"alert_id": "building", "filter": {"department": "BUILDING"}, "last_notified_at": AS_OR.replace(month=6, day=1)},
    ]
    return alerts.new_matches(listings(spark, sf_dir), asked, AS_OR)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope's figures beside its leading categories."""
    return q15(spark, sf_dir).join(q10(spark, sf_dir).withColumnsRenamed({"value": "category", "n": "category_n"}))


from . import captures, further, keyed, scale  # noqa: E402,F401  their queries register themselves beside these
