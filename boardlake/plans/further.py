"""Further registered queries: the remaining statistics, orders, exports and keyed rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money, places, salary, taxonomy, text
from ..operators import evaluate, explore, facets, listing, merge, predicates, publish, search, stats
from ..sources import boards
from ..sources.tables import table
from ..streaming import poll_state
from .catalogue import LEVELS, T_EV, T_OR, _quantile_sql, companies, first_match_sql, predict_sql, query
from .views import AS_EV, AS_OR, LISTINGS, OPEN, SKILLS, documents, listings, skill_rows

#: Prices of orders spread more than pay does: a range may be so many times its low end wide.
WIDE = 4.0
WEEKS = f"CASE WHEN posted_at IS NULL OR posted_at > {T_OR} THEN 0 ELSE floor((epoch_us({T_OR}) - epoch_us(posted_at)) / 86400000000.0 / 14) END"


@query("q70_facet_disclosed", f"WITH {LISTINGS} SELECT count(*) FILTER (WHERE salary_source = 'disclosed') AS n FROM l WHERE {OPEN}")
def q70(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with disclosed pay, without that filter itself."""
    rows = listings(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))
    return facets.compute(rows, {"salary_disclosed": "1"}, AS_OR)["disclosed"]


@query("q71_jobs_by_board", f"WITH {LISTINGS} SELECT ats, count(*) AS n FROM l WHERE {OPEN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings by board kind."""
    return stats.top(stats.open_rows(listings(spark, sf_dir), AS_OR), "ats")


@query("q72_totals", f"WITH {LISTINGS} SELECT count(*) AS total, count(DISTINCT company_domain) AS companies FROM l WHERE {OPEN}")
def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings and their companies, counted exactly."""
    return stats.totals(stats.open_rows(listings(spark, sf_dir), AS_OR))


@query("q73_raw_locations", f"WITH {LISTINGS} SELECT location, count(*) AS n FROM l WHERE {OPEN} AND trim(location) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent raw locations."""
    return stats.raw_locations(stats.open_rows(listings(spark, sf_dir), AS_OR))


@query("q74_stated_levels", f"WITH {LISTINGS} SELECT seniority, count(*) AS n FROM l WHERE {OPEN} AND seniority IS NOT NULL GROUP BY 1")
def q74(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that listings state."""
    return stats.stated(stats.open_rows(listings(spark, sf_dir), AS_OR), "seniority")


@query("q75_place_split", f"WITH {LISTINGS} SELECT count(*) FILTER (WHERE country = 'IL') AS israel, count(*) FILTER (WHERE country <> 'IL') AS other, count(*) AS total FROM (SELECT * REPLACE (CASE WHEN country = 'MIDDLE EAST' THEN 'IL' ELSE country END AS country) FROM l) WHERE {OPEN}")
def q75(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One country's share of the listings."""
    rows = stats.open_rows(listings(spark, sf_dir), AS_OR)
    return stats.israel_split(rows.withColumn("country", F.transform("country", lambda c: F.when(c == "MIDDLE EAST", "IL").otherwise(c))))


@query("q76_open_by_confidence", f"WITH {LISTINGS} SELECT 'open_' || confidence AS key, CAST(count(*) AS VARCHAR) AS value FROM l WHERE closed_at IS NULL GROUP BY 1")
def q76(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings by confidence, as key and value."""
    return stats.meta_counts(listings(spark, sf_dir))


@query("q77_name_coverage", f"""WITH {LISTINGS}, x AS (SELECT company_domain, CAST(company_domain AS BIGINT) % 3 <> 0 AS has FROM l WHERE {OPEN})
SELECT count(DISTINCT company_domain) AS companies, count(DISTINCT company_domain) FILTER (WHERE has) AS named_companies, count(*) AS listings, count(*) FILTER (WHERE has) AS named_listings FROM x""")
def q77(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies and listings whose company has a name."""
    named = companies(spark, sf_dir).withColumn("company_name", F.when(F.col("domain").cast("long") % 3 != 0, F.col("company_name")).otherwise(""))
    return stats.name_coverage(stats.open_rows(listings(spark, sf_dir).drop("company_name"), AS_OR), named)


@query("q78_skill_coverage", f"WITH {LISTINGS}, {SKILLS}, s AS (SELECT order_key, count(*) AS c FROM k WHERE skill LIKE 'Brand#1%' GROUP BY 1) SELECT count(s.c) AS covered, count(*) AS total, count(s.c) / count(*) AS share FROM l LEFT JOIN s USING (order_key) WHERE {OPEN}")
def q78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many listings have any of some skills."""
    sets = skill_rows(spark, sf_dir).where("skill like 'Brand#1%'").groupBy("order_key").agg(F.collect_set("skill").alias("skills"))
    return stats.skill_coverage(stats.open_rows(listings(spark, sf_dir), AS_OR).join(sets, "order_key", "left"))


@query("q79_company_facts", f"WITH {LISTINGS} SELECT company_domain, count(*) AS total, count(*) FILTER (WHERE closed_at IS NULL) AS open, min(first_seen) AS first_seen, CASE WHEN count(*) FILTER (WHERE closed_at IS NULL) = 0 THEN max(closed_at) END AS last_close FROM l GROUP BY 1")
def q79(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each company's page."""
    return listing.company_facts(listings(spark, sf_dir)).select("company_domain", "total", "open", "first_seen", "last_close")


@query("q80_company_sitemap", f"WITH {LISTINGS} SELECT company_domain, strftime(max(first_seen), '%Y-%m-%dT%H:%M:%SZ') AS lastmod FROM l WHERE closed_at IS NULL GROUP BY 1")
def q80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with the time of their newest listing."""
    return publish.company_sitemap(listings(spark, sf_dir))


@query("q81_feed", f"WITH {LISTINGS} SELECT id, title, company_domain, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS published FROM l WHERE closed_at IS NULL ORDER BY first_seen DESC, id DESC LIMIT 100")
def q81(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest listings as a feed."""
    return publish.feed(listings(spark, sf_dir))


@query("q82_order_by_match", f"""WITH {LISTINGS}, {SKILLS}, s AS (SELECT order_key, list_distinct(list(skill)) AS skills FROM k GROUP BY 1)
SELECT id, CAST(len(list_intersect(skills, ['brand#11', 'brand#22', 'brand#33'])) AS INTEGER) AS score FROM (SELECT order_key, list_transform(skills, lambda x: lower(x)) AS skills FROM s) JOIN l USING (order_key) WHERE {OPEN}
ORDER BY score - {WEEKS} DESC, posted_at DESC NULLS LAST, id DESC LIMIT 100""")
def q82(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings that match wanted skills best, older ones behind."""
    sets = skill_rows(spark, sf_dir).groupBy("order_key").agg(F.collect_set(F.lower("skill")).alias("skills"))
    p = {"sort": "match", "skills": "Brand#11,Brand#22,Brand#33"}
    rows = stats.open_rows(listings(spark, sf_dir), AS_OR).join(sets, "order_key")
    return rows.orderBy(*listing.order(p, AS_OR)).limit(100).select("id", listing.match_score(predicates.skills(p)).alias("score"))


@query("q83_order_by_relevance", f"WITH {LISTINGS} SELECT id FROM l WHERE {OPEN} AND (lower(title) LIKE '%0001%' OR lower(company_domain) LIKE '%0001%' OR lower(location) LIKE '%0001%' OR lower(department) LIKE '%0001%') ORDER BY CASE WHEN lower(title) LIKE '%0001%' THEN 10 ELSE 0 END + CASE WHEN lower(company_domain) LIKE '%0001%' THEN 7 ELSE 0 END + CASE WHEN lower(location) LIKE '%0001%' THEN 6 ELSE 0 END + CASE WHEN lower(department) LIKE '%0001%' THEN 5 ELSE 0 END - 5 * {WEEKS} DESC, posted_at DESC NULLS LAST, id DESC LIMIT 100")
def q83(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings most relevant to a term, older ones behind."""
    rows = listings(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))
    p = {"sort": "relevance", "search": "0001"}
    return rows.where(predicates.compile_filters(p, AS_OR)).orderBy(*listing.order(p, AS_OR)).limit(100).select("id")


@query("q84_merge_partitions", "WITH a AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS domain, greatest(a.ts, b.ts) AS last_checked, CASE WHEN b.ts > a.ts OR a.ts IS NULL THEN 'b' END AS shard FROM a FULL JOIN b ON a.user_id = b.user_id")
def q84(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards with different columns, the fresher copy of each key."""
    e = table(spark, sf_dir, "events")
    part = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("domain")).agg(F.max("ts").alias("last_checked"))
    return merge.merge_partitions([part(0), part(1).withColumn("shard", F.lit("b"))])


@query("q85_stale_and_orphans", "SELECT c_custkey AS domain FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q85(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("domain"))
    return merge.stale_companies(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("domain")), orders)


@query("q86_empty_boards", f"WITH {LISTINGS}, p AS (SELECT company_domain, count(*) FILTER (WHERE closed_at IS NULL) AS open, max(closed_at) AS last FROM l GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS domain FROM customer LEFT JOIN p ON p.company_domain = CAST(c_custkey AS VARCHAR) WHERE coalesce(open, 0) = 0 AND coalesce(last, TIMESTAMP '1999-01-01') < {T_OR} - INTERVAL 30 DAY")
def q86(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies whose board has been empty for a month."""
    c = companies(spark, sf_dir).withColumn("first_seen", F.lit("1999-01-01").cast("timestamp_ntz"))
    return merge.empty_boards(c, listings(spark, sf_dir), AS_OR).select("domain")


@query("q87_poll_intervals", f"WITH s AS (SELECT user_id, max(ts) AS polled, bool_or(value > 90) AS changed, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1) SELECT user_id AS domain, CAST(CASE WHEN failed THEN 300 WHEN changed THEN 300 ELSE 450 END AS INTEGER) AS interval_s FROM s WHERE polled <= {T_EV}")
def q87(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next interval of each board after its polls."""
    polls = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("domain")).agg(F.max("ts").alias("polled_at"), F.bool_or(F.col("value") > 90).alias("changed"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    state = polls.select("domain").limit(0).selectExpr("domain", "cast(null as int) interval_s", "cast(null as timestamp_ntz) next_at", "cast(null as timestamp_ntz) last_change")
    return poll_state.record(state, polls.where(F.col("polled_at") <= F.lit(AS_EV)), state.select("domain")).select("domain", "interval_s")


@query("q88_metro_first_match", "SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '(?i)united kingdom') THEN 'uk' END AS metro FROM nation")
def q88(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets of place names."""
    return table(spark, sf_dir, "nation").select("n_nationkey", places.metro(F.col("n_name")).alias("metro"))


@query("q89_local_dates", "SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS written FROM orders")
def q89(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written out and read again."""
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.written(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("written"))


@query("q90_token_counts", "SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM documents) GROUP BY 1 HAVING count(*) >= 50")
def q90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent tokens of the token table."""
    return search.token_table(documents(spark, sf_dir), ["description"]).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")


@query("q91_learned_estimates", f"WITH {LISTINGS}, r AS (SELECT *, 0 AS fold FROM l), {predict_sql('r', WIDE)} SELECT id, level, round(low, 4) AS low, round(high, 4) AS high FROM t")
def q91(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing's pay range from the first level of cells that is narrow enough, in parts of its low end."""
    rows = listings(spark, sf_dir).select("id", "category", "ats", "location", "seniority", "pay")
    return evaluate.predict(rows, evaluate.cells(rows, LEVELS, "pay"), LEVELS, widest=WIDE).select("id", "level", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


FOLDS = f"r AS (SELECT *, CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 5 AS fold FROM l), {predict_sql('r', WIDE, 5)}"


@query("q92_backtest", f"""WITH {LISTINGS}, {FOLDS}, m AS (SELECT f.f, median(pay) AS flat FROM r JOIN f ON r.fold <> f.f GROUP BY f.f)
SELECT count(*) AS rows, round(count(low) / count(*), 6) AS coverage, round(median(abs((low + high) / 2 - pay) / pay), 6) AS error, round(median(abs(flat - pay) / pay), 6) AS flat_error,
round(avg(CASE WHEN low IS NOT NULL THEN CAST(pay BETWEEN low AND high AS INTEGER) END), 6) AS hit_rate, round(median((high - low) / low), 6) AS width FROM t JOIN m ON m.f = t.fold""")
def q92(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, error, hit rate and width over five folds, and the error of one median for all."""
    rows = listings(spark, sf_dir).select("id", "category", "ats", "location", "seniority", "pay")
    return evaluate.backtest(rows, LEVELS, "pay", "id", widest=WIDE).select("rows", *[F.round(c, 6).alias(c) for c in ("coverage", "error", "flat_error", "hit_rate", "width")])


@query("q159_backtest_levels", f"WITH {LISTINGS}, {FOLDS} SELECT level, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM t WHERE level IS NOT NULL GROUP BY level")
def q159(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which level's cells answer, over five folds."""
    rows = listings(spark, sf_dir).select("id", "category", "ats", "location", "seniority", "pay")
    return evaluate.answered(evaluate.backtested(rows, LEVELS, "pay", "id", widest=WIDE, flat=False))


#: Places of every market, and some of none, by a listing's key.
MARKET_PLACES = ["Palo Alto - Hybrid", "Brooklyn", "Redmond", "Cambridge, MA", "Irvine", "Austin", "Washington, DC", "Evanston", "Boulder", "Durham", "Remote - United States", "London", "Waterloo", "Haifa, Israel", "Remote - Singapore", "Paris", ""]
MARKET_NAMES = ["us-sf", "us-nyc", "us-sea", "us-bos", "us-la", "us-tex", "us-dc", "us-chi", "us-den", "us-atl", "us-remote", "uk", "ca", "il", None, None, None]


def market_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in a place by their key."""
    place = F.element_at(F.array(*map(F.lit, MARKET_PLACES)), (F.col("order_key") % len(MARKET_PLACES) + 1).cast("int"))
    return listings(spark, sf_dir).withColumn("location", place)


_NAMES = "[" + ", ".join("NULL" if m is None else f"'{m}'" for m in MARKET_NAMES) + "]"


def _learned_sql() -> str:
    """Levels as grouping sets of one aggregate, and the answers by one join, as a list of each row's keys."""
    whole = lambda keys: " AND ".join(f"coalesce({k}, '') <> ''" for k in keys)
    key = lambda keys: " || chr(124) || ".join(keys)
    lists = ", ".join(f"CASE WHEN {whole(keys)} THEN {{'o': {i}, 'level': '{name}', 'key': {key(keys)}}} END" for i, (name, keys) in enumerate(evaluate.CHAIN))
    return f"""m AS (SELECT *, ({_NAMES})[order_key % {len(MARKET_NAMES)} + 1] AS metro FROM l),
w AS (SELECT *, CASE WHEN metro LIKE 'us-%' THEN '$' WHEN metro = 'uk' THEN '£' WHEN metro = 'ca' THEN 'CA$' END AS currency FROM m),
e AS (SELECT id, currency, CASE WHEN salary_source = 'disclosed' THEN pay END AS pay, unnest(list_filter([{lists}], lambda x: x IS NOT NULL)) AS x FROM w WHERE currency IS NOT NULL),
c AS (SELECT currency, x.level AS level, x.key AS key, list_sort(list(pay)) AS v, count(*) AS n FROM e WHERE pay IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
b AS (SELECT * FROM (SELECT currency, level, key, {_quantile_sql(15)} AS low, {_quantile_sql(85)} AS high FROM c) WHERE low > 0 AND (high - low) / low <= 1.5),
a AS (SELECT e.id, arg_min({{'level': b.level, 'low': low, 'high': high}}, x.o) AS a FROM e JOIN b ON b.currency = e.currency AND b.level = x.level AND b.key = x.key GROUP BY e.id),
k AS (SELECT id, a.level AS level, a.low AS low, a.high AS high, CASE WHEN a.level IS NOT NULL THEN currency END AS currency FROM w LEFT JOIN a USING (id)),
t AS (SELECT *, currency || format('{{:,}}', CAST(round_even(low / 12 / 1000, 0) AS BIGINT)) || 'K' AS low_text, currency || format('{{:,}}', CAST(round_even(high / 12 / 1000, 0) AS BIGINT)) || 'K' AS high_text FROM k)"""


@query("q160_learned_pay", f"WITH {LISTINGS}, {_learned_sql()} SELECT id, level AS learned_level, round(low, 4) AS learned_low, round(high, 4) AS learned_high, currency AS learned_currency, CASE WHEN low_text = high_text THEN low_text ELSE low_text || ' - ' || high_text END AS learned_text FROM t")
def q160(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay as a reader sees it: of the market's currency, from the tightest of seven levels of disclosed pay, as monthly thousands."""
    rows = evaluate.placed(market_listings(spark, sf_dir))
    told = rows.where("salary_source = 'disclosed'").withColumn("currency", salary.market_currency(F.col("metro"))).where("currency is not null")
    found = evaluate.learned_pay(rows, told)
    return found.select("id", "learned_level", F.round("learned_low", 4).alias("learned_low"), F.round("learned_high", 4).alias("learned_high"), "learned_currency", "learned_text")


@query("q161_markets", f"WITH {LISTINGS} SELECT id, ({_NAMES})[order_key % {len(MARKET_NAMES)} + 1] AS metro FROM l")
def q161(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market of every listing, in places of all markets and of none."""
    return market_listings(spark, sf_dir).select("id", places.metro(F.col("location")).alias("metro"))


@query("q93_explore_facets", f"""WITH {LISTINGS} SELECT 'ats' AS field, ats AS value, ats AS label, count(*) AS n FROM l WHERE closed_at IS NULL GROUP BY 2
UNION ALL SELECT 'category', category, category, count(*) FROM l WHERE closed_at IS NULL GROUP BY 2 UNION ALL SELECT 'seniority', seniority, seniority, count(*) FROM l WHERE closed_at IS NULL AND seniority IS NOT NULL GROUP BY 2
UNION ALL SELECT 'workplace', workplace_type, workplace_type, count(*) FROM l WHERE closed_at IS NULL AND workplace_type IS NOT NULL GROUP BY 2 UNION ALL SELECT 'country', country, country, count(*) FROM l WHERE closed_at IS NULL GROUP BY 2
UNION ALL SELECT 'company', company_domain, min(company_name), count(*) FROM l WHERE closed_at IS NULL GROUP BY 2""")
def q93(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explore mart's facets."""
    rows = listings(spark, sf_dir).drop("company_name").withColumn("skills", F.array().cast("array<string>")).withColumn("url", F.lit(None).cast("string"))
    return explore.mart(rows, companies(spark, sf_dir), AS_OR)["facets"]


@query("q94_stable_content_hash", f"""WITH {LISTINGS}, h AS (SELECT company_domain, md5(concat_ws(chr(31), id, title, location, '')) AS h FROM l)
SELECT company_domain, sha256(concat_ws(':', count(*), sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)), sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)))) AS content_hash FROM h GROUP BY 1""")
def q94(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per company a hash of its listings, whatever their order and number."""
    return listings(spark, sf_dir).groupBy("company_domain").agg(text.content_digest(F.col("id"), F.col("title"), F.col("location"), F.lit("")).alias("content_hash"))


@query("q95_captures_greenhouse", """WITH j AS (SELECT l_orderkey, l_linenumber AS id, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 3 END AS internal, l_returnflag AS title, l_linestatus AS location, strftime(l_shipdate, '%Y-%m-%d') AS published, l_shipdate FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, coalesce(CAST(internal AS VARCHAR), 'p' || id), CASE WHEN internal IS NOT NULL THEN title || location END ORDER BY published, id, l_shipdate, title, location) AS k FROM j)
SELECT CAST(l_orderkey AS VARCHAR) AS token, CAST(id AS VARCHAR) AS external_id, title, location, 'https://job-boards.greenhouse.io/embed/job_app?for=' || l_orderkey || '&token=' || id AS url, l_shipdate AS posted_at FROM r WHERE k = 1""")
def q95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captured boards and their lines (seven at most) as postings: parsed, several postings of one job as one."""
    li = table(spark, sf_dir, "lineitem")
    shipped = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    job = F.struct(F.col("l_linenumber").alias("id"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey") % 3).alias("internal_job_id"), F.col("l_returnflag").alias("title"), F.struct(F.col("l_linestatus").alias("name")).alias("location"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("first_published"), shipped.alias("updated_at"))
    token = F.col("l_orderkey").cast("string")
    captures = li.groupBy(token.alias("domain")).agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("payload")).select("domain", F.lit("greenhouse").alias("ats"), F.col("domain").alias("token"), "payload", F.lit(True).alias("complete"))
    return boards.parse(captures, "greenhouse").select("token", "external_id", "title", "location", "url", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("q96_captures_niloosoft", """SELECT CAST(c_custkey AS VARCHAR) AS token, CAST(c_custkey AS VARCHAR) AS external_id, c_name AS title, CASE WHEN c_nationkey % 3 = 0 THEN 'Israel' ELSE c_mktsegment || ', Israel' END AS location,
'https://' || c_custkey || '/?jobId=' || c_custkey AS url FROM customer WHERE c_custkey % 5 <> 0""")
def q96(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as captured boards of one posting: closed ones left out, the country named."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    job = F.struct(F.col("c_custkey").alias("jobId"), F.col("c_name").alias("jobTitle"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).alias("area"), F.when(F.col("c_custkey") % 5 != 0, 1).otherwise(2).alias("status"))
    captures = c.select(key.alias("domain"), F.lit("niloosoft").alias("ats"), key.alias("token"), F.to_json(F.array(job)).alias("payload"), F.lit(True).alias("complete"))
    return boards.parse(captures, "niloosoft").select("token", "external_id", "title", "location", "url")


TITLES = ["Security Analyst", "Senior Data Engineer", "VP of Sales", "QA Team Lead", "Backend Developer", "Junior Product Manager", "Director of Marketing", "Customer Support Intern", "Principal Site Reliability Engineer", "Office Manager", "Truck Driver", "Staff UX Researcher"]
PLACES = ["Remote, London", "Haifa (hybrid)", "On-site Tel Aviv", "Austin", "work from home"]
TITLE_SQL = "t AS (SELECT o_orderkey, ([" + ", ".join(f"'{t}'" for t in TITLES) + f"])[o_orderkey % {len(TITLES)} + 1] AS title, ([" + ", ".join(f"'{p}'" for p in PLACES) + f"])[o_orderkey % {len(PLACES)} + 1] AS place, CASE WHEN o_custkey % 7 = 0 THEN 'Finance' END AS team FROM orders)"


@query("q97_real_taxonomies", f"WITH {TITLE_SQL} SELECT o_orderkey, {first_match_sql('coalesce(team, chr(0)) || chr(32) || title', taxonomy.CATEGORY_RULES)} AS category, {first_match_sql('title', taxonomy.SENIORITY_RULES)} AS seniority, {first_match_sql('place', taxonomy.WORKPLACE_RULES)} AS workplace FROM t")
def q97(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category, level and workplace of every order, under a title and place by its key, by the real rule lists."""
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pick(TITLES).alias("title"), pick(PLACES).alias("place"), F.when(F.col("o_custkey") % 7 == 0, "Finance").alias("team"))
    return rows.select("o_orderkey", taxonomy.category(F.col("team"), F.col("title")).alias("category"), taxonomy.seniority(F.col("title")).alias("seniority"), taxonomy.workplace(F.col("place")).alias("workplace"))


@query("q98_board_dates", f"SELECT o_orderkey, o_orderdate AS from_millis, o_orderdate AS from_text, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN {T_OR} - INTERVAL 1 DAY ELSE {T_OR} - to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS told FROM orders")
def q98(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as boards write them, and read again: milliseconds, text with UTC, days before the clock."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")
    told = F.when(k % 3 == 0, "Posted Today").when(k % 3 == 1, "Posted Yesterday").otherwise(F.concat(F.lit("Posted "), (k % 40).cast("string"), F.lit("+ Days Ago")))
    ntz = lambda c, name: c.cast("timestamp_ntz").alias(name)
    return o.select("o_orderkey", ntz(dates.normalized(millis), "from_millis"), ntz(dates.normalized(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))), "from_text"), ntz(dates.relative(told, F.lit(AS_OR)), "told"))


@query("q99_pay_texts", """WITH k AS (SELECT o_orderkey, o_orderkey % 4 AS kind, o_orderkey % 300 + 10 AS n FROM orders)
SELECT o_orderkey, CASE kind WHEN 0 THEN '$' WHEN 1 THEN '£' WHEN 3 THEN '₪' END AS currency, CAST(CASE kind WHEN 0 THEN n * 1000 WHEN 1 THEN n * 2080 WHEN 3 THEN n * 1000 END AS DOUBLE) AS low, CAST(CASE kind WHEN 0 THEN (n + 10) * 1000 WHEN 1 THEN n * 2080 WHEN 3 THEN n * 1000 END AS DOUBLE) AS high,
CASE WHEN kind = 3 AND n * 1000 / 12 BETWEEN 2000 AND 400000 THEN CAST(round_even(n * 1000 / 12, 0) AS INTEGER) END AS month_low FROM k""")
def q99(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay as listings write it, read as annual figures and as monthly shekels."""
    k = F.col("o_orderkey")
    n = k % 300 + 10
    s = lambda c: c.cast("string")
    written = F.when(k % 4 == 0, F.concat(F.lit("$"), s(n), F.lit("K – $"), s(n + 10), F.lit("K"))).when(k % 4 == 1, F.concat(F.lit("£"), s(n), F.lit(" per hour"))).when(k % 4 == 2, F.concat(F.lit("$"), s(n), F.lit("K or €9K"))).otherwise(F.concat(F.lit("₪"), s(n * 1000), F.lit(" per year • bonus ₪9")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", money.disclosed(written).alias("d"), money.monthly_shekels(written).alias("m"))
    return rows.select("o_orderkey", "d.currency", "d.low", "d.high", F.col("m.low").alias("month_low"))


@query("q100_skills_whatever_the_case", f"WITH {LISTINGS}, {SKILLS}, s AS (SELECT order_key, list_distinct(list(lower(skill))) AS skills FROM k GROUP BY 1) SELECT id FROM l JOIN s USING (order_key) WHERE {OPEN} AND list_has_any(skills, ['brand#11', 'brand#22']) AND lower(title) LIKE '%1%'")
def q100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with one of two skills, which question and listing spell differently, and a keyword."""
    sets = skill_rows(spark, sf_dir).groupBy("order_key").agg(F.collect_set("skill").alias("skills"))
    rows = listings(spark, sf_dir).withColumn("description", F.lit(None).cast("string")).join(sets, "order_key")
    return rows.where(predicates.compile_filters({"skills": "BRAND#11, brand#22", "keywords": "1"}, AS_OR)).select("id")


@query("q101_names_israel", "SELECT n_nationkey, page_id, contains(replace(lower(n_name || ' ' || url), 'beth israel', ' '), 'israel') OR regexp_matches(replace(lower(n_name || ' ' || url), 'beth israel', ' '), 'haifa|tlv|kiryat|rishon|yehud|yavne|modiin') AS israel FROM pages JOIN nation ON n_nationkey = page_id % 25")
def q101(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses beside nations' names: which of them name Israel."""
    both = table(spark, sf_dir, "pages").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("page_id") % 25)
    return both.select("n_nationkey", "page_id", places.names_israel(F.concat_ws(" ", "n_name", "url")).alias("israel"))
