"""Registered queries of single rules: boards and names, saved questions, single listings, filters of roles and places, words, with their SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places, salary, skills, text
from ..operators import alerts, explore, facets, listing, merge, predicates, publish, search, stats
from ..sources import boards
from ..sources.tables import table
from .catalogue import T_OR, companies, query
from .views import AS_OR, DOCUMENTS, LISTINGS, OPEN, SKILLS, documents, listings, skill_rows


def bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings without a text, and without the company's name, which questions join."""
    return listings(spark, sf_dir).drop("company_name").withColumn("description", F.lit(None).cast("string"))


@query("q102_tech_roles", f"WITH {LISTINGS} SELECT id FROM l WHERE {OPEN} AND order_key % 4 = 0")
def q102(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of one role class."""
    rows = bare(spark, sf_dir).withColumn("role_class", F.when(F.col("order_key") % 4 == 0, "tech").when(F.col("order_key") % 4 == 1, "adjacent"))
    return rows.where(predicates.compile_filters({"roles": "tech"}, AS_OR)).select("id")


@query("q103_countries_cities", f"WITH {LISTINGS} SELECT id, city FROM l WHERE {OPEN} AND order_key % 6 IN (0, 3) AND city IN ('NATION_3', 'NATION_7', 'NATION_11')")
def q103(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in one of two countries and one of three cities; values that are no country code are dropped."""
    rows = bare(spark, sf_dir).withColumn("country", F.array(F.when(F.col("order_key") % 6 == 0, "FR").when(F.col("order_key") % 6 == 3, "DE").otherwise("US")))
    wish = {"country": "fr, de, nowhere", "city": "NATION_3,NATION_7,NATION_11"}
    return rows.where(predicates.compile_filters(wish, AS_OR)).select("id", F.element_at("city", 1).alias("city"))


@query("q104_israel_only", f"WITH {LISTINGS} SELECT id, order_key % 10 = 0 AS by_country, order_key % 15 = 0 AS by_words FROM l WHERE {OPEN} AND (order_key % 10 = 0 OR order_key % 15 = 0)")
def q104(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of one country, by their countries and, for rows that have none yet, by their location's words."""
    k = F.col("order_key")
    place = F.concat("location", F.when(k % 15 == 0, ", Tel Aviv").when(k % 4 == 0, ", Beth Israel Hospital").otherwise(""))
    rows = bare(spark, sf_dir).withColumns({"country": F.when(k % 10 == 0, F.array(F.lit("US"), F.lit("IL"))).otherwise(F.array(F.lit("US"))), "location": place})
    ask = lambda placed: F.coalesce(predicates.compile_filters({"israel_only": "1"}, AS_OR, places=placed), F.lit(False))
    return rows.select("id", ask(True).alias("by_country"), ask(False).alias("by_words")).where("by_country or by_words")


@query("q105_company_list", "SELECT CAST(c_custkey AS VARCHAR) AS domain FROM customer WHERE c_custkey % 6 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q105(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with a known board of two kinds."""
    rows = companies(spark, sf_dir).withColumn("ats", F.when(F.col("domain").cast("long") % 6 != 0, F.col("ats")))
    return rows.where(predicates.company_filters({"resolved_only": "yes", "ats": "BUILDING,MACHINERY"})).select("domain")


@query("q106_profile_wishes", f"WITH {LISTINGS}, {SKILLS}, s AS (SELECT order_key, list_distinct(list(skill)) AS skills FROM k GROUP BY 1) SELECT id FROM l JOIN s USING (order_key) WHERE {OPEN} AND seniority IN ('1-URGENT', '2-HIGH') AND workplace_type = 'O' AND list_has_any(skills, ['Brand#11', 'Brand#12', 'Brand#13', 'Brand#14'])")
def q106(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's wishes as a question."""
    sets = skill_rows(spark, sf_dir).groupBy("order_key").agg(F.collect_set("skill").alias("skills"))
    profile = {"skills": ["brand#11", "brand#12", "brand#13", "brand#14"], "seniority": ["1-URGENT", "2-HIGH"], "workplace": ["O"], "countries": [], "israel_only": False}
    return bare(spark, sf_dir).join(sets, "order_key").where(predicates.compile_filters(predicates.profile_params(profile), AS_OR)).select("id")


@query("q107_detail", f"WITH {LISTINGS} SELECT id, title, CASE WHEN order_key % 2 = 0 THEN 'stored ' || order_key ELSE 'own' END AS description FROM l WHERE id IN (SELECT substr(md5(CAST(max(o_orderkey) AS VARCHAR)), 1, 16) FROM orders)")
def q107(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing, that of the greatest key, with its stored text or else its own."""
    rows = listings(spark, sf_dir).withColumn("description", F.lit("own"))
    blobs = rows.where("order_key % 2 = 0").select(F.col("id").alias("job_id"), F.concat(F.lit("stored "), F.col("order_key").cast("string")).alias("text"))
    last = rows.agg(F.max_by("id", "order_key")).first()[0]
    return listing.detail(rows, blobs, last).select("id", "title", "description")


@query("q108_apply_urls", f"WITH {LISTINGS} SELECT id, CASE WHEN order_key % 2 = 0 AND order_key % 5 <> 0 THEN 'https://www.comeet.com/jobs/' || company_domain || '/' || order_key ELSE 'https://board/' || id END AS url FROM l WHERE closed_at IS NULL")
def q108(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings' links to apply; those of one board are rebuilt where the company's token is known."""
    k = F.col("order_key")
    rows = listings(spark, sf_dir).where("closed_at is null").select("id", F.when(k % 2 == 0, "comeet").otherwise("other").alias("ats"), F.when(k % 5 != 0, F.col("company_domain")).alias("token"), k.cast("string").alias("external_id"), F.concat(F.lit("https://board/"), "id").alias("url"))
    return rows.select("id", listing.apply_url().alias("url"))


@query("q109_changed_descriptions", f"WITH {DOCUMENTS}, h AS (SELECT id, text, substr(sha256(text), 1, 32) AS sha FROM (SELECT id, description AS text FROM d) WHERE text <> '') SELECT id AS job_id, sha FROM h WHERE id % 3 <> 0")
def q109(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are not yet stored under their hash: a third are, a third are under another."""
    jobs = documents(spark, sf_dir).withColumn("description_sha", text.description_sha(F.col("description")))
    blobs = jobs.where("id % 3 < 2").select(F.col("id").alias("job_id"), F.when(F.col("id") % 3 == 0, F.col("description_sha")).otherwise("older").alias("sha"))
    return publish.changed_descriptions(jobs, blobs).select("job_id", "sha")


@query("q110_known_companies", "SELECT CAST(c_custkey AS VARCHAR) AS domain, c_mktsegment AS ats, c_name AS token, CASE WHEN c_acctbal > 0 THEN 'verified' ELSE 'best_effort' END AS confidence FROM customer WHERE c_custkey % 6 <> 0")
def q110(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of companies with a board."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("domain"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("ats"), F.col("c_name").alias("token"), F.when(F.col("c_acctbal") > 0, "verified").otherwise("best_effort").alias("confidence"))
    return publish.known_companies(rows)


@query("q111_kept_meanwhile", "SELECT c_custkey AS domain FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def q111(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that came while a run was on: neither in its baseline, nor resolved by it, nor excluded."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("domain"))
    resolved = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("domain"))
    return merge.kept_meanwhile(c, c.where("domain % 3 = 0"), resolved, c.where("domain % 7 = 0"))


@query("q112_index_orphans", "SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def q112(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows whose listing is gone."""
    index = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    jobs = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    return merge.orphans(index, jobs).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("q113_best_board", f"""WITH b AS (SELECT c_nationkey, CAST(c_custkey AS VARCHAR) AS token, count(o_orderkey) AS job_count, max(o_orderdate) AS newest FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate < TIMESTAMP '1999-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) GROUP BY 1, c_custkey),
t AS (SELECT *, CASE WHEN job_count = 0 THEN 0 WHEN newest IS NULL OR newest >= {T_OR} - INTERVAL 180 DAY THEN 2 ELSE 1 END AS tier FROM b)
SELECT c_nationkey AS domain, token, job_count, CAST(tier AS INTEGER) AS tier FROM t QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY tier DESC, job_count DESC, token DESC) = 1""")
def q113(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation's customers the best board: one with recent orders before a stale one before an empty one, then the most orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    until = F.lit("1999-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 900).cast("int"))
    both = c.join(o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderdate") < until), "left")
    found = both.groupBy(F.col("c_nationkey").alias("domain"), F.col("c_custkey").cast("string").alias("token")).agg(F.count("o_orderkey").alias("job_count"), F.max("o_orderdate").alias("newest"))
    return merge.best_board(found, AS_OR).select("domain", "token", "job_count", "tier")


@query("q114_resolve_boards", """SELECT CAST(c_custkey AS VARCHAR) AS domain, CASE WHEN c_custkey % 7 = 0 THEN 'pin' WHEN c_custkey % 5 = 0 THEN 'hint' WHEN c_custkey % 3 = 0 THEN 'guess' ELSE 'scraped' END AS ats, c_name AS token,
CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END AS tier FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def q114(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's board from the first of four tiers that knows one."""
    c = table(spark, sf_dir, "customer")
    tier = lambda n, name: c.where(F.col("c_custkey") % n == 0).select(F.col("c_custkey").cast("string").alias("domain"), F.lit(name).alias("ats"), F.col("c_name").alias("token"))
    return boards.resolve(tier(7, "pin"), tier(5, "hint"), tier(3, "guess"), tier(2, "scraped"))


@query("q115_tokens_in_urls", r"""WITH h AS (SELECT lower(regexp_extract(url, '^https?://([^/]+)/([^/?#]*)', 1)) AS token, regexp_extract(url, '^https?://([^/]+)/([^/?#]*)', 2) AS site FROM pages), c AS (SELECT token, site, count(*) AS n FROM h WHERE token <> '' GROUP BY 1, 2)
SELECT token, arg_max(site, (n, site)) AS site, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def q115(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages as board tokens, with the first folder that most of a host's pages have."""
    return boards.tokens_in_urls(table(spark, sf_dir, "pages"), "^https?://([^/]+)/([^/?#]*)")


@query("q116_company_names", "WITH c AS (SELECT o_custkey % 100 AS domain, CASE WHEN o_orderkey % 8 > 0 THEN o_orderpriority ELSE '' END AS name, count(*) AS n FROM orders GROUP BY 1, 2) SELECT domain, arg_min(name, (-n, name)) AS company_name FROM c WHERE name <> '' GROUP BY 1")
def q116(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that most answers give a domain."""
    answers = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("domain"), F.when(F.col("o_orderkey") % 8 > 0, F.col("o_orderpriority")).otherwise("").alias("name"))
    return boards.company_names(answers)


@query("q117_logo_tiers", "SELECT c_custkey AS domain, CASE WHEN c_custkey % 3 = 0 THEN 'board/' WHEN c_custkey % 5 = 0 THEN 'site/' ELSE 'favicon/' END || c_name AS logo_url, CASE WHEN c_custkey % 3 = 0 THEN 'board' WHEN c_custkey % 5 = 0 THEN 'site' ELSE 'favicon' END AS logo_source FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 2 = 0")
def q117(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's logo from the first source whose image was verified."""
    c = table(spark, sf_dir, "customer")
    sources = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(s).alias("logo_source"), (F.col("c_custkey") % n == 0).alias("verified")) for k, (s, n) in enumerate([("board", 3), ("site", 5), ("favicon", 2)])])).alias("s")
    rows = c.select(F.col("c_custkey").alias("domain"), "c_name", sources).select("domain", "s.*", F.concat("s.logo_source", F.lit("/"), "c_name").alias("logo_url"))
    return boards.logos(rows)


@query("q118_discovery_queue", """WITH p AS (SELECT o_custkey AS token, 0 AS _new, count(*) AS local_jobs, sum(o_orderkey % 10) AS jobs FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT o_custkey, 1, count(*), sum(o_orderkey % 10) FROM orders GROUP BY 1),
u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY token ORDER BY _new) = 1)
SELECT 'board' AS ats, token, local_jobs, CAST(jobs AS BIGINT) AS jobs FROM u WHERE token % 4 <> 0 ORDER BY local_jobs DESC, jobs DESC, token LIMIT 200""")
def q118(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the next merge: those that wait before those just found, without tracked ones."""
    o = table(spark, sf_dir, "orders")
    found = lambda rows: rows.groupBy(F.lit("board").alias("ats"), F.col("o_custkey").alias("token")).agg(F.count(F.lit(1)).alias("local_jobs"), F.sum(F.col("o_orderkey") % 10).alias("jobs"))
    tracked = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.lit("board").alias("ats"), F.col("c_custkey").alias("token"))
    return boards.discovery_queue(found(o.where("o_orderstatus = 'O'")), found(o), tracked, True)


@query("q119_clean_company_names", "SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE c_name END AS name FROM customer")
def q119(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as pages title them, without tags, boilerplate and legal endings."""
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    titled = F.when(k == 0, F.concat(F.lit("Careers at "), name, F.lit(", Inc."))).when(k == 1, F.concat(F.lit("<b>"), name, F.lit("</b>  GmbH | Open Positions"))).when(k == 2, name).otherwise(" ")
    return table(spark, sf_dir, "customer").select("c_custkey", text.clean_company_name(titled).alias("name"))


@query("q120_names_of_tokens", "SELECT c_custkey, 'acme-' || c_custkey AS stem, concat_ws(' ', 'acme-' || c_custkey, 'acme' || c_custkey, 'acme-' || c_custkey || 'io') AS candidates, concat_ws(' ', 'acme' || c_custkey || '-jobs', 'acme' || c_custkey, 'acme' || c_custkey || 'jobs') AS stems, c_custkey % 2 = 0 AS shaped FROM customer")
def q120(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain's first label, the board tokens worth trying for it, a token's names, and whether a domain is shaped like a token."""
    k = F.col("c_custkey").cast("string")
    domain, token = F.concat(F.lit("Acme-"), k, F.lit(".io")), F.concat(F.lit("Acme"), k, F.lit("-jobs"))
    board = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ACME-"), k, F.lit("/careers"))).otherwise(token)
    return table(spark, sf_dir, "customer").select("c_custkey", text.domain_stem(domain).alias("stem"), F.array_join(text.token_candidates(domain), " ").alias("candidates"), F.array_join(text.name_stems(token), " ").alias("stems"), text.token_shaped(domain, board).alias("shaped"))


@query("q121_real_logos", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE url || '/logo.png' END AS logo, CAST(bit_count(xor(page_id * 2654435761, CAST(length(url) AS BIGINT) * 40503)) AS INTEGER) AS distance FROM pages")
def q121(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' images, empty for those of parked and default pages, and the distance of two image hashes."""
    p = table(spark, sf_dir, "pages")
    parked = F.element_at(F.array(*map(F.lit, text.PLACEHOLDER_LOGOS)), (F.col("page_id") % len(text.PLACEHOLDER_LOGOS) + 1).cast("int"))
    logo = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://x/"), F.upper(parked), F.lit("?1"))).otherwise(F.concat("url", F.lit("/logo.png")))
    return p.select("page_id", text.real_logo(logo).alias("logo"), text.image_distance(F.col("page_id") * 2654435761, F.length("url").cast("long") * 40503).alias("distance"))


NOON = AS_OR + timedelta(hours=13, minutes=15)


@query("q122_digests_due", """WITH a AS (SELECT c_custkey AS alert_id, CASE c_custkey % 3 WHEN 0 THEN 'instant' WHEN 1 THEN 'daily' ELSE 'weekly' END AS cadence, CAST(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 24 ELSE 8 END AS INTEGER) AS hour, CASE WHEN c_custkey % 4 > 0 THEN 30 ELSE 0 END AS minute,
CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 7 ELSE 0 END AS day, CASE WHEN c_custkey % 11 > 0 THEN TIMESTAMP '2001-08-02 00:00:00' - to_hours(CAST(c_custkey % 240 AS INTEGER)) END AS since FROM customer WHERE c_acctbal > 0),
m AS (SELECT *, TIMESTAMP '2001-08-02 00:00:00' + to_minutes(hour * 60 + minute) - CASE WHEN hour * 60 + minute > 795 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS moment FROM a)
SELECT alert_id FROM m WHERE cadence = 'instant' OR since IS NULL OR since < CASE WHEN cadence = 'weekly' THEN moment - to_days(CAST((isodow(moment) - 1 - day + 7) % 7 AS INTEGER)) ELSE moment END""")
def q122(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts whose digest is due on a Thursday at 13:15, by their times, weekdays and last digests."""
    k = F.col("c_custkey")
    at = F.when(k % 4 > 0, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30")))
    since = F.when(k % 11 > 0, F.lit(AS_OR).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (k % 240).cast("int")))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("alert_id"), (F.col("c_acctbal") > 0).alias("active"), F.when(k % 3 == 0, "instant").when(k % 3 == 1, "daily").otherwise("weekly").alias("cadence"), since.alias("last_digest_at"),
        at.alias("digest_time"), F.lit(None).cast("string").alias("digest_tz"), F.when(k % 5 > 0, k % 7).cast("int").alias("digest_day"),
    )
    return alerts.due_alerts(rows, NOON).select("alert_id")


@query("q123_watched_companies", f"WITH {LISTINGS} SELECT company_domain AS domain FROM l WHERE {OPEN} AND ats = '1-URGENT' AND first_seen > {T_OR} - INTERVAL 14 DAY UNION SELECT company_domain FROM l WHERE {OPEN} AND company_domain IN ('1', '2') AND first_seen > {T_OR} - INTERVAL 14 DAY UNION SELECT unnest(['1', '2'])")
def q123(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that alerts name, and those with a match of the last two weeks."""
    asked = [{"alert_id": "urgent", "filter": {"ats": "1-URGENT"}}, {"alert_id": "named", "filter": {"company": "1,2"}}]
    return alerts.watched(listings(spark, sf_dir), asked, AS_OR)


@query("q124_pipeline_health", f"WITH c AS (SELECT o_custkey, max(o_orderdate) AS checked FROM orders GROUP BY 1) SELECT count(*) FILTER (WHERE o_custkey % 9 = 0) AS errors, CAST(floor((epoch({T_OR}) - epoch(min(checked) FILTER (WHERE o_custkey % 6 <> 0))) / 60) AS BIGINT) AS oldest_minutes, CAST(floor((epoch({T_OR}) - epoch(max(checked))) / 60) AS BIGINT) AS freshness_minutes FROM c")
def q124(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of polls, and the minutes since the least recent and the latest check."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_checked"))
    k = F.col("o_custkey")
    return stats.pipeline_health(rows.withColumns({"error": F.when(k % 9 == 0, "HTTP 500").when(k % 9 == 1, ""), "ats": F.when(k % 6 != 0, "board")}), AS_OR)


@query("q125_logo_row", f"""WITH {LISTINGS}, n AS (SELECT company_domain AS domain, count(*) AS n FROM l WHERE closed_at IS NULL GROUP BY 1), r AS (SELECT *, CAST(domain AS BIGINT) % 90 AS logo, domain IN ('7', '14') AS picked FROM n WHERE CAST(domain AS BIGINT) % 4 > 0),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY logo ORDER BY picked DESC, n DESC, domain) = 1) SELECT domain, n, picked FROM f ORDER BY picked DESC, n DESC, domain LIMIT 30""")
def q125(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of logos: hand-picked companies first, then the busiest, each image once."""
    k = F.col("domain").cast("long")
    named = companies(spark, sf_dir).withColumn("logo_url", F.when(k % 4 > 0, F.concat(F.lit("logo "), (k % 90).cast("string"))).otherwise(""))
    return facets.logo_row(listings(spark, sf_dir), named, ["7", "14"]).select("domain", "n", "picked")


@query("q126_any_word", r"""WITH w AS (SELECT doc_id AS id, translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS t FROM documents)
SELECT id FROM w WHERE regexp_matches(t, '(^|[^\p{L}\p{N}])shanthe([^\p{L}\p{N}]|$)') OR regexp_matches(t, '(^|[^\p{L}\p{N}])worthless([^\p{L}\p{N}]|$)') OR t LIKE '%c++%'""")
def q126(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any of two whole words, or with a term that the token index cannot answer."""
    docs = documents(spark, sf_dir).select("id", "description")
    return search.search(docs, search.token_table(docs, ["description"]), "shanthe worthless c++", "any").select("id")


@query("q127_builder_listings", f"""WITH {LISTINGS}, {SKILLS} SELECT id, category, first_seen FROM l WHERE closed_at IS NULL AND category IN ('BUILDING', 'MACHINERY') AND lower(title) LIKE '%1%' AND first_seen >= TIMESTAMP '1999-03-01' AND first_seen < TIMESTAMP '2001-03-01'
AND order_key IN (SELECT order_key FROM k WHERE skill IN ('Brand#11', 'Brand#12')) ORDER BY first_seen DESC, id DESC LIMIT 5000""")
def q127(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The builder's listings under a pick, a text, dates and skills; a limit beyond all bounds becomes the greatest."""
    sets = skill_rows(spark, sf_dir).groupBy("order_key").agg(F.collect_set("skill").alias("skills"))
    rows = listings(spark, sf_dir).drop("company_name").join(sets, "order_key", "left").withColumn("url", F.lit(None).cast("string"))
    asked = [
        {"field": "category", "values": ["BUILDING", "MACHINERY", ""]}, {"field": "title", "text": " 1 "}, {"field": "first_seen", "from": "1999-03-01", "to": "2001-02-28"},
        {"field": "skill", "values": ["Brand#11", "brand#12"]}, {"field": "unknown", "values": ["x"]}, {"field": "location", "text": "  "},
    ]
    return explore.build({"filters": asked, "limit": "1e9"}, explore.mart(rows, companies(spark, sf_dir), AS_OR)).select("id", "category", "first_seen")


@query("q128_json_ld", f"""WITH {LISTINGS} SELECT id, '{{"@context":"https://schema.org/","@type":"JobPosting","title":"' || title || '",' || CASE WHEN posted_at IS NULL THEN '' ELSE '"datePosted":"' || strftime(posted_at, '%Y-%m-%d') || '",' END || '"hiringOrganization":{{"@type":"Organization","name":"' || company_domain || '"}},"jobLocation":{{"@type":"Place","address":"' || location || '"}}}}' AS ld FROM l WHERE closed_at IS NULL""")
def q128(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open listings, whose pay is only estimated, as schema.org postings."""
    rows = listings(spark, sf_dir).where("closed_at is null").withColumns({"salary_text": F.lit("$100K - $120K"), "salary_source": F.lit("table")})
    return rows.select("id", publish.json_ld().alias("ld"))


@query("q129_job_sitemap", f"WITH {LISTINGS} SELECT '<url><loc>https://boards.example/job/' || id || '</loc><lastmod>' || strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') || '</lastmod></url>' AS xml FROM l WHERE closed_at IS NULL")
def q129(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the sitemap of all open listings."""
    rows = listings(spark, sf_dir).withColumn("last_seen", F.lit(None).cast("timestamp_ntz"))
    return publish.sitemap(rows, "https://boards.example", 4).select("xml")


@query("q130_pruned_state", "SELECT c_custkey AS domain FROM customer WHERE c_custkey % 20 <> 0")
def q130(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poll state without the twentieth of boards that are no longer listed."""
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("domain"))
    return merge.prune(state, state.where("domain % 20 <> 0"))


@query("q131_us_regions", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(substr(c_mktsegment, 1, 2)) END AS region FROM customer")
def q131(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state's letters after the city, in one country only."""
    k, state = F.col("c_custkey"), F.upper(F.substring("c_mktsegment", 1, 2))
    place = F.concat(F.lit("Springfield, "), state, F.when(k % 2 == 0, F.lit(", United States")).otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", places.us_region(place, F.lit("Springfield"), F.when(k % 3 == 0, "US").otherwise("CA")).alias("region"))


@query("q132_whole_word_text", r"SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])anat([^\p{L}\p{N}_]|$)')")
def q132(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a word that no letter or digit touches, without an index."""
    return documents(spark, sf_dir).where(predicates.whole_word(F.col("description"), "Anat")).select("id")


#: crc32 of a text of ASCII characters, bit by bit: 3988292384 is its polynomial.
CRC32 = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || CAST(range(8) AS BIGINT[]), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))))"""


@query("q156_hash_shard_sizes", f"WITH {LISTINGS} SELECT {CRC32.format('id')} % 30 AS shard, count(*) AS n, min(id) AS first_id FROM l GROUP BY 1")
def q156(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in shards by crc32 of their ids: each shard's size and first id."""
    rows = listings(spark, sf_dir).select("id", merge.hash_shard(F.col("id"), 30).alias("shard"))
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


VOCABULARY = [skills.Rule("Python", ["python"]), skills.Rule("Spark", exact=["Spark"], context=True, also=["Big Data"]), skills.Rule("Ruby", exact=["Ruby"], context=True), skills.Rule("Canva", ["canva"], whole=True)]


@query("q157_skills_by_rule", "SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Spark, Big Data' WHEN 2 THEN 'Python' WHEN 5 THEN 'Python, Ruby' WHEN 6 THEN 'Ruby' WHEN 7 THEN 'Canva' ELSE '' END AS skills FROM customer")
def q157(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills by a cue, not in a person's name, of a version, not of a longer word, under a heading after a name, in a list, beside a cue, and after a negation."""
    name = F.col("c_name")
    told = [
        F.concat(name, F.lit(": Senior Spark Engineer")), F.concat(F.lit("Call Ruby Chen, "), name), F.concat(F.lit("python3 for "), name), F.concat(F.lit("A canvas of "), name),
        F.concat(F.lit("References: Ruby Chen; "), name), F.concat(name, F.lit("\n- Python\n- Ruby")), F.concat(F.lit("Tools: Ruby\n"), name), F.concat(F.lit("No prior experience with Python, "), name, F.lit(". Uses canva")),
    ]
    said = F.element_at(F.array(*told), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(skills.skills_udf(VOCABULARY)(said), ", ").alias("skills"))


@query("q158_pay_table", """WITH p AS (SELECT n_nationkey % 3 AS role, n_nationkey // 3 % 4 AS band, max(20 + n_nationkey) AS low, arg_max(20 + n_nationkey + 12 * (n_nationkey % 5), n_nationkey) AS high FROM nation WHERE n_nationkey % 3 <> 1 OR n_nationkey // 3 % 4 < 2 GROUP BY 1, 2),
j AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END WHEN 1 THEN 1 WHEN 2 THEN 2 END AS role, CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN NULL ELSE 1 END AS band FROM orders)
SELECT o_orderkey, CASE WHEN high <= 2 * low THEN CAST(low AS DOUBLE) END AS est_low, CASE WHEN high <= 2 * low THEN CAST(high AS DOUBLE) END AS est_high
FROM j LEFT JOIN p ON j.role = p.role AND CASE WHEN j.role = 1 AND j.band > 1 THEN 1 ELSE j.band END = p.band""")
def q158(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of a pay table: roles by title, generic ones by text, the nearest band of a role that lacks its own, and no wide ranges."""
    n, k = F.col("n_nationkey"), F.col("o_orderkey")
    pick = lambda of, *values: F.element_at(F.array(*map(F.lit, values)), (of % len(values) + 1).cast("int"))
    pay = table(spark, sf_dir, "nation").select(pick(n, "backend", "python", "java").alias("role"), pick(F.floor(n / 3), *salary.BANDS).alias("band"), (20 + n).cast("double").alias("low"), (20 + n + 12 * (n % 5)).cast("double").alias("high"))
    pay = pay.where("role <> 'python' or band in ('0-2', '3-5')")
    jobs = table(spark, sf_dir, "orders").select(
        "o_orderkey", pick(k, "Backend Engineer", "Python Developer", "Java Developer", "Brand Designer").alias("title"), pick(k, "We write Python", "A Java shop", None, "Security", "").alias("description"),
        pick(k, "junior", "mid", "senior", "lead", "exec", None, "unknown").alias("seniority"),
    )
    return salary.table_estimate(jobs, pay, [("python", ["python"]), ("java", ["java"]), ("backend", ["backend"])]).select("o_orderkey", "est_low", "est_high")
