"""Registered queries of what works on whole tables of questions, tokens and fragments, with their SQL."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, facets, images, ordered, placing, postings, publish, stats
from ..session import shared_folder
from ..sources import boards
from ..sources.tables import table
from .catalogue import AGE, T_OR, companies, query
from .views import AS_OR, DOCUMENTS, LISTINGS, OPEN, documents, listings

#: Alerts of a customer.
KINDS = 7
_STATES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PLAIN = "closed_at IS NULL AND (posted_at IS NULL OR posted_at >= TIMESTAMP '2000-08-02 00:00:00')"
#: What each kind of alert asks, as SQL on a listing l and an alert a.
ASKED = [
    "l.company_domain = CAST(a.c AS VARCHAR)",
    f"{OPEN} AND l.ats IN (a.state, '5-LOW') AND l.category = a.segment",
    f"{OPEN} AND l.location = a.nation AND posted_at IS NOT NULL AND (epoch_us({T_OR}) - epoch_us(posted_at)) / 86400000000.0 <= 30 + a.c % 100",
    f"{OPEN} AND l.seniority IN ('1-URGENT', a.state) AND (salary_max_ils IS NULL OR salary_max_ils >= a.c % 400 * 1000) AND salary_source = 'disclosed'",
    f"{OPEN} AND lower(l.title) LIKE '%customer%' AND (lower(l.title) LIKE '%' || (a.c % 100) || '%' OR lower(l.company_domain) LIKE '%' || (a.c % 100) || '%' OR lower(l.location) LIKE '%' || (a.c % 100) || '%') AND l.workplace_type = 'O'",
    f"{_PLAIN} AND confidence = 'best_effort' AND l.city IN (a.nation, 'PERU')",
    "false",
]


def customer_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven alerts of each customer: their own company, sets of values, ages, pay, words, a city, and one that is no question."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    text = lambda x: x.cast("string")
    state = F.element_at(F.array(*map(F.lit, _STATES)), (k % 5 + 1).cast("int"))
    pairs = lambda **given: F.map_from_entries(F.array(*[F.struct(F.lit(a).alias("k"), (b if not isinstance(b, str) else F.lit(b)).alias("v")) for a, b in given.items()]))
    filters = [
        pairs(company=text(k), include_closed="1", confidence="all", include_outdated="yes"), pairs(ats=F.concat(state, F.lit(" , 5-LOW")), department=F.col("c_mktsegment")), pairs(location=F.col("n_name"), max_age_days=text(30 + k % 100)),
        pairs(seniority=F.concat(F.lit("1-URGENT,"), state), salary_min=text(k % 400 * 1000), salary_disclosed="1"), pairs(search=F.concat(F.lit('"Customer" '), text(k % 100)), workplace="O"),
        pairs(confidence="best_effort", city=F.concat(F.col("n_name"), F.lit(",PERU"))), pairs(confidence="nonsense"),
    ]
    since = F.when(k % 13 > 0, F.lit(AS_OR).cast("timestamp_ntz") - F.make_dt_interval((k % 300 + 1).cast("int")))
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("c"), since.alias("last_notified_at"), F.posexplode(F.array(*filters)).alias("kind", "filter"))
    return rows.select(F.concat_ws("-", "c", "kind").alias("alert_id"), "filter", "last_notified_at")


@query("q162_alert_index", f"""WITH {LISTINGS}, a AS (SELECT c_custkey AS c, c_mktsegment AS segment, n_name AS nation, (['{"', '".join(_STATES)}'])[c_custkey % 5 + 1] AS state,
CASE WHEN c_custkey % 13 > 0 THEN {T_OR} - to_days(CAST(c_custkey % 300 + 1 AS INTEGER)) END AS since FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS ({" UNION ALL ".join(f"SELECT a.c || '-{i}' AS alert_id, l.id, l.company_domain, l.title, l.first_seen FROM a JOIN l ON {cond} AND (a.since IS NULL OR l.first_seen > a.since)" for i, cond in enumerate(ASKED))})
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY first_seen DESC, id DESC) <= 50""")
def q162(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven standing questions of every customer over all listings: the newest fifty of each since its last answer."""
    return alerts.matches(listings(spark, sf_dir), customer_alerts(spark, sf_dir), AS_OR)


#: Questions whose facets come from one scan: the stored variants' kinds, and one with filters of several facets.
FACETED = {
    "verified": {}, "all": {"confidence": "all"}, "closed too": {"include_closed": "1", "include_outdated": "1"},
    "narrow": {"ats": "1-URGENT,2-HIGH", "department": "BUILDING,MACHINERY", "location": "CHINA,PERU,FRANCE", "salary_min": "100000", "salary_disclosed": "1"},
}
_OPEN_ALL = "closed_at IS NULL AND (posted_at IS NULL OR posted_at >= TIMESTAMP '2000-08-02 00:00:00')"
_VARIANTS = {"verified": (OPEN, {}), "all": (_OPEN_ALL, {}), "closed too": ("confidence = 'verified'", {}), "narrow": (OPEN, {
    "ats": "ats IN ('1-URGENT', '2-HIGH')", "department": "category IN ('BUILDING', 'MACHINERY')", "location": "location IN ('CHINA', 'PERU', 'FRANCE')", "salary_min": "(salary_max_ils >= 100000 OR salary_max_ils IS NULL)", "salary_disclosed": "salary_source = 'disclosed'"})}


def _facets_sql() -> str:
    """Each facet of each question by itself."""


    out = []
    for variant, (always, own) in _VARIANTS.items():
        where = lambda drop, always=always, own=own: " AND ".join([always, *[f"coalesce({c}, false)" for p, c in own.items() if p not in drop]])
        head = lambda name, variant=variant: f"SELECT '{variant}' AS variant, '{name}' AS name"
        for name, (column, param) in facets.SCALAR.items():
            most = facets.COMPANIES if name == "company" else facets.LIMIT
            out.append(f"{head(name)}, rank, value, NULL AS part, n, NULL AS part_n, NULL AS low, NULL AS high FROM (SELECT {column} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {column}) AS rank FROM l WHERE {where([param])} AND trim({column}) <> '' GROUP BY 1) WHERE rank <= {most}")
        placed = where(facets._PLACES)
        out.append(f"{head('country')}, rank, value, NULL, n, NULL, NULL, NULL FROM (SELECT country AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, country) AS rank FROM l WHERE {placed} GROUP BY 1) WHERE rank <= 60")
        out.append(f"{head('places')}, rank, value, part, n, part_n, NULL, NULL FROM (SELECT country AS value, city AS part, sum(count(*)) OVER (PARTITION BY country) AS n, count(*) AS part_n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, city) AS rank FROM l WHERE {placed} GROUP BY 1, 2) WHERE rank <= 25")
        out.append(f"{head('pay')}, 1, NULL, CAST(round(median((salary_min_ils + salary_max_ils) / 2), 4) AS VARCHAR), count(*) FILTER (WHERE salary_min_ils IS NOT NULL AND salary_max_ils IS NOT NULL), NULL, min(salary_min_ils), max(salary_max_ils) FROM l WHERE {where(facets._PAY)}")
        out.append(f"{head('disclosed')}, 1, NULL, NULL, count(*) FILTER (WHERE salary_source = 'disclosed'), NULL, NULL, NULL FROM l WHERE {where(['salary_disclosed'])}")
    return " UNION ALL ".join(out)


@query("q163_facets_in_one_scan", f"WITH {LISTINGS}, x AS ({_facets_sql()}) SELECT variant, name, CAST(rank AS INTEGER) AS rank, value, CASE WHEN name <> 'pay' THEN part END AS part, CASE WHEN name = 'pay' THEN round(CAST(part AS DOUBLE), 4) END AS median, CAST(n AS BIGINT) AS n, CAST(part_n AS BIGINT) AS part_n, low, high FROM x")
def q163(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets of four questions, each without its own filter, from one scan of the listings."""
    found = facets.all_facets(listings(spark, sf_dir).withColumn("description", F.lit(None).cast("string")), FACETED, AS_OR)
    pay = F.col("name") == "pay"
    return found.withColumns({"median": F.round(F.when(pay, F.col("part").cast("double")), 4), "part": F.when(~pay, F.col("part"))})


_FILLED = 60_000


@query("q164_ordered_chunks", f"""WITH RECURSIVE r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, strlen(coalesce(text, '')) AS size FROM documents),
g AS (SELECT doc_id, k, size, CAST(0 AS BIGINT) AS chunk, 1 AS n, size AS total FROM r WHERE k = 1
UNION ALL SELECT r.doc_id, r.k, r.size, CASE WHEN g.n < 25 AND g.total + r.size <= {_FILLED} THEN g.chunk ELSE g.chunk + 1 END, CASE WHEN g.n < 25 AND g.total + r.size <= {_FILLED} THEN g.n + 1 ELSE 1 END, CASE WHEN g.n < 25 AND g.total + r.size <= {_FILLED} THEN g.total + r.size ELSE r.size END FROM g JOIN r ON r.k = g.k + 1)
SELECT chunk, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM g GROUP BY chunk""")
def q164(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their ids in chunks of 25 rows and 60,000 bytes at most, each as full as can be."""
    docs = table(spark, sf_dir, "documents").withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).select("doc_id", "size")
    cut = ordered.chunks(docs, ["doc_id"], F.col("size"), publish.FRAGMENT_ROWS, _FILLED)
    return cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("q165_sitemap_index", f"""WITH {LISTINGS}, r AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 1000 AS shard FROM l WHERE closed_at IS NULL)
SELECT shard, 'sitemap-' || lpad(CAST(shard AS VARCHAR), 5, '0') || '.xml' AS name, count(*) AS n, strftime(max(first_seen), '%Y-%m-%dT%H:%M:%SZ') AS lastmod, min(id) AS first_id, max(id) AS last_id FROM r GROUP BY 1""")
def q165(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the sitemap's files, each of exactly a thousand listings but the last."""
    rows = listings(spark, sf_dir).withColumn("last_seen", F.col("first_seen"))
    return publish.sitemap_index(publish.sitemap(rows, "https://example.com", 1000))


_KEPT: dict[tuple[str, str], str] = {}


def documents_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of the documents, made by the first question of an application."""
    docs = documents(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        _KEPT[key] = path
        return postings.write(postings.build(docs, ["title", "company_domain", "description"]), path)
    return spark.read.parquet(_KEPT[key])


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query("q166_words_of_any_field", f"WITH {DOCUMENTS}, w AS (SELECT id, {_WORDS.format('title')} || {_WORDS.format('company_domain')} || {_WORDS.format('description')} AS words FROM d) SELECT id AS number FROM w WHERE list_has_all(words, ['the', 'src1', 'and'])")
def q166(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with three words in whichever field, by blocks of the stored index."""
    return postings.every(documents_index(spark, sf_dir), "and the SRC1")


@query("q167_phrase_in_a_field", f"WITH {DOCUMENTS} SELECT id AS number FROM d WHERE contains(' ' || array_to_string({_WORDS.format('title')}, ' ') || ' ', ' of the ')")
def q167(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two words next to each other in their titles."""
    return postings.phrase(documents_index(spark, sf_dir), "of the", ["title"])


@query("q168_posting_blocks", f"WITH {DOCUMENTS}, t AS (SELECT DISTINCT id, unnest({_WORDS.format('description')}) AS token FROM d WHERE NOT regexp_matches(description, '[àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀ-Ýß]')) SELECT token, count(*) AS n FROM t GROUP BY 1")
def q168(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of plain documents that have each word, added up over the blocks of an index of their own."""
    plain = documents(spark, sf_dir).where("octet_length(description) = char_length(description) or not regexp(description, '[àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀ-Ýß]')")
    return postings.build(plain, ["description"]).groupBy("token").agg(F.sum("n").alias("n"))


_CODE = "CAST(list_sum([CASE WHEN embedding[i] > 0 AND i < 64 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END for i in range(1, 65)]) AS BIGINT)"


@query("q169_near_shapes", f"""WITH e AS (SELECT vec_id, {_CODE} AS code FROM embeddings), v AS (SELECT vec_id * 4 + k AS id, xor(code, CASE k WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 4398046511112 ELSE 281479271743489 END) AS shape FROM e, range(4) r(k))
SELECT a.shape AS a, b.shape AS b, CAST(bit_count(xor(a.shape, b.shape)) AS INTEGER) AS distance FROM (SELECT DISTINCT shape FROM v) a JOIN (SELECT DISTINCT shape FROM v) b ON bit_count(xor(a.shape, b.shape)) <= 6""")
def q169(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of shapes within six bits: the signs of every vector, and three versions of each with some bits changed."""
    one = F.lit(1).cast("long")
    code = F.aggregate(F.transform("embedding", lambda x, i: F.when((x > 0) & (i < 63), F.call_function("shiftleft", one, i.cast("int"))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    changed = F.array(*[code.bitwiseXOR(F.lit(x).cast("long")) for x in (0, 7, 4398046511112, 281479271743489)])
    shapes = table(spark, sf_dir, "embeddings").select(F.explode(changed).alias("shape"))
    return images.near_pairs(shapes, shapes)


_WIDE = "confidence = 'verified' AND ats IN ('1-URGENT', '2-HIGH')"
_FLOWS = ", ".join(f"count(*) FILTER (WHERE {c} >= {T_OR} - INTERVAL {d} DAY) AS {n}" for n, c, d in (("new_jobs_24h", "first_seen", 1), ("new_jobs_7d", "first_seen", 7), ("closed_jobs_24h", "closed_at", 1), ("closed_jobs_7d", "closed_at", 7)))


@query("q170_scoped_answer", f"""WITH {LISTINGS}, o AS (SELECT *, {AGE} AS age FROM l WHERE {OPEN} AND ats IN ('1-URGENT', '2-HIGH')), c AS (SELECT company_domain AS d, count(*) AS n FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT (SELECT count(*) FROM o) AS open_jobs, (SELECT count(DISTINCT company_domain) FROM o) AS companies_hiring, {_FLOWS}, (SELECT round(median(age), 1) FROM o) AS median_open_days, (SELECT round(max(age), 1) FROM o) AS oldest_open_days,
(SELECT string_agg(d || ' ' || n || ' logo ' || d, ', ' ORDER BY n DESC, d) FROM c) AS top_companies FROM l WHERE {_WIDE}""")
def q170(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of a narrowed question: its own rows, its companies, and what came and went in its scope."""
    named = companies(spark, sf_dir).withColumn("logo_url", F.concat(F.lit("logo "), "domain"))
    found = stats.scoped_answer(listings(spark, sf_dir), {"ats": "1-URGENT,2-HIGH"}, AS_OR, named)
    return found.withColumn("top_companies", F.array_join(F.transform("top_companies", lambda x: F.concat_ws(" ", x["domain"], x["n"], x["logo_url"])), ", "))


_SHARED = f"x AS (SELECT posted_at, count(*) AS n, strftime(posted_at, '%Y-%m-%d %H:%M:%S') || ': ' || count(*) || ' jobs across ' || count(DISTINCT company_domain) || ' different companies share this exact timestamp' AS w FROM l WHERE closed_at IS NULL AND posted_at IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT company_domain) >= 2)"


@query("q171_meta_and_health", f"""WITH {LISTINGS}, {_SHARED}, m AS (SELECT count(*) AS jobs_total, count(*) FILTER (WHERE closed_at IS NULL) AS jobs_open, count(*) FILTER (WHERE closed_at IS NULL AND confidence = 'verified') AS verified, count(*) FILTER (WHERE closed_at IS NULL AND confidence = 'best_effort') AS best FROM l)
SELECT 'jobs_total' AS key, CAST(jobs_total AS VARCHAR) AS value FROM m UNION ALL SELECT 'jobs_open', CAST(jobs_open AS VARCHAR) FROM m UNION ALL SELECT 'open_jobs_verified', CAST(verified AS VARCHAR) FROM m UNION ALL SELECT 'open_jobs_best_effort', CAST(best AS VARCHAR) FROM m
UNION ALL SELECT 'companies_total', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT 'companies_resolved', CAST(count(*) FILTER (WHERE c_custkey % 4 > 0) AS VARCHAR) FROM customer
UNION ALL SELECT 'timestamp_clustering_warnings', coalesce((SELECT string_agg(w, '; ' ORDER BY n DESC, posted_at) FROM (SELECT * FROM x ORDER BY n DESC, posted_at LIMIT 40)), '') UNION ALL SELECT 'timestamp_clustering_warning_count', CAST(count(*) AS VARCHAR) FROM x UNION ALL SELECT 'last_loaded', '2001-08-02T00:00:00Z'
UNION ALL SELECT 'shown', CAST(least(20, count(*)) AS VARCHAR) FROM x UNION ALL SELECT 'minutes', '2880.0'""")
def q171(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load notes of all listings and companies, and two figures of the health answer that reads it."""
    named = companies(spark, sf_dir).withColumn("ats", F.when(F.col("domain").cast("long") % 4 > 0, F.col("ats"))).withColumn("last_checked", F.lit(AS_OR - timedelta(days=2)))
    stored = stats.meta(listings(spark, sf_dir), named, AS_OR, keep_midnight=True)
    told = stats.health_answer(stored, named, AS_OR)
    return stored.unionByName(told.select(F.explode(F.array(F.struct(F.lit("shown").alias("key"), F.size("timestamp_clustering_warnings").cast("string").alias("value")), F.struct(F.lit("minutes").alias("key"), F.col("minutes_since_check").cast("string").alias("value")))).alias("x")).select("x.key", "x.value"))


@query("q172_pins_and_hints", """WITH s AS (SELECT s_suppkey AS k, s_name AS n FROM supplier), p AS (SELECT n AS domain, 'comeet' AS ats, CASE WHEN k % 5 > 0 THEN lpad(CAST(k AS VARCHAR), 6, '0') END AS token FROM s WHERE k % 3 = 0), h AS (SELECT n AS domain, 'lever' AS ats, 't' || k AS token FROM s WHERE k % 2 = 0 AND k % 7 > 0)
SELECT domain, coalesce(p.ats, h.ats) AS ats, CASE WHEN p.domain IS NOT NULL THEN p.token ELSE h.token END AS token, CASE WHEN p.domain IS NOT NULL THEN 0 ELSE 1 END AS tier FROM p FULL JOIN h USING (domain)""")
def q172(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of suppliers by files of pins and of hints, written from the table and read again; pins come first."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    s, folder = table(spark, sf_dir, "supplier"), f"{shared_folder(spark)}/pins-{uuid.uuid4().hex}"
    entry = F.concat(F.lit("  - domain: "), name, F.lit("   # by hand\n"), F.when(k % 5 > 0, F.concat(F.lit('    token: "'), F.lpad(k.cast("string"), 6, "0"), F.lit('"\n'))).otherwise(""), F.lit("    jobs_seen: many"))
    pins = s.where(k % 3 == 0).groupBy((k % 4).alias("part")).agg(F.concat(F.lit("# pins\ncomeet:\n"), F.array_join(F.sort_array(F.collect_list(entry)), "\n")).alias("value"))
    pins.repartitionById(4, F.col("part").cast("int")).select("value").write.text(f"{folder}/pins")
    hint = F.struct(name.alias("domain"), F.lit("lever").alias("ats"), F.when(k % 7 > 0, F.concat(F.lit("t"), k.cast("string"))).alias("token"))
    hints = s.where(k % 2 == 0).groupBy((k % 3).alias("part")).agg(F.to_json(F.collect_list(hint)).alias("value"))
    hints.repartitionById(3, F.col("part").cast("int")).select("value").write.text(f"{folder}/hints")
    none = spark.createDataFrame([], "domain string, ats string, token string")
    return boards.resolve(boards.read_pins(spark, f"{folder}/pins"), boards.read_hints(spark, f"{folder}/hints"), none, none)


#: Locations as boards write them, and the countries and cities that they name, by the gazetteer of the query.
LOCATIONS = {
    "Haifa, Israel": ("IL", "Haifa"), "Atlanta, Georgia": ("US", "Atlanta"), "Berlin / Paris": ("DE,FR", "Berlin,Paris"), "Remote - France": ("FR", ""), "New York Office": ("US", "New York"), "Chicago, IL": ("US", "Chicago"), "il": ("IL", ""), "Kiryat Ono; Berlin, Germany": ("IL,DE", "Kiryat Ono,Berlin"),
    "São Paulo, Brazil": ("BR", "São Paulo"), "Tel-Aviv; tel aviv": ("IL", "Tel Aviv"), "All over Japan": ("JP", ""), "Beth Israel Deaconess": ("", ""), "UK": ("GB", ""), "DEU": ("DE", ""), "Lehi, Utah": ("US", "Lehi"), "Remote": ("", ""),
}
_PLACED = ", ".join("{{'l': '{}', 'c': '{}', 't': '{}'}}".format(*(x.replace("'", "''") for x in (k, c, t))).replace("{{", "{").replace("}}", "}") for k, (c, t) in LOCATIONS.items())


@query("q173_places_by_gazetteer", f"WITH p AS (SELECT c_custkey, ([{_PLACED}])[c_custkey % {len(LOCATIONS)} + 1] AS x FROM customer) SELECT c_custkey, x.c AS countries, x.t AS cities FROM p")
def q173(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries and cities of every customer's location, in the spellings of boards, by joins with a gazetteer."""
    at = F.element_at(F.array(*map(F.lit, LOCATIONS)), (F.col("c_custkey") % len(LOCATIONS) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", at.alias("location"))
    known = placing.gazetteer(spark, cities={"haifa": "IL", "tel aviv": "IL", "berlin": "DE", "paris": "FR", "new york": "US", "Atlanta": "US", "São Paulo": "BR"})
    found = placing.cities(placing.countries(rows, known), known)
    return found.select("c_custkey", F.array_join("country", ",").alias("countries"), F.array_join("city", ",").alias("cities"))
