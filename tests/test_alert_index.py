"""Alerts as a table: every filter answers as the same filter of a listing question does."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardlake.operators import alerts
from boardlake.operators.predicates import compile_filters

NOW = datetime(2024, 1, 31)
FILTERS = [
    {}, {"ats": "lever, ashby,"}, {"company": "c1.com"}, {"company": " "}, {"skills": "Python, sql"}, {"skills": "none such"}, {"country": "il,US,usa"}, {"city": "Haifa, Tel Aviv"}, {"city": "a/b"}, {"confidence": "all"}, {"confidence": "best_effort", "include_closed": "YES"},
    {"include_outdated": "1"}, {"q": "engineer"}, {"q": "  "}, {"search": '"data engineer" haifa'}, {"search": "sales data", "search_mode": "any"}, {"search": 'c1 ""'}, {"search": "100%"}, {"keywords": "data; pipelines;"}, {"min_age_days": "3"}, {"max_age_days": "+10", "include_outdated": "on"}, {"min_age_days": "0", "max_age_days": "400", "include_outdated": "true"},
    {"salary_min": "20000"}, {"salary_max": "15000", "salary_known": "1"}, {"salary_min": "x", "salary_max": "0"}, {"salary_disclosed": "1"}, {"roles": "tech"}, {"roles": "all"}, {"israel_only": "1"}, {"ids": "00000003,zz,0000000a"}, {"ids": "zz"}, {"seniority": "senior", "workplace": "remote", "location": "Haifa,London"}, {"department": "Data", "country": "GB", "skills": "python,spark"},
]


@pytest.fixture(scope="module")
def jobs(spark):
    rows = []
    for i in range(400):
        pick = lambda *x, i=i: x[(i * 7 + len(x)) % len(x)]
        rows.append((
            f"{i:08x}", f"c{i % 9}.com", pick("lever", "ashby", "workday"), pick("Data Engineer", "Sales Lead", "100% Remote ENGINEER", None), pick("Haifa", "London", None, "Tel Aviv"), pick("Data", "Sales"), pick("Build data pipelines", None, ""), pick("Data", "Sales", None), pick("senior", None), pick("remote", "hybrid", None, "onsite", None),
            pick(["Python", "SQL"], ["spark"], [], None), pick(["IL"], ["GB", "US"], [], None), pick(["Haifa", "Tel Aviv"], ["London"], []), NOW - timedelta(days=i % 17, hours=i), NOW - timedelta(days=i % 5) if i % 3 == 0 else None, pick("verified", "best_effort", "verified"),
            None if i % 11 == 0 else NOW - timedelta(days=i * 2), float(i * 100) if i % 4 else None, float(i * 130) if i % 4 else None, pick("disclosed", "table", None), pick("tech", "other", None),
        ))
    return spark.createDataFrame(rows, "id string, company_domain string, ats string, title string, location string, department string, description string, category string, seniority string, workplace_type string, skills array<string>, country array<string>, city array<string>, first_seen timestamp, closed_at timestamp, confidence string, posted_at timestamp, salary_min_ils double, salary_max_ils double, salary_source string, role_class string")


def plain(jobs, filters, last, limit):
    rows = jobs.where(compile_filters(filters, NOW))
    rows = rows.where(F.col("first_seen") > F.lit(last)) if last else rows
    return [r["id"] for r in rows.orderBy(F.desc("first_seen"), F.desc("id")).limit(limit).collect()]


@pytest.mark.parametrize("limit", [7, 1000])
def test_index_answers_like_a_listing_question(spark, jobs, limit):
    asked = [(f"{n}-{k}", f, last) for n, f in enumerate(FILTERS) for k, last in enumerate((None, NOW - timedelta(days=6)))]
    got = {}
    for r in alerts.matches(jobs, spark.createDataFrame(asked, "alert_id string, filter map<string,string>, last_notified_at timestamp"), NOW, limit).orderBy(F.desc("first_seen"), F.desc("id")).collect():
        got.setdefault(r["alert_id"], []).append(r["id"])
    want = {a: plain(jobs, f, last, limit) for a, f, last in asked}
    assert got == {a: x for a, x in want.items() if x} and len(got) > 40


def test_alerts_that_ask_nothing(spark, jobs):
    rows = [("a", {"confidence": "nonsense"}, True), ("b", {"min_age_days": "soon"}, True), ("c", {}, False), ("d", {"company": None, "confidence": ""}, True), ("e", None, True)]
    table = spark.createDataFrame(rows, "alert_id string, filter map<string,string>, active boolean").withColumn("last_notified_at", F.lit(None).cast("timestamp"))
    assert {r["alert_id"]: r["error"] for r in alerts.questions(table).collect()} == {"a": "confidence must be verified, best_effort or all", "b": "min_age_days must be an integer", "c": None, "d": None, "e": None}
    assert {r["alert_id"] for r in alerts.matches(jobs, table, NOW).collect()} == {"d", "e"}
    assert alerts.matches(jobs.limit(0), table, NOW).count() == alerts.matches(jobs, table.limit(0), NOW).count() == 0
    with pytest.raises(ValueError):
        alerts.new_matches(jobs, [{"alert_id": "x", "filter": {"confidence": "nonsense"}}], NOW)


def test_the_plan_does_not_grow_with_the_alerts(spark, jobs):
    size = []
    for n in (2, 500):
        table = spark.createDataFrame([(str(i), {"company": f"c{i}.com"}, None) for i in range(n)], "alert_id string, filter map<string,string>, last_notified_at timestamp")
        plan = alerts.matches(jobs, table, NOW)._jdf.queryExecution().optimizedPlan().toString()
        size.append((plan.count("Filter"), plan.count("Join"), plan.count("Aggregate")))
    assert size[0] == size[1]


def test_watched_by_a_table(spark, jobs):
    table = spark.createDataFrame([("a", {"company": "x.com,y.com"}), ("b", {"ats": "lever"})], "alert_id string, filter map<string,string>").withColumn("last_notified_at", F.lit(None).cast("timestamp"))
    recent = jobs.where(compile_filters({"ats": "lever"}, NOW)).where(F.col("first_seen") > F.lit(NOW - timedelta(days=14)))
    assert {r["domain"] for r in alerts.watched_by(jobs, table, NOW).collect()} == {r["company_domain"] for r in recent.collect()} | {"x.com", "y.com"}


@pytest.mark.parametrize("few", [0, 1000])
def test_all_companies_with_a_match_are_watched(spark, jobs, monkeypatch, few):
    monkeypatch.setattr(alerts, "FEW", few)
    many = jobs.where("ats = 'lever' and confidence = 'verified'").limit(1).crossJoin(spark.range(1500).withColumnRenamed("id", "i")).withColumns({
        "id": F.lpad(F.hex("i"), 8, "0"), "company_domain": F.when(F.col("i") < 500, "busy.com").otherwise(F.concat(F.lit("m"), F.col("i").cast("string"), F.lit(".com"))),
        "first_seen": F.lit(NOW) - F.make_dt_interval((F.col("i") / 100).cast("int")), "closed_at": F.lit(None).cast("timestamp"), "posted_at": F.lit(None).cast("timestamp"), "skills": F.array(F.lit("Python"), F.lit("SQL")),
    }).drop("i")
    ask = lambda **f: {r["domain"] for r in alerts.watched_by(many, alerts.as_table(spark, [{"alert_id": "a", "filter": f}, {"alert_id": "b", "filter": {"ids": "zz", "skills": "none such"}}]), NOW).collect()}
    want = {"busy.com"} | {f"m{i}.com" for i in range(500, 1400)}  # the listings from 1,400 on are 14 days old
    assert ask(ats="lever") == ask(skills="sql,python") == ask(confidence="all") == want


@pytest.mark.parametrize("few", [0, 1000])
def test_listings_that_answer_any_question(spark, jobs, monkeypatch, few):
    monkeypatch.setattr(alerts, "FEW", few)
    for asked in (FILTERS[1:11], FILTERS[12:20], FILTERS[20:]):
        anchored = alerts._anchored(alerts.as_table(spark, [{"alert_id": str(n), "filter": f} for n, f in enumerate(asked)]), None)[1]
        assert {r["id"] for r in alerts._met(jobs, anchored, alerts._per(anchored), NOW, pairs=False).collect()} == {i for f in asked for i in plain(jobs, f, None, 1000)}


def test_only_anchors_have_postings(spark, jobs):
    table = alerts.as_table(spark, [{"alert_id": "a", "filter": {"ats": "lever"}}, {"alert_id": "b", "filter": {"company": "c1.com", "seniority": "senior"}}])
    plan = alerts.matches(jobs, table, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "attribute, ats" in plan and "attribute, company_domain" in plan and not any(f"attribute, {a}" in plan for a in ("seniority", "location", "workplace_type"))


@pytest.mark.parametrize("few", [0, 1000])
def test_slices_from_the_newest_on(spark, jobs, monkeypatch, few):
    asked = alerts.as_table(spark, [{"alert_id": str(n), "filter": f} for n, f in enumerate(FILTERS)])
    told = lambda: sorted(map(tuple, alerts.matches(jobs, asked, NOW, 7).collect()))
    want, met = told(), []
    own = alerts._met
    monkeypatch.setattr(alerts, "WHOLE", 50)
    monkeypatch.setattr(alerts, "SLICES", [1 / 8, 1 / 2])
    monkeypatch.setattr(alerts, "FEW", few)
    monkeypatch.setattr(alerts, "_met", lambda j, a, per, at: met.append(sum(per.values())) or own(j, a, per, at))
    assert told() == want and len(met) == 3 and met[0] > met[1] > met[2] > 0
