"""Scalar functions on hand-made values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boardlake.functions import dates, money, places, roles, salary, skills, status, taxonomy, text
from boardlake.operators import placing

NOW = datetime(2024, 1, 31)


def values(spark, fn, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def placed(spark, how, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, location string")
    return [r["y"] for r in how(df, placing.gazetteer(spark), name="y").orderBy("i").collect()]


def test_categories(spark):
    got = values(spark, lambda c: taxonomy.category(F.lit(None).cast("string"), c), "Security Analyst", "Data Engineer", "DevOps", "QA", "Backend", "Executive Assistant", "", None)
    assert got == ["Security", "Data & AI", "Infrastructure", None, "Software Engineering", None, None, None]


def test_seniority_and_workplace(spark):
    assert values(spark, taxonomy.seniority, "VP of Sales", "Senior Staff Engineer", "Team Leader", "International Sales", "Sr. Dev", None) == ["exec", "staff", "lead", None, "senior", None]
    assert values(spark, taxonomy.workplace, "Remote / Hybrid", "On-site", "Haifa") == ["remote", "onsite", None]
    assert values(spark, lambda c: taxonomy.coded(c, taxonomy.WORKPLACE_CODES), " On-Site ", "moon") == ["onsite", None]


def test_dates(spark):
    assert values(spark, dates.normalized, "1700000000000", "2024-01-02 03:04:05 UTC", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05Z", "soon", "", None) == [
        datetime(2023, 11, 14, 22, 13, 20), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 1, 4, 5), datetime(2024, 1, 2, 3, 4, 5), None, None, None]
    rel = values(spark, lambda c: dates.relative(c, F.lit(NOW)), "Posted Today", "Posted Yesterday", "Posted 30+ Days Ago", "whenever", None)
    assert rel == [None, datetime(2024, 1, 30), datetime(2024, 1, 1), None, None]
    assert values(spark, dates.local_to_utc, "2024-03-29T01:59:59", "2024-03-30T10:00:00", "2024-12-01T10:00:00", "2024-12-01T10:00:00Z") == [
        datetime(2024, 3, 28, 23, 59, 59), datetime(2024, 3, 30, 7), datetime(2024, 12, 1, 8), datetime(2024, 12, 1, 10)]
    assert [str(x) for x in values(spark, dates.written, "31/12/2023", "January 5, 2024", "x")] == ["2023-12-31", "2024-01-05", "None"]
    assert values(spark, lambda c: dates.age_phrase(c.cast("timestamp"), F.lit(NOW)), "2024-01-31", "2024-01-30", "2024-01-01", "2023-10-01") == ["today", "1 day ago", "30 days ago", "4 months ago"]
    assert values(spark, lambda c: dates.week_key(c.cast("timestamp")), "2024-01-01", "2023-01-01", "2023-01-02") == ["2024-W01", "2023-W00", "2023-W01"]


def test_text(spark):
    html = "<h2>Role &amp; team</h2><p><strong>What</strong></p><ul><li>one<li>two</ul>  a   b &lt;p&gt;c"
    assert values(spark, text.clean_text, html, "", None) == ["## Role & team\n\n## What\n\n- one\n- two\na b\nc", None, None]
    assert text.search_terms('senior "data engineer" c++') == (["senior", "data engineer", "c++"], [])
    assert text.search_terms(" ".join(map(str, range(12))))[1] == ["10", "11"]
    assert text.index_safe("java") and not text.index_safe("c++")
    assert values(spark, text.flat, '{"name": "a"}', '["a", {"name": "b"}]', "plain") == ["a", "a, b", "plain"]
    assert values(spark, text.clean_company_name, "Careers at Acme, Inc.", "Acme | Jobs", "") == ["Acme", "Acme", None]
    assert values(spark, text.real_logo, "http://x/Placeholder.png", "http://x/l.png") == ["", "http://x/l.png"]
    assert values(spark, text.token_candidates, "my-shop.co.il") == [["my-shop", "myshop", "my-shopcoil"]]


def test_content_hash_ignores_order(spark):
    kind = "array<struct<external_id:string,title:string,location:string,url:string>>"
    a, b, c = values(spark, text.content_hash, [("1", "t", "l", "u"), ("2", "t", "l", "u")], [("2", "t", "l", "u"), ("1", "t", "l", "u")], [("2", "t", "l", "x")], kind=kind)
    assert a == b != c


@pytest.mark.parametrize(("pay", "want"), [
    ("$120K – $150,000 • bonus $10K", ("$", 120_000.0, 150_000.0)), ("$50 per hour", ("$", 104_000.0, 104_000.0)), ("£4,000 per month", ("£", 48_000.0, 48_000.0)),
    ("$100K or €90K", None), ("R$100K", None), ("$12", None), (None, None), ("none", None)])
def test_disclosed_pay(spark, pay, want):
    got = values(spark, money.disclosed, pay)[0]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("pay", "want"), [("₪35K–45K", (35_000, 45_000)), ("₪420,000 per year", (35_000, 35_000)), ("₪60 per hour", None), ("₪35K or $9K", None), ("₪1K", None), ("35K", None)])
def test_monthly_shekels(spark, pay, want):
    got = values(spark, money.monthly_shekels, pay)[0]
    assert (tuple(got) if got else None) == want


def test_places(spark):
    assert values(spark, places.metro, "Remote - London", "Remote, United States", "Remote", "SF Bay Area", "Haifa") == ["uk", "us-remote", None, "us-sf", "il"]
    assert placed(spark, placing.countries, "Tel Aviv, Israel; Remote, Israel", "Berlin / Paris", "de", "New York, USA", None, "Moon") == [["IL"], ["DE", "FR"], ["DE"], ["US"], [], []]
    assert placed(spark, placing.cities, "Tel-Aviv, Israel; Haifa", "Greater London", None) == [["Tel Aviv", "Haifa"], ["London"], []]
    assert values(spark, places.country_label, "GB", "MV") == ["United Kingdom", "MV"]


def test_skills(spark):
    text_ = "Experience with Go and Python.\nI like to Go to the sea. Skills: R, SQL\nno experience with Java required"
    assert values(spark, lambda c: skills.skills_udf()(c), text_, None) == [["Go", "Python", "R", "SQL"], []]
    assert skills.normalize("P Y T H O N pro-\ngramming – ﬁne") == "PYTHON programming - fine"


def test_roles(spark):
    rows = [(1, "a", "Software Engineer", "R&D", ["python"], None), (2, "a", "Data Engineer", None, [], None), (3, "a", "Sales Manager", "Sales", [], None), (4, "b", "Truck Driver", None, [], None), (5, "b", None, None, None, None), (6, "a", "Recruiter", None, [], None)]
    df = spark.createDataFrame(rows, "id int, company_domain string, title string, department string, skills array<string>, closed_at timestamp")
    got = {r["id"]: r for r in roles.two_pass(df).collect()}
    assert [got[i]["role_class"] for i in (1, 2, 4, 5)] == ["tech", "tech", "non-tech", "unknown"]
    assert got[3]["role_class"] == "tech" and "company-tech" in got[3]["role_evidence"] and -1 <= got[3]["role_score"] <= 0.2


def test_status_and_digest(spark):
    df = spark.createDataFrame([(True, None, None), (False, None, None), (True, "x", None), (True, None, datetime(2023, 12, 1)), (True, None, datetime(2024, 1, 20))], "e boolean, a string, c timestamp")
    assert [r[0] for r in df.select(status.page_status(F.col("e"), F.col("a"), F.col("c"), F.lit(NOW))).collect()] == [200, 404, 301, 410, 200]
    rows = [("instant", datetime(2024, 1, 31), None, None, None), ("daily", datetime(2024, 1, 30, 9), "08:00", "UTC", None), ("daily", datetime(2024, 1, 30, 7), "08:00", "UTC", None), ("weekly", datetime(2024, 1, 28), "08:00", "UTC", 0), ("weekly", datetime(2024, 1, 30), "bad", None, 0)]
    df = spark.createDataFrame(rows, "c string, s timestamp, t string, z string, d int")
    assert [r[0] for r in df.select(status.digest_due(F.col("c"), F.col("s"), F.lit(NOW), F.col("t"), F.col("z"), F.col("d"))).collect()] == [True, False, True, True, False]


def test_pay_table(spark):
    jobs = spark.createDataFrame([(1, "Backend Developer", "senior"), (2, "Backend Developer", None), (3, "Backend Developer", "exec"), (4, "Baker", None)], "id int, title string, seniority string")
    pay = spark.createDataFrame([("backend", "3-5", 20.0, 30.0), ("backend", "5-8", 1.0, 99.0)], "role string, band string, low double, high double")
    got = {r["id"]: r["est_low"] for r in salary.table_estimate(jobs, pay, [("backend", ["backend"])]).collect()}
    assert got == {1: 20.0, 2: 20.0, 3: None, 4: None}


def test_pay_table_refines_generic_roles_and_hides_wide_ranges(spark):
    rows = [(1, "Backend Developer", "Python and Java", "mid"), (2, "Python Developer", "java", "mid"), (3, "Designer", "python", "mid"), (4, "Backend Developer", "", "lead"), (5, "Backend Developer", None, "junior"), (6, None, "python", "mid"), (7, "Backend Developer", "security", "director")]
    jobs = spark.createDataFrame(rows, "id int, title string, description string, seniority string")
    pay = spark.createDataFrame([("backend", "0-2", 10.0, 21.0), ("backend", "3-5", 20.0, 40.0), ("backend", "mgmt", None, 9.0), ("python", "3-5", 5.0, 6.0), ("python", "3-5", 30.0, 31.0), ("java", "3-5", 40.0, 41.0)], "role string, band string, low double, high double")
    roles = [("python", ["python"]), ("java", ["java"]), ("backend", ["backend"])]
    got = {r["id"]: (r["est_low"], r["est_high"]) for r in salary.table_estimate(jobs, pay, roles).collect()}
    assert got == {1: (30.0, 31.0), 2: (30.0, 31.0), 3: (None, None), 4: (20.0, 40.0), 5: (None, None), 6: (None, None), 7: (None, None)}
    assert salary.table_estimate(jobs.limit(0), pay.limit(0), roles).collect() == []
