"""All facets of many questions from one scan: equal to each facet by itself, and what the plan reads."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boardlake.operators import facets, listing, publish
from test_operators import SCHEMA, job

NOW = datetime(2024, 1, 31)
ASKED = {publish.facets.precomputed_key(p): p for p in publish.VARIANTS} | {
    "narrow": {"ats": "lever", "department": "QA", "salary_min": "25", "country": "IL"}, "words": {"search": "data", "seniority": "lead", "salary_known": "1"}, "nothing": {"company": "none.com"}, "old": {"include_closed": "1", "include_outdated": "1", "confidence": "all", "salary_disclosed": "1", "city": "Haifa"},
}


@pytest.fixture(scope="module")
def jobs(spark):
    rng, rows = random.Random(4), []
    pick = rng.choice
    for i in range(500):
        pay = rng.randrange(10, 60)
        rows.append(job(i, pick(["a.com", "b.com", "c.com", ""]), posted=pick([1, 30, 400, None]), closed=pick([None, None, 3]), ats=pick(["lever", "ashby", None]), category=pick(["QA", "Data", " ", None]), seniority=pick(["lead", None]), workplace_type=pick(["remote", "hybrid"]), title=pick(["Data", "Cook", None]),
            country=pick([["IL"], ["US", "IL"], [""], [], None]), city=pick([["Haifa"], ["Haifa", "Jaffa"], ["", "Eilat"], None]), salary_min_ils=pay if i % 3 else None, salary_max_ils=pay + i % 7 if i % 3 and i % 5 else None, salary_source=pick(["disclosed", "table", None]), confidence=pick(["verified", "best_effort"]), role_class=pick(["tech", None])))
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def test_one_scan_gives_what_each_facet_gives(jobs):
    got = {}
    for r in facets.all_facets(jobs, ASKED, NOW).orderBy("variant", "name", F.desc("n"), "value", "rank").collect():
        got.setdefault((r["variant"], r["name"]), []).append(r)
    for variant, params in ASKED.items():
        want = facets.compute(jobs, params, NOW)
        for name in (*facets.SCALAR, "country"):
            assert [(r["value"], r["n"]) for r in got.get((variant, name), [])] == [tuple(r) for r in want[name].collect()], (variant, name)
        assert sorted((r["value"], r["n"], r["part"], r["part_n"]) for r in got.get((variant, "places"), [])) == sorted((r["country"], r["country_n"], r["city"], r["n"]) for r in want["places"].collect())
        (pay,), told = got[variant, "pay"], want["pay"].first()
        assert (pay["low"], pay["high"], pay["n"], None if pay["part"] is None else float(pay["part"])) == (told["low"], told["high"], told["known"], told["median"]), variant
        assert got[variant, "disclosed"][0]["n"] == want["disclosed"].first()["n"]


def test_limits_of_facets(jobs, monkeypatch):
    for name in ("LIMIT", "COUNTRIES", "COMPANIES", "TREE_COUNTRIES", "TREE_CITIES"):
        monkeypatch.setattr(facets, name, 1)
    got = facets.all_facets(jobs, {"all": {"confidence": "all"}}, NOW).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got} == dict.fromkeys([*facets.SCALAR, "country", "places", "pay", "disclosed"], 1)


def test_the_listings_are_read_once(spark, jobs, tmp_path):
    jobs.write.parquet(str(tmp_path / "jobs"))
    plan = facets.counts(spark.read.parquet(str(tmp_path / "jobs")), ASKED, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "description" in plan


def test_no_listing(jobs):
    assert {r["name"] for r in facets.all_facets(jobs.limit(0), {"x": {}}, NOW).collect()} == {"pay", "disclosed"}


def test_stored_answers(jobs):
    got = {(r["key"], r["name"]): json.loads(r["answer"]) for r in publish.precomputed(jobs, NOW, [{"confidence": "verified"}, {"confidence": "all"}]).collect()}
    want = facets.compute(jobs, {"confidence": "all"}, NOW)
    assert [(x["value"], x["n"]) for x in got["all", "category"]] == [tuple(r) for r in want["category"].collect()]
    assert got["all", "pay"][0]["known"] == want["pay"].first()["known"] and {k for k, _ in got} == {"verified", "all"} and ("all", "stats") in got
    assert [(x["country"], x["city"]) for x in got["all", "places"]][:1] == [("IL", "Haifa")]


def test_a_page_asks_for_its_own_companies(spark, jobs):
    companies = spark.createDataFrame([(f"{c}.com", f"Name {c}") for c in "abcdef"], "domain string, company_name string")
    page = listing.page(jobs, companies, {"limit": "5"}, NOW)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [domain") < plan.index("LeftSemi") and {r["company_name"] for r in page.collect()} <= {"Name a", "Name b", "Name c", None}
    assert page.count() == 5
