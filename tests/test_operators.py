"""Operators on hand-made listings."""

import json
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardlake.operators import alerts, evaluate, explore, facets, listing, merge, predicates, publish, search, stats
from boardlake.sources import boards
from boardlake.streaming import fragments, poll_state

NOW = datetime(2024, 1, 31)
SCHEMA = "id string, company_domain string, ats string, external_id string, title string, location string, department string, seniority string, workplace_type string, url string, posted_at timestamp, first_seen timestamp, last_seen timestamp, closed_at timestamp, confidence string, skills array<string>, description string, country array<string>, city array<string>, salary_text string, salary_is_estimate boolean, salary_source string, salary_min_ils int, salary_max_ils int, category string, role_class string"


def job(i, company="a.com", posted=1, seen=1, closed=None, **more):
    ago = lambda d: None if d is None else NOW - timedelta(days=d)
    row = dict(id=f"{i:08x}", company_domain=company, ats="lever", external_id=str(i), title=f"Job {i}", location="Haifa", department="R&D", seniority=None, workplace_type=None, url=f"u{i}", posted_at=ago(posted), first_seen=ago(seen), last_seen=ago(seen), closed_at=ago(closed), confidence="verified", skills=["python"], description="text", country=["IL"], city=["Haifa"], salary_text=None, salary_is_estimate=None, salary_source=None, salary_min_ils=None, salary_max_ils=None, category="QA", role_class=None)
    return row | more


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [
        job(1, title="Data Engineer", skills=["python", "sql"], salary_min_ils=20, salary_max_ils=30, salary_source="disclosed"), job(2, "b.com", posted=None, description="We use Data daily", country=["US", "IL"], city=["New York"]),
        job(3, "b.com", posted=400), job(4, closed=0.5, seen=20), job(5, closed=5, seen=20), job(6, confidence="best_effort"), job(7, "c.com", posted=50, title="data engineer lead", workplace_type="remote", seniority="lead"), job(8, "c.com", posted=70, seen=70, title=None, skills=None, country=None, city=None, department=None, category=None),
    ]
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def companies(spark):
    rows = [("a.com", "lever", "a", "Alpha", "l1", None, NOW), ("b.com", "lever", "b", None, "l1", "boom", NOW - timedelta(hours=2)), ("d.com", None, None, "Delta", "", None, None)]
    return spark.createDataFrame(rows, "domain string, ats string, token string, company_name string, logo_url string, error string, last_checked timestamp")


def ids(df):
    return sorted(int(r["id"], 16) for r in df.select("id").collect())


@pytest.mark.parametrize(("params", "want"), [
    ({}, [1, 2, 7, 8]), ({"include_closed": "1"}, [1, 2, 4, 5, 7, 8]), ({"include_outdated": "true"}, [1, 2, 3, 7, 8]), ({"confidence": "best_effort"}, [6]), ({"company": "b.com, c.com"}, [2, 7, 8]),
    ({"skills": "SQL,nope"}, [1]), ({"country": "us,xyz"}, [2]), ({"city": "New York"}, [2]), ({"q": "DATA"}, [1, 7]), ({"search": "data"}, [1, 2, 7]), ({"search": '"data engineer" lead'}, [7]),
    ({"search": "lead daily", "search_mode": "any"}, [2, 7]), ({"keywords": "data; use"}, [2]), ({"israel_only": "1"}, [1, 2, 7]), ({"min_age_days": "40"}, [7, 8]), ({"max_age_days": "40"}, [1]),
    ({"salary_min": "25", "salary_known": "1"}, [1]), ({"salary_min": "31"}, [2, 7, 8]), ({"salary_disclosed": "1"}, [1]), ({"ids": "00000001,zz,00000004"}, [1]), ({"workplace": "remote"}, [7]), ({"seniority": "", "skills": " , "}, [1, 2, 7, 8]),
    ({"search": "% & ' \" <b> ☃"}, []), ({"salary_min": "-5", "country": "1;drop"}, [1, 2, 7, 8])])
def test_filters(jobs, params, want):
    assert ids(jobs.where(predicates.compile_filters(params, NOW))) == want


@pytest.mark.parametrize("params", [{"confidence": "x"}, {"min_age_days": "abc"}])
def test_bad_filters_raise(spark, params):
    with pytest.raises(ValueError):
        predicates.compile_filters(params, NOW)


def test_narrowing_and_profile():
    assert not predicates.narrowing({"confidence": "all", "roles": "tech", "sort": "age", "q": " "}) and predicates.narrowing({"q": "x"})
    assert predicates.profile_params({"skills": ["a", "b"], "israel_only": True, "cities": []}) == {"skills": "a,b", "israel_only": "1"}
    assert facets.precomputed_key({"roles": "tech", "israel_only": "1"}) == "verified:tech:IL" and facets.precomputed_key({"q": "x"}) is None


def test_pages(jobs, companies):
    page = listing.page(jobs, companies, {"limit": "3"}, NOW).collect()
    assert [int(r["id"], 16) for r in page] == [1, 7, 8] and page[0]["company_name"] == "Alpha"
    assert [int(r["id"], 16) for r in listing.page(jobs, companies, {"sort": "match", "skills": "python,sql"}, NOW).collect()][0] == 1
    assert [int(r["id"], 16) for r in listing.page(jobs, companies, {"sort": "relevance", "search": "data engineer"}, NOW).collect()] == [1, 7]
    with pytest.raises(ValueError):
        listing.order({"sort": "nope"}, NOW)
    assert listing.total(jobs, {}, NOW) == 4 and listing.total(jobs, {"count": "skip"}, NOW) is None
    text = jobs.sparkSession.createDataFrame([("00000004", "blob")], "job_id string, text string")
    assert [r["description"] for r in listing.detail(jobs, text, "00000004").collect()] == ["blob"] and [r["description"] for r in listing.detail(jobs, text, "00000001").collect()] == ["text"]
    facts = {r["company_domain"]: r for r in listing.company_facts(jobs).collect()}
    assert facts["a.com"]["total"] == 4 and facts["a.com"]["open"] == 2 and facts["a.com"]["by_city"] == ["Haifa"]


def test_facets(jobs, companies):
    f = facets.compute(jobs, {"company": "c.com"}, NOW)
    assert {r["value"]: r["n"] for r in f["company"].collect()} == {"a.com": 1, "b.com": 1, "c.com": 2}
    assert {(r["country"], r["city"]): r["n"] for r in f["places"].collect()} == {("IL", "Haifa"): 1}
    assert f["disclosed"].first()["n"] == 0
    assert [r["domain"] for r in facets.company_search(jobs, companies, "AL").collect()] == ["a.com"] and facets.company_search(jobs, companies, "a").count() == 0
    assert [r["domain"] for r in facets.logo_row(jobs, companies, ["b.com"]).collect()] == ["b.com"]


def test_scope_agrees_with_page(jobs):
    for p in ({}, {"q": "data"}, {"israel_only": "1"}):
        assert stats.scoped(jobs.where(predicates.compile_filters(p, NOW)), NOW).first()["total"] == listing.total(jobs, p, NOW)


def test_stats(jobs, companies):
    t = stats.throughput(jobs, NOW).first()
    assert (t["closed_24h"], t["closed_7d"]) == (1, 2)
    rows = stats.open_rows(jobs, NOW)
    assert stats.israel_split(rows).first().asDict() == {"israel": 3, "other": 1, "total": 4}
    assert stats.skill_coverage(rows).first()["covered"] == 3 and stats.dormant(rows, NOW).first()["dormant"] == 1
    h = {str(r["day"]): r["open"] for r in stats.open_history(jobs.where("confidence = 'verified'"), NOW).collect()}
    days = [NOW - timedelta(days=k) for k in range(14)]
    raw = jobs.where("confidence = 'verified'").collect()
    assert h == {str(d.date()): sum(r["first_seen"] <= d and (r["closed_at"] is None or r["closed_at"] > d) for r in raw) for d in days}
    assert stats.pipeline_health(companies, NOW).first().asDict() == {"errors": 1, "oldest_minutes": 120, "freshness_minutes": 0}
    assert stats.name_coverage(rows, companies).first().asDict() == {"companies": 3, "named_companies": 1, "listings": 4, "named_listings": 1}
    assert stats.health(jobs, companies).first()["open"] == 6


def test_token_search(jobs):
    table = search.token_table(jobs)
    assert ids(search.search(jobs, table, "data")) == [1, 2, 7] and ids(search.search(jobs, table, '"engineer lead"')) == [7]
    assert ids(search.search(jobs, table, "dat")) == [] and ids(search.search(jobs, table, "lead daily", "any")) == [2, 7]
    changed = jobs.where("id = '00000001'").withColumn("title", F.lit("Größe"))
    again = search.changed_tokens(table, changed, changed.select("id"))
    assert ids(search.matches(again, "GROSSE".replace("SS", "ß"))) == [1]


@pytest.mark.parametrize("status", ["open", "closed", "all"])
@pytest.mark.parametrize("group", list(explore.GROUPS))
def test_builder_states_run(jobs, companies, status, group):
    mart = explore.mart(jobs, companies, NOW)
    for metric in explore.METRICS:
        state = {"status": status, "group": group, "metric": metric, "filters": [{"field": "title", "text": " "}, {"field": "odd", "values": ["'"]}, {"field": "company", "values": []}, {"field": "skill", "values": ["python"]}]}
        explore.build(state, mart).collect()


def test_explore(jobs, companies, spark):
    mart = explore.mart(jobs, companies, NOW)
    assert {r["domain"]: r["open_jobs"] for r in mart["companies"].collect()} == {"a.com": 2, "b.com": 2, "d.com": 0}
    assert {(r["field"], r["value"]): r["n"] for r in mart["facets"].collect()}["skill", "python"] == 5
    assert explore.sql(spark, mart, "select count(*) n from job_skills").first()["n"] == 8
    with pytest.raises(ValueError):
        explore.sql(spark, mart, "drop table jobs")
    assert [explore.clamp(x) for x in (0, -5, 999999, "x", 7, float("nan"))] == [25, 1, 5000, 25, 7, 25]
    assert explore.chart([("day", "string"), ("n", "bigint")], 9) == ("line", "n") and explore.chart([("ats", "string"), ("n", "bigint")], 9) == ("bar", "n")


def test_exclusive_quantiles(spark):
    for v in ([10, 20, 30, 40, 55], [1, 2], list(range(17))):
        got = spark.createDataFrame([([float(x) for x in v],)], "v array<double>").select(evaluate.band(F.col("v")).alias("b")).first()["b"]
        q = statistics.quantiles(v, n=100)
        assert (got["low"], got["high"]) == pytest.approx((q[14], q[84]))


def test_pay_model(spark):
    rows = spark.createDataFrame([(f"{i}", "x" if i % 2 else "y", "m", 100.0 + i) for i in range(40)], "id string, a string, b string, pay double")
    levels = [("ab", ["a", "b"]), ("b", ["b"])]
    got = evaluate.predict(rows, evaluate.cells(rows, levels, "pay"), levels)
    assert {r["level"] for r in got.collect()} == {"ab"}
    b = evaluate.backtest(rows, levels, "pay", "id").first()
    assert b["rows"] == 40 and b["coverage"] == 1.0 and 0.4 < b["hit_rate"] < 1


def test_merge_rules(spark):
    def frame(*rows):
        return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)

    old = frame(job(1, ats="workday", posted=9, skills=["a"], description="long", role_class="tech"), job(2, closed=3), job(3), job(4, salary_text="$1", salary_source="disclosed"), job(5, salary_text="t", salary_source="table"))
    new = frame(job(1, ats="workday", posted=2, skills=[], description=None, title="New"), job(2), job(6, salary_text="$9", salary_source="disclosed"), job(4, salary_text=None), job(5, salary_text=None))
    merged = merge.upsert(old, new, NOW)
    by = {int(r["id"], 16): r for r in merged.collect()}
    assert by[1]["posted_at"] == NOW - timedelta(days=9) and by[1]["skills"] == ["a"] and by[1]["description"] == "long" and by[1]["title"] == "New" and by[1]["role_class"] is None
    assert by[2]["closed_at"] is None and by[2]["last_seen"] == NOW and by[3]["last_seen"] != NOW and by[6]["first_seen"] == NOW
    assert by[4]["salary_text"] == "$1" and by[5]["salary_text"] is None and by[5]["salary_source"] is None
    again = merge.upsert(merged, new, NOW)
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))
    closed = merge.close_missing(merged, new, spark.createDataFrame([("a.com",)], "company_domain string"), NOW)
    assert ids(closed.where("closed_at is not null")) == [3]
    assert ids(merge.close_missing(merged, new, spark.createDataFrame([("z.com",)], "company_domain string"), NOW).where("closed_at is not null")) == []


def test_company_states(spark):
    kind = "domain string, ats string, token string, error string, first_seen timestamp, last_checked timestamp"
    old = spark.createDataFrame([("a", "lever", "t", None, NOW, None), ("b", "lever", "t", None, NOW, None), ("c", "lever", "t", None, NOW, None)], kind)
    new = spark.createDataFrame([("a", None, None, None, True, None), ("b", None, None, "later", None, True), ("c", None, None, "gone", None, False), ("d", "ashby", "x", None, None, None)], "domain string, ats string, token string, error string, unchanged boolean, retryable boolean")
    by = {r["domain"]: r for r in merge.company_states(old, new, NOW).collect()}
    assert by["a"]["ats"] == "lever" and by["a"]["last_checked"] == NOW and by["b"]["ats"] == "lever" and by["b"]["last_checked"] is None and by["c"]["ats"] is None and by["d"]["first_seen"] == NOW


def test_keyed_rules(spark, jobs, companies):
    pair = spark.createDataFrame([("acme.com", "lever", "acme"), ("acme-group.com", "lever", "acme"), ("x.com", "lever", "x")], "domain string, ats string, token string")
    assert [r["owner"] for r in merge.alias_owner(pair).collect()] == ["acme-group.com"]
    assert [r["domain"] for r in merge.stale_companies(companies, pair.limit(0)).orderBy("domain").collect()] == ["a.com", "b.com", "d.com"]
    state = spark.createDataFrame([(f"d{i}", None if i == 3 else NOW - timedelta(hours=i), 300, None) for i in range(20)], "domain string, next_at timestamp, interval_s int, last_change timestamp")
    assert [r["domain"] for r in merge.due(state, NOW, 2).collect()] == ["d3", "d19"]
    assert merge.prune(state, state.where("domain <> 'd1'")).count() == 19
    with pytest.raises(ValueError):
        merge.prune(state, state.limit(3))
    parts = [companies.select("domain", "last_checked"), companies.select("domain", (F.col("last_checked") + F.expr("interval 1 day")).alias("last_checked"), F.lit(1).alias("extra"))]
    assert {r["extra"] for r in merge.merge_partitions(parts).where("last_checked is not null").collect()} == {1}
    boards_ = spark.createDataFrame([("a", "t1", 0, None), ("a", "t2", 5, NOW - timedelta(days=400)), ("a", "t3", 2, NOW)], "domain string, token string, job_count int, newest timestamp")
    assert merge.best_board(boards_, NOW).first()["token"] == "t3"
    polls = spark.createDataFrame([("d0", True, False, NOW), ("d1", False, False, NOW), ("d2", False, True, NOW)], "domain string, changed boolean, failed boolean, polled_at timestamp")
    got = {r["domain"]: r["interval_s"] for r in poll_state.record(state, polls, polls.limit(0).select("domain")).collect()}
    assert got["d0"] == 300 and got["d1"] == 450 and got["d2"] == 300


def test_alerts(jobs):
    asked = [{"alert_id": "x", "filter": {"company": "c.com"}, "last_notified_at": NOW - timedelta(days=30)}, {"alert_id": "y", "filter": {}, "last_notified_at": NOW - timedelta(days=2)}]
    got = alerts.new_matches(jobs, asked, NOW)
    assert sorted((r["alert_id"], int(r["id"], 16)) for r in got.collect()) == [("x", 7), ("y", 1), ("y", 2), ("y", 7)]
    assert {r["alert_id"]: r["n"] for r in alerts.digest(got).collect()} == {"x": 1, "y": 3}
    assert {r["domain"] for r in alerts.watched(jobs, asked, NOW).collect()} == {"a.com", "b.com", "c.com"}
    assert alerts.new_matches(jobs, [], NOW).count() == 0


def test_exports(jobs, tmp_path, spark):
    old, rest = publish.archived(jobs, NOW + timedelta(days=29))
    assert ids(old) == [5] and rest.count() == 7
    publish.write_archive(old, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).first()["closed_month"] == "2024-01"
    publish.write_csv(jobs.select("id", "title").where("id in ('00000001', '00000008')").coalesce(1), str(tmp_path / "c"))
    raw = next((tmp_path / "c").glob("part*")).read_bytes()
    assert raw.startswith("﻿id,title\r\n".encode()) and b"00000008,\r\n" in raw
    assert json.loads(jobs.where("id = '00000001'").select(publish.json_ld().alias("j")).first()["j"])["title"] == "Data Engineer"
    assert publish.sitemap(jobs, "https://x", 3).where("xml like '<url><loc>https://x/job/%'").count() == 6 and publish.feed(jobs, 2).count() == 2
    publish.write_version(jobs, str(tmp_path / "v"), 1)
    with pytest.raises(Exception, match="exists"):
        publish.write_version(jobs, str(tmp_path / "v"), 1)


def test_boards(spark):
    rows = [
        ("a.com", "greenhouse", "a", json.dumps({"jobs": [{"id": 1, "title": "T", "location": {"name": "X"}, "absolute_url": "u", "updated_at": "2024-01-02T00:00:00Z"}, {"id": 1, "title": "T", "location": {"name": "X"}, "updated_at": "2024-01-01T00:00:00Z"}]}), True),
        ("b.com", "lever", "b", json.dumps([{"id": "q", "text": "L", "createdAt": 1700000000000, "categories": {"location": "Y", "team": "Z"}, "workplaceType": "Remote"}]), True),
        ("c.com", "workday", "c", json.dumps({"jobPostings": [{"title": "W", "externalPath": "/p", "locationsText": "Q", "postedOn": "Posted 3 Days Ago"}]}), True),
        ("d.com", "recruitee", "d", json.dumps({"offers": [{"id": 3, "title": "R", "remote": True, "on_site": True, "published_at": "2024-01-02 03:04:05 UTC"}]}), True),
        ("e.com", "personio", "e", "<positions><position><id>7</id><name><![CDATA[P]]></name><office>O1</office><additionalOffices><office>O2</office></additionalOffices></position></positions>", True),
        ("f.com", "schema.org", "f", '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"G","url":"u","datePosted":"2024-01-05"}]}</script>', True),
        ("g.com", "lever", "g", "not json", True),
    ]
    caps = spark.createDataFrame(rows, "domain string, ats string, token string, payload string, complete boolean")
    g = boards.parse(caps, "greenhouse").collect()
    assert len(g) == 1 and g[0]["posted_at"] == datetime(2024, 1, 1)
    lever = boards.parse(caps, "lever").collect()
    assert len(lever) == 1 and lever[0]["workplace_type"] == "remote" and lever[0]["department"] == "Z"
    assert boards.parse(caps, "workday", F.lit(NOW)).first()["posted_at"] == NOW - timedelta(days=3)
    assert boards.parse(caps, "recruitee").first()["workplace_type"] == "remote"
    assert boards.parse_xml(caps).first()["location"] == "O1, O2" and boards.parse_json_ld(caps).first()["title"] == "G"
    cards = spark.createDataFrame([("h.com", "checkpoint", "h", "<p>2 jobs</p><div class=c id=1>A</div><div class=c id=2>B</div>", True)], caps.schema)
    got = boards.parse_cards(cards, "checkpoint", r"<div class=c.*?</div>", {"external_id": r"id=(\d+)", "title": r">(.*?)<"}, r"(\d+) jobs")
    assert [r["title"] for r in got.orderBy("title").collect()] == ["A", "B"]
    for kind in boards.SPECS:
        boards.parse(caps, kind, F.lit(NOW)).collect()
    assert boards.fingerprint(boards.parse(caps, "lever")).count() == 1


def test_stream_equals_batch(spark, jobs, tmp_path):
    """Fragments replayed as a stream, twice over, give what one batch gives."""
    log = tmp_path / "log"
    for k in range(3):
        jobs.withColumn("title", F.lit(f"v{k}")).where(F.col("id") > f"0000000{k}").coalesce(1).write.mode("append").json(str(log))
    out: dict[int, object] = {}

    def handle(batch, number):
        merged = fragments.apply_batch(out.get(number - 1, jobs), batch, NOW)
        out[number] = spark.createDataFrame(merged.collect(), jobs.schema)

    stream = fragments.fragments(spark, str(log), jobs.schema)
    fragments.run_once(stream, handle, str(tmp_path / "c1")).awaitTermination()
    everything = spark.read.schema(jobs.schema).json(str(log)).withColumn("_fragment", F.input_file_name())
    want = fragments.apply_batch(jobs, everything, NOW)
    assert sorted(map(str, out[max(out)].collect())) == sorted(map(str, want.collect()))
