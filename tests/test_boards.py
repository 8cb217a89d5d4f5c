"""A captured payload of every kind of board, and what comes of it."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boardlake.sources import boards

NOW = datetime(2024, 1, 31)
GOOGLE_ROW = ["91", "Signal/Power Engineer, PhD", None, [None, "<p>must</p>"], None, None, None, None, None, [["Tel Aviv, Israel", None, None, None, None, "IL"], ["Paris", None, None, None, None, "FR"]], [None, "<p>what</p>"], None, [1700000000]]
#: kind -> (token, payload, what a row must hold)
CAPTURES = {
    "greenhouse": ("acme", {"jobs": [{"id": 7, "internal_job_id": 3, "title": "T", "location": {"name": "X"}, "first_published": "2024-01-02", "updated_at": "2024-01-05T00:00:00Z", "departments": [{"name": "D"}], "content": "&lt;p&gt;a&amp;nbsp;b&lt;/p&gt;"}, {"id": 6, "internal_job_id": 3, "title": "T", "location": {"name": "X"}, "first_published": "2024-01-03", "updated_at": "2024-01-01T00:00:00Z"}]},
                   {"external_id": "7", "url": "https://job-boards.greenhouse.io/embed/job_app?for=acme&token=7", "posted_at": datetime(2024, 1, 5), "department": "D"}),
    "lever": ("t", [{"id": "q", "text": "L", "descriptionPlain": "intro", "lists": [{"text": "Must", "content": "<li>x</li>"}], "additionalPlain": "end", "createdAt": 1700000000000, "categories": {"location": "Y", "team": "Z"}, "workplaceType": "Remote"}], {"description": "intro\n\nMust\n\n- x\n\nend", "workplace_type": "remote", "department": "Z"}),
    "ashby": ("t", {"jobs": [{"id": "a", "title": "A", "compensation": {"scrapeableCompensationSalarySummary": "$1K", "compensationTierSummary": "$2K"}}]}, {"salary_text": "$1K"}),
    "workable": ("t", {"jobs": [{"shortcode": "s", "title": "W", "city": "Haifa", "country": "Israel", "published_on": "2024-01-02"}]}, {"location": "Haifa, Israel", "external_id": "s"}),
    "recruitee": ("t", {"offers": [{"id": 3, "title": "R", "hybrid": True, "on_site": True, "published_at": "2024-01-02 03:04:05 UTC"}]}, {"workplace_type": "hybrid", "posted_at": datetime(2024, 1, 2, 3, 4, 5)}),
    "smartrecruiters": ("co", {"content": [{"id": "9", "name": "S", "location": {"city": "Berlin", "country": "de", "remote": False, "hybrid": False}, "experienceLevel": {"id": "entry_level"}}]}, {"location": "Berlin, de", "workplace_type": "onsite", "seniority": "junior", "url": "https://jobs.smartrecruiters.com/co/9"}),
    "pinpoint": ("t", {"data": [{"id": 1, "title": "P", "location": {"city": "Slough", "province": "Berkshire", "name": "Berks"}, "description": "one", "benefits": "two", "benefits_header": "Perks", "compensation_visible": True, "compensation_minimum": 5, "compensation": "$5 / year"}, {"id": 2, "title": "Q", "location": {"name": "DC"}, "compensation_visible": True, "compensation": "Competitive"}]},
                 {"location": "Slough, Berkshire", "description": "one\n\n## Perks\ntwo", "salary_text": "$5 / year"}),
    "bamboohr": ("co", {"result": [{"id": 4, "jobOpeningName": "Nurse", "location": {"city": "Austin", "state": "Texas"}, "isRemote": True}]}, {"location": "Austin, Texas", "url": "https://co.bamboohr.com/careers/4", "workplace_type": "remote"}),
    "breezy": ("t", [{"id": "b", "name": "B", "location": {"city": "C", "state": {"name": "S"}, "country": {"name": "N"}}}], {"location": "C, S, N"}),
    "niloosoft": ("h.co:slug", [{"jobId": 5, "jobTitle": "N", "area": "צפון", "status": 1, "openDate": "2024-01-02T00:00:00Z", "description": "a", "requirements": "b"}, {"jobId": 6, "jobTitle": "closed", "status": 2}], {"location": "צפון, Israel", "url": "https://h.co/?jobId=5", "description": "a b"}),
    "ness": ("n.co", {"allOrderDetailsList": [{"index": 8, "title": "N", "posLocation": "", "lastUpdated": "28/07/2026", "profName": "QA", "posDescription": "d"}]}, {"location": "Israel", "posted_at": datetime(2026, 7, 28), "url": "https://n.co/careers/job/8"}),
    "amazon": ("t", {"jobs": [{"id_icims": "1", "title": "A", "job_path": "/en/jobs/1", "posted_date": "January 5, 2024"}]}, {"url": "https://www.amazon.jobs/en/jobs/1", "posted_at": datetime(2024, 1, 5)}),
    "microsoft": ("", {"data": {"count": 1, "positions": [{"id": 11, "name": "M", "locations": ["Israel, Tel Aviv, Herzliya", "Israel, Multiple Locations"], "positionUrl": "/p/11", "postedTs": 1700000000, "workLocationOption": "hybrid"}]}}, {"location": "Herzliya, Tel Aviv, Israel; Israel", "url": "https://apply.careers.microsoft.com/p/11", "workplace_type": "hybrid"}),
    "google": ("il", "<script>AF_initDataCallback({key: 'ds:1', hash: '3', data:" + json.dumps([[GOOGLE_ROW], None, 1]) + ", sideChannel: {}});</script>", {"external_id": "91", "location": "Tel Aviv, Israel", "description": "what\n\nmust", "url": "https://www.google.com/about/careers/applications/jobs/results/91-signalpower-engineer-phd"}),
    "apple": ("t", {"res": {"searchResults": [{"positionId": "20", "postingTitle": "A", "transformedPostingTitle": "a", "locations": [{"name": "Haifa", "countryName": "Israel"}], "team": {"teamName": "HW"}, "jobSummary": "s", "responsibilities": "r"}]}}, {"location": "Haifa, Israel", "department": "HW", "description": "s\n\nResponsibilities\nr", "url": "https://jobs.apple.com/en-il/details/20/a"}),
    "oracle": ("h.co:CX", {"items": [{"requisitionList": [{"Id": "30", "Title": "O", "PrimaryLocation": "A", "secondaryLocations": [{"Name": "B"}, {"Name": "A"}], "WorkplaceTypeCode": "ORA_HYBRID", "PostedDate": "2024-01-03"}]}]}, {"location": "A; B", "workplace_type": "hybrid", "url": "https://h.co/hcmUI/CandidateExperience/en/sites/CX/job/30"}),
    "eightfold": ("t", {"positions": [{"id": 1, "name": "E", "locations": ["X", "Y"], "t_update": 1700000000}]}, {"location": "X; Y", "posted_at": datetime(2023, 11, 14, 22, 13, 20)}),
    "redmatch": ("r.co/x:aff", {"count": 2, "positions": [{"compPositionID": "40", "jobTitleText": " R ", "displayLocation": "Lod", "activationDate": "2024-12-01T10:00:00", "fieldDesc": "IT"}, {"compPositionID": "41", "jobTitleText": "off", "isActivePosition": False}]}, {"title": "R", "location": "Lod, Israel", "posted_at": datetime(2024, 12, 1, 8), "url": "https://r.co/x/redmatch-apply/redmatch.apply.html?compPositionID=40"}),
    "wprest": ("w.co:job:Israel", [{"id": 50, "title": {"rendered": "W"}, "link": "l", "date": "2024-01-02T00:00:00", "region": [1, 2], "job-category": [9], "content": {"rendered": "<p>c</p>"}}], {"external_id": "50", "location": "Israel", "description": "c"}),
    "tycowp": ("y.co", [{"id": 60, "tl": "T", "ct": "Lod", "tp": boards.STUDENT_POST, "jc": "F", "dc": "d"}], {"location": "Lod, Israel", "seniority": "intern", "url": "https://y.co/job/60", "department": "F"}),
    "comeet": ("t", [{"uid": "70", "name": "C", "careers_page_active_url": "https://c.co/careers/", "careers_page_url": "https://comeet/70", "experience_level": "Senior"}], {"url": "https://comeet/70", "seniority": "senior"}),
    "workday": ("t", {"jobPostings": [{"title": "W", "externalPath": "/p", "locationsText": "Q", "postedOn": "Posted 3 Days Ago"}]}, {"posted_at": datetime(2024, 1, 28), "external_id": "/p"}),
    "teamtailor": ("t", {"items": [{"id": "u", "url": "https://t.teamtailor.com/jobs/80-x", "title": "TT", "date_published": "2024-01-02T00:00:00Z", "content_html": "<p>b</p>"}]}, {"external_id": "80", "description": "b"}),
}


@pytest.fixture(scope="module")
def captures(spark):
    rows = [(f"{kind}.com", kind, token, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False), True) for kind, (token, p, _) in CAPTURES.items()]
    rows += [("bad.com", kind, "t", "not json", True) for kind in CAPTURES] + [("demo.com", "bamboohr", "t", json.dumps({"result": [{"id": 1, "jobOpeningName": "Marketing Manager"}, {"id": 2, "jobOpeningName": "Software Engineer"}]}), True)]
    return spark.createDataFrame(rows, "domain string, ats string, token string, payload string, complete boolean")


def test_every_kind_has_a_capture():
    assert set(CAPTURES) == set(boards.SPECS)


@pytest.mark.parametrize("kind", list(CAPTURES))
def test_kind(captures, kind):
    rows = sorted(boards.parse(captures, kind, F.lit(NOW)).collect(), key=lambda r: r["external_id"])
    assert len(rows) == (2 if kind == "pinpoint" else 1) and {r["domain"] for r in rows} == {f"{kind}.com"}
    assert {k: rows[0][k] for k in CAPTURES[kind][2]} == CAPTURES[kind][2]
    if kind == "pinpoint":
        assert rows[1]["location"] == "DC" and rows[1]["salary_text"] is None


def test_the_first_posting_of_an_id_counts(spark):
    rows = [("r.com", "workable", "t", json.dumps({"jobs": [{"shortcode": "s", "title": t} for t in ("one", "two", "one")]}), True)]
    got = boards.parse(spark.createDataFrame(rows, "domain string, ats string, token string, payload string, complete boolean"), "workable")
    assert [(r["external_id"], r["title"]) for r in got.collect()] == [("s", "one")]
    same = {"id": 5, "updated_at": "2024-01-02T00:00:00Z"}
    rows = [("g.com", "greenhouse", "t", json.dumps({"jobs": [same | {"title": t} for t in order]}), True) for order in (("b", "a"), ("a", "b"))]
    for row in rows:
        got = boards.parse(spark.createDataFrame([row], "domain string, ats string, token string, payload string, complete boolean"), "greenhouse")
        assert [r["title"] for r in got.collect()] == ["a"]


def test_terms_and_lines(captures, spark):
    terms = spark.createDataFrame([("wprest.com", "region", 1, "Gush Dan", "place"), ("wprest.com", "region", 2, "North", "place"), ("wprest.com", "job-category", 9, "QA", "field"), ("wprest.com", "region", 3, "unused", "place")], "domain string, taxonomy string, term_id long, name string, kind string")
    got = boards.with_terms(boards.parse(captures, "wprest"), terms).first()
    assert got["location"] == "Gush Dan; North, Israel" and got["department"] == "QA"
    html = '<a href="https://t.teamtailor.com/jobs/80-x" class="q"><span>TT</span></a> <div class="m"><span>R&amp;D</span> · <span>Haifa</span> · Fully Remote</div>'
    pages = spark.createDataFrame([("teamtailor.com", html)], "domain string, html string")
    assert boards.with_places(boards.parse(captures, "teamtailor"), pages).first()["location"] == "R&D, Haifa, Fully Remote"


def test_inactive_pages_are_misses(spark):
    pages = spark.createDataFrame([("a", "jazz", "t", "<div class=c>A</div>", True), ("b", "jazz", "t", "This board is inactive <div class=c>B</div>", True)], "domain string, ats string, token string, payload string, complete boolean")
    got = boards.parse_cards(pages, "jazz", r"<div class=c>.*?</div>", {"title": r">(.*?)<"}, miss="(?i)board is inactive")
    assert [r["title"] for r in got.collect()] == ["A"]


def test_fingerprint_follows_size_and_newest(spark):
    row = lambda i, d="a": (d, "lever", "t", str(i), datetime(2024, 1, 1 + i % 28))
    kind = "domain string, ats string, token string, external_id string, posted_at timestamp"
    of = lambda rows: boards.fingerprint(spark.createDataFrame(rows, kind), newest=3).first()["content_hash"]
    base = [row(i) for i in range(10)]
    assert of(base) == of(base[::-1]) != of(base + [row(11)]) and of(base) != of([row(20)] + base[1:])


def test_xml_feeds(spark):
    feed = """<?xml version="1.0"?><w:jobs xmlns:w="urn:x">
    <w:position><w:id> 7 </w:id><w:office>Berlin</w:office><w:additionalOffices><w:office>Wien</w:office><w:office> </w:office><w:office>Berlin</w:office></w:additionalOffices><w:name><![CDATA[ R & D <Lead> ]]></w:name><w:createdAt>2024-01-05T10:00:00+00:00</w:createdAt></w:position>
    <w:position><w:id/><w:name>No id</w:name><w:department>X</w:department></w:position></w:jobs>"""
    rows = [("a", feed), ("b", "<jobs><position><id>1</id>"), ("c", "<jobs></jobs>"), ("d", "no feed"), ("e", None)]
    caps = spark.createDataFrame([(d, "personio", d, p, True) for d, p in rows], "domain string, ats string, token string, payload string, complete boolean")
    got = {r["title"]: r for r in boards.parse_xml(caps).collect()}
    one = got["R & D <Lead>"]
    assert (one["external_id"], one["location"], one["url"], str(one["posted_at"])) == ("7", "Berlin, Wien, Berlin", "https://a.jobs.personio.de/job/7", "2024-01-05 10:00:00")
    assert got["No id"]["url"] is None and got["No id"]["location"] is None and got["No id"]["department"] == "X" and len(got) == 2
    assert {r["domain"] for r in boards.broken_feeds(caps).collect()} >= {"b"} and "a" not in {r["domain"] for r in boards.broken_feeds(caps).collect()}


def test_pins_and_hints(spark, tmp_path):
    (tmp_path / "pins").mkdir()
    (tmp_path / "pins/a.yml").write_text('# top\ncomeet:\n  - domain: yes.co.il\n    uid: "91.001"  # quoted\n    token: 01\n    jobs_seen: 6\n\n  - uid: "no domain"\n  - domain: twice.com\n    token: old\n  - domain: twice.com\n    token: \'new\'\n    jobs_seen: lots\nlever:\n  - domain: b.com\n    token: yes   # kept as text\n')
    (tmp_path / "pins/empty.yml").write_text("")
    got = sorted(tuple(r) for r in boards.read_pins(spark, str(tmp_path / "pins")).collect())
    assert got == [("comeet", "twice.com", None, "new", 0), ("comeet", "yes.co.il", "91.001", "01", 6), ("lever", "b.com", None, "yes", None)]
    (tmp_path / "hints").mkdir()
    (tmp_path / "hints/a.json").write_text('[{"domain": "a.com", "ats": "lever", "token": "t"}, {"domain": "b.com", "ats": null, "token": "x"}, {"domain": ""}]')
    (tmp_path / "hints/broken.json").write_text("[{")
    assert [tuple(r) for r in boards.read_hints(spark, str(tmp_path / "hints")).collect()] == [("a.com", "lever", "t")]


def test_a_board_is_shuffled_once_and_texts_are_cleaned_where_asked(spark):
    """Postings of a board stay with it while repeated jobs are found, and no text is cleaned for a question that does not ask for texts."""
    job = '{"id": %d, "internal_job_id": %d, "title": "T", "location": {"name": "P"}, "first_published": "2024-01-0%d", "updated_at": "2024-01-05T00:00:00Z", "content": "&lt;p&gt;body %d&lt;/p&gt;"}'
    rows = [("a", job % (k, k // 2, 9 - k, k)) for k in range(6)]
    listed = spark.createDataFrame(rows, "domain string, job string").groupBy("domain").agg(F.concat(F.lit('{"jobs": ['), F.array_join(F.collect_list("job"), ","), F.lit("]}")).alias("payload"))
    captures = listed.select("domain", F.lit("greenhouse").alias("ats"), F.col("domain").alias("token"), "payload", F.lit(True).alias("complete"))
    out = boards.parse(captures, "greenhouse")
    plan = out.select("external_id", "url")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ArrowEvalPython" not in plan
    got = {r["external_id"]: r for r in out.collect()}
    assert set(got) == {"1", "3", "5"} and got["3"]["description"] == "body 3" and got["3"]["url"] == "https://job-boards.greenhouse.io/embed/job_app?for=a&token=3"
