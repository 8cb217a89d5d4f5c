"""Registered queries of board payloads: every customer as a captured board of one posting, a query for each kind of board, with their SQL.

A payload is written from the customer's columns k (key), n (name), s (segment) and p (nation), in the shape of its kind; some keys leave
a field out, so that fallbacks show. The SQL says what its parsed posting must hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import boards
from ..sources.tables import table
from .catalogue import query
from .views import AS_OR

SOURCE = "c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s, c_nationkey AS p FROM customer)"
#: A time of its own for each key, as epoch seconds, as a text with offset, and as a timestamp of the SQL.
SECONDS, STAMP, TIME = "1600000000 + k * 3600", "date_format(timestamp_seconds(1600000000 + k * 3600), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "epoch_ms((1600000000 + k * 3600) * 1000)"
ID, DAY = "CAST(k AS VARCHAR)", "TIMESTAMP '2024-01-01' + to_days(CAST(k % 300 AS INTEGER))"


def kind(number: int, name: str, payload: str, sql: dict[str, str], token: str = "cast(k AS string)", where: str = "true", parse: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register the query of one kind. payload and token: how the capture is written; sql: what is parsed from it, and from which keys."""
    columns = ", ".join(f"{v} AS {c}" for c, v in sql.items())

    @query(f"q{number}_captures_{name}", f"WITH {SOURCE} SELECT {ID} AS domain, {columns} FROM c WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS n", "c_mktsegment AS s", "c_nationkey AS p")
        captured = c.selectExpr("cast(k AS string) AS domain", f"'{name}' AS ats", f"{token} AS token", f"{payload} AS payload", "true AS complete")
        rows = parse(captured) if parse else boards.parse(captured, name, F.lit(AS_OR).cast("timestamp"))
        return rows.select("domain", *[F.col(f).cast("timestamp_ntz").alias(f) if f == "posted_at" else f for f in sql])


kind(133, "lever", f"""to_json(array(named_struct('id', concat('p', k), 'text', n, 'categories', named_struct('location', s, 'team', concat('team ', p)), 'hostedUrl', concat('https://h/', k), 'createdAt', ({SECONDS}) * 1000,
'descriptionPlain', concat('About ', s), 'lists', array(named_struct('text', 'Do', 'content', '<li>one</li><li>two &amp; three</li>')), 'additionalPlain', if(k % 2 = 0, 'Bye', null), 'workplaceType', element_at(array('On-site', 'Remote', 'unspecified'), cast(k % 3 + 1 as int)))))""",
     {"external_id": "'p' || k", "title": "n", "location": "s", "department": "'team ' || p", "url": "'https://h/' || k", "posted_at": TIME, "workplace_type": "CASE k % 3 WHEN 0 THEN 'onsite' WHEN 1 THEN 'remote' END",
      "description": r"'About ' || s || chr(10) || chr(10) || 'Do' || chr(10) || chr(10) || '- one' || chr(10) || chr(10) || '- two & three' || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || 'Bye' ELSE '' END"})
kind(134, "ashby", f"""to_json(named_struct('jobs', array(named_struct('id', k, 'title', n, 'jobUrl', concat('https://a/', k), 'publishedAt', {STAMP}, 'workplaceType', 'Hybrid',
'compensation', named_struct('scrapeableCompensationSalarySummary', if(k % 2 = 0, '$1K', null), 'compensationTierSummary', '$2K')))))""",
     {"external_id": ID, "title": "n", "url": "'https://a/' || k", "posted_at": TIME, "workplace_type": "'hybrid'", "salary_text": "CASE WHEN k % 2 = 0 THEN '$1K' ELSE '$2K' END"})
kind(135, "workable", "to_json(named_struct('jobs', array(named_struct('shortcode', concat('W', k), 'title', n, 'city', if(k % 3 = 0, '', s), 'country', if(k % 5 = 0, null, 'Israel'), 'published_on', '2024-01-02'))))",
     {"external_id": "'W' || k", "title": "n", "location": "nullif(concat_ws(', ', CASE WHEN k % 3 > 0 THEN s END, CASE WHEN k % 5 > 0 THEN 'Israel' END), '')", "posted_at": "TIMESTAMP '2024-01-02'"})
kind(136, "recruitee", "to_json(named_struct('offers', array(named_struct('id', k, 'title', n, 'location', s, 'published_at', concat(date_format(timestamp_seconds(1600000000 + k * 3600), 'yyyy-MM-dd HH:mm:ss'), ' UTC'), 'remote', k % 4 = 0, 'hybrid', k % 2 = 0, 'on_site', k % 3 = 0))))",
     {"external_id": ID, "location": "s", "posted_at": TIME, "workplace_type": "CASE WHEN k % 4 = 0 THEN 'remote' WHEN k % 2 = 0 THEN 'hybrid' WHEN k % 3 = 0 THEN 'onsite' END"})
kind(137, "smartrecruiters", """to_json(named_struct('content', array(named_struct('id', k, 'name', n, 'location', named_struct('city', s, 'country', 'de', 'remote', k % 2 = 0, 'hybrid', k % 3 = 0), 'department', named_struct('label', 'D'),
'experienceLevel', named_struct('id', element_at(array('entry_level', 'mid_senior_level', 'not_applicable'), cast(k % 3 + 1 as int)))))))""",
     {"external_id": ID, "title": "n", "location": "s || ', de'", "url": "'https://jobs.smartrecruiters.com/co/' || k", "department": "'D'", "workplace_type": "CASE WHEN k % 2 = 0 THEN 'remote' WHEN k % 3 = 0 THEN 'hybrid' ELSE 'onsite' END", "seniority": "CASE k % 3 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' END"}, token="'co'")
kind(138, "pinpoint", """to_json(named_struct('data', array(named_struct('id', k, 'title', n, 'location', named_struct('city', if(k % 2 = 0, s, null), 'province', if(k % 2 = 0, 'P', null), 'name', 'Named'), 'description', 'one', 'description_header', 'ignored', 'benefits', if(k % 3 = 0, 'two', ''), 'benefits_header', 'Perks',
'compensation_visible', k % 5 > 0, 'compensation_minimum', k % 4, 'compensation', '$5 / year'))))""",
     {"external_id": ID, "location": "CASE WHEN k % 2 = 0 THEN s || ', P' ELSE 'Named' END", "description": "'## ignored' || chr(10) || 'one' || CASE WHEN k % 3 = 0 THEN chr(10) || chr(10) || '## Perks' || chr(10) || 'two' ELSE '' END", "salary_text": "CASE WHEN k % 5 > 0 AND k % 4 > 0 THEN '$5 / year' END"})
kind(139, "bamboohr", "to_json(named_struct('result', array(named_struct('id', k, 'jobOpeningName', if(k % 3 = 0, 'Marketing Manager', n), 'location', named_struct('city', s, 'state', 'Texas'), 'departmentLabel', 'D', 'isRemote', k % 2 = 0))))",
     {"external_id": ID, "title": "n", "location": "s || ', Texas'", "url": "'https://' || k || '.bamboohr.com/careers/' || k", "workplace_type": "CASE WHEN k % 2 = 0 THEN 'remote' END"}, where="k % 3 > 0")
kind(140, "breezy", "to_json(array(named_struct('id', k, 'name', n, 'location', named_struct('city', s, 'state', if(k % 2 = 0, named_struct('name', 'S'), null), 'country', named_struct('name', 'N')))))",
     {"external_id": ID, "title": "n", "location": "s || CASE WHEN k % 2 = 0 THEN ', S' ELSE '' END || ', N'"})
kind(141, "ness", "to_json(named_struct('allOrderDetailsList', array(named_struct('index', k, 'title', n, 'posLocation', if(k % 2 = 0, s, ''), 'lastUpdated', date_format(date_add(date'2024-01-01', cast(k % 300 as int)), 'dd/MM/yyyy'), 'profName', 'QA', 'posDescription', 'd'))))",
     {"external_id": ID, "title": "n", "location": "CASE WHEN k % 2 = 0 THEN s || ', Israel' ELSE 'Israel' END", "url": "'https://n.co/careers/job/' || k", "posted_at": DAY, "department": "'QA'"}, token="'n.co'")
kind(142, "amazon", "to_json(named_struct('jobs', array(named_struct('id_icims', if(k % 2 = 0, k, null), 'id', concat('x', k), 'title', n, 'location', s, 'job_path', concat('/en/jobs/', k), 'posted_date', date_format(date_add(date'2024-01-01', cast(k % 300 as int)), 'MMMM d, yyyy')))))",
     {"external_id": "CASE WHEN k % 2 = 0 THEN '' ELSE 'x' END || k", "title": "n", "location": "s", "url": "'https://www.amazon.jobs/en/jobs/' || k", "posted_at": DAY})
kind(143, "microsoft", f"to_json(named_struct('data', named_struct('positions', array(named_struct('id', k, 'name', n, 'locations', if(k % 2 = 0, array(concat('Israel, North, ', s), 'Israel, Multiple Locations'), array()), 'standardizedLocations', array('Haifa, IL'), 'positionUrl', concat('/p/', k), 'postedTs', {SECONDS}, 'workLocationOption', 'onsite')))))",
     {"external_id": ID, "title": "n", "location": "CASE WHEN k % 2 = 0 THEN s || ', North, Israel; Israel' ELSE 'Haifa, IL' END", "url": "'https://apply.careers.microsoft.com/p/' || k", "posted_at": TIME, "workplace_type": "'onsite'"})
kind(144, "google", f"""concat('<script>AF_initDataCallback({{key: \\'ds:1\\', hash: \\'3\\', data:[[["', k, '","', n, ', PhD",null,[null,"<p>must</p>"],null,null,null,null,null,[["', s, '",null,null,null,null,"', if(k % 3 = 0, 'FR', 'IL'), '"],["Haifa",null,null,null,null,"IL"]],[null,"<p>what</p>"],null,[', {SECONDS}, ']]],null,1], sideChannel: {{}}}});</script>')""",
     {"external_id": ID, "title": "n || ', PhD'", "location": "CASE WHEN k % 3 > 0 THEN s || '; ' ELSE '' END || 'Haifa'", "url": "'https://www.google.com/about/careers/applications/jobs/results/' || k || '-' || replace(lower(n), '#', '') || '-phd'", "posted_at": TIME, "description": "'what' || chr(10) || chr(10) || 'must'"}, token="'il'")
kind(145, "apple", f"""to_json(named_struct('res', named_struct('searchResults', array(named_struct('positionId', if(k % 2 = 0, k, null), 'id', concat('R-', k), 'postingTitle', n, 'transformedPostingTitle', 'slug', 'postDateInGMT', {STAMP}, 'locations', array(named_struct('name', s, 'countryName', 'Israel'), named_struct('name', 'Cork', 'countryName', 'Ireland')), 'team', named_struct('teamName', 'HW'), 'jobSummary', 'sum', 'responsibilities', 'do')))))""",
     {"external_id": "CASE WHEN k % 2 = 0 THEN '' ELSE 'R-' END || k", "location": "s || ', Israel; Cork, Ireland'", "url": "'https://jobs.apple.com/en-il/details/' || CASE WHEN k % 2 = 0 THEN '' ELSE 'R-' END || k || '/slug'", "department": "'HW'", "posted_at": TIME, "description": "'sum' || chr(10) || chr(10) || 'Responsibilities' || chr(10) || 'do'"})
kind(146, "oracle", f"to_json(named_struct('items', array(named_struct('requisitionList', array(named_struct('Id', k, 'Title', n, 'PrimaryLocation', s, 'secondaryLocations', array(named_struct('Name', 'B'), named_struct('Name', s)), 'WorkplaceTypeCode', if(k % 2 = 0, 'ORA_HYBRID', null), 'WorkplaceType', 'Remote', 'PostedDate', {STAMP}))))))",
     {"external_id": ID, "title": "n", "location": "s || '; B'", "url": "'https://h.co/hcmUI/CandidateExperience/en/sites/CX/job/' || k", "workplace_type": "CASE WHEN k % 2 = 0 THEN 'hybrid' ELSE 'remote' END", "posted_at": TIME}, token="'h.co:CX'")
kind(147, "eightfold", f"to_json(named_struct('positions', array(named_struct('id', k, 'name', n, 'location', 'One', 'locations', if(k % 2 = 0, array(s, 'Y'), array()), 't_create', if(k % 3 = 0, {SECONDS}, null), 't_update', 1700000000, 'canonicalPositionUrl', concat('https://e/', k)))))",
     {"external_id": ID, "location": "CASE WHEN k % 2 = 0 THEN s || '; Y' ELSE 'One' END", "posted_at": f"CASE WHEN k % 3 = 0 THEN {TIME} ELSE epoch_ms(1700000000000) END", "url": "'https://e/' || k"})
kind(148, "redmatch", f"to_json(named_struct('count', 1, 'positions', array(named_struct('compPositionID', k, 'jobTitleText', concat(' ', n, ' '), 'displayLocation', s, 'activationDate', {STAMP}, 'fieldDesc', 'IT', 'isActivePosition', k % 4 > 0))))",
     {"external_id": ID, "title": "n", "location": "s || ', Israel'", "url": "'https://r.co/redmatch-apply/redmatch.apply.html?compPositionID=' || k", "posted_at": TIME, "department": "'IT'"}, token="'r.co:aff'", where="k % 4 > 0")
kind(149, "tycowp", f"to_json(array(named_struct('id', k, 'tl', n, 'ct', if(k % 2 = 0, s, null), 'tp', if(k % 3 = 0, '{boards.STUDENT_POST}', 'x'), 'jc', 'F', 'dc', 'd')))",
     {"external_id": ID, "title": "n", "location": "CASE WHEN k % 2 = 0 THEN s || ', Israel' ELSE 'Israel' END", "seniority": "CASE WHEN k % 3 = 0 THEN 'intern' END", "url": "'https://y.co/job/' || k", "department": "'F'"}, token="'y.co'")
kind(150, "comeet", f"to_json(array(named_struct('uid', if(k % 2 = 0, k, null), 'position_uid', concat('P', k), 'name', n, 'location', named_struct('name', s), 'careers_page_active_url', if(k % 3 = 0, concat('https://c.co/careers/job/', k), 'https://c.co/careers/'), 'careers_page_url', concat('https://comeet/', k), 'time_updated', {STAMP}, 'experience_level', 'Senior', 'workplace_type', 'Hybrid')))",
     {"external_id": "CASE WHEN k % 2 = 0 THEN '' ELSE 'P' END || k", "location": "s", "url": "CASE WHEN k % 3 = 0 THEN 'https://c.co/careers/job/' ELSE 'https://comeet/' END || k", "posted_at": TIME, "seniority": "'senior'", "workplace_type": "'hybrid'"})
kind(151, "workday", "to_json(named_struct('jobPostings', array(named_struct('title', n, 'externalPath', concat('/p/', k), 'bulletFields', if(k % 2 = 0, array(concat('R', k)), null), 'locationsText', s, 'postedOn', element_at(array('Posted Today', 'Posted Yesterday', 'Posted 30+ Days Ago'), cast(k % 3 + 1 as int))))))",
     {"external_id": "CASE WHEN k % 2 = 0 THEN 'R' ELSE '/p/' END || k", "location": "s", "url": "'/p/' || k", "posted_at": "CASE k % 3 WHEN 1 THEN TIMESTAMP '2001-08-01' WHEN 2 THEN TIMESTAMP '2001-07-03' END"})
kind(152, "teamtailor", f"to_json(named_struct('items', array(named_struct('url', if(k % 2 = 0, concat('https://t.teamtailor.com/jobs/', k, '-x'), concat('https://t/', k)), 'title', n, 'date_published', {STAMP}, 'content_html', '<p>b</p>'))))",
     {"external_id": "CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'https://t/' || k END", "title": "n", "posted_at": TIME, "description": "'b'"})
kind(153, "personio", f"concat('<workzag-jobs><position><id>', k, '</id><office>', s, '</office><additionalOffices><office>B</office></additionalOffices><name><![CDATA[', n, ']]></name><department>D</department><createdAt>', {STAMP}, '</createdAt></position></workzag-jobs>')",
     {"external_id": ID, "title": "n", "location": "s || ', B'", "url": "'https://' || k || '.jobs.personio.de/job/' || k", "posted_at": TIME, "department": "'D'"}, parse=boards.parse_xml)
kind(154, "cards", "if(k % 4 = 0, 'This board is no longer active', concat('<p>', if(k % 5 = 0, 2, 1), ' jobs</p><li class=j><a href=\"/j/', k, '\">', n, '</a><i>', s, '</i></li>'))",
     {"external_id": ID, "title": "n", "location": "s"}, where="k % 4 > 0 AND k % 5 > 0",
     parse=lambda c: boards.parse_cards(c, "cards", r"<li class=j>.*?</li>", {"external_id": r"/j/(\d+)", "title": r'">(.*?)</a>', "location": "<i>(.*?)</i>"}, stated_total=r"(\d+) jobs", miss="no longer active"))
LISTED = f"'@type', 'JobPosting', 'title', n, 'url', concat('https://l/', k), 'datePosted', {STAMP}"
kind(155, "json_ld", f"""concat('<script type="application/ld+json">', if(k % 2 = 0, concat('{{"@graph":[{{"@type":"Organization"}},', to_json(map({LISTED}, 'jobLocationType', 'TELECOMMUTE')), ']}}'), to_json(map({LISTED}))), '</script>')""",
     {"external_id": "'https://l/' || k", "title": "n", "posted_at": TIME, "workplace_type": "CASE WHEN k % 2 = 0 THEN 'remote' END"}, parse=lambda c: boards.parse_json_ld(c, "json_ld"))
