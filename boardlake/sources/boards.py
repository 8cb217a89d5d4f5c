"""Board payloads, as captured, to postings of one shape.

A capture is a row (domain, ats, token, payload, complete): the text that a board answered with. Each kind
of board is a specification of where its fields are; parsing is get_json_object and regular expressions in the
JVM, one narrow pass. A payload that is no board of its kind is a miss (no rows, and it must not
close anything); `complete` says whether a read was whole, and only whole reads may close listings.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.taxonomy import LEVEL_CODES, WORKPLACE_CODES, coded
from ..functions.text import clean_text, unescaped

POSTING = ["domain", "ats", "token", "external_id", "title", "location", "url", "posted_at", "department", "description", "seniority", "workplace_type", "salary_text", "complete"]


#: A field of an item: JSON paths that are tried in order, or a rule that makes the value from the item.
Field = tuple[str, ...] | Callable[[Column], Column]


@dataclass
class Spec:
    """Where a kind keeps its fields. items: the list's path, '' for a bare list, or a rule that finds the list in a payload."""

    items: str | Callable[[Column], Column]
    id: Field
    title: Field
    location: Field = ()
    url: Field = ()
    posted: Field = ()
    department: Field = ()
    description: Field = ()
    workplace: Field = ()
    level: Field = ()
    salary: Field = ()
    date: Callable[[Column], Column] = dates.normalized
    where: str | None = None
    cap: int | None = None
    flags: tuple[tuple[str, str], ...] = field(default=())
    demo: tuple[str, ...] = ()


def value(x: Column, path: str) -> Column:
    """The text at a path; null for nothing and for blanks."""
    return F.nullif(F.trim(F.get_json_object(x, path)), F.lit(""))


def joined(*paths: str, by: str = ", ") -> Callable[[Column], Column]:
    return lambda x: F.nullif(F.concat_ws(by, *[value(x, p) for p in paths]), F.lit(""))


def in_israel(*paths: str) -> Callable[[Column], Column]:
    """The first place that is stated, with the country, which these boards never name."""
    return lambda x: F.coalesce(F.concat(F.coalesce(*[value(x, p) for p in paths]), F.lit(", Israel")), F.lit("Israel"))


def sections(*parts: tuple[str, Column | str | None]) -> Callable[[Column], Column]:
    """Parts of a body, each under its heading (a path from '$', a text, or none), an empty line between them."""

    def build(x: Column) -> Column:
        told = []
        for path, heading in parts:
            head = None if heading is None else F.concat(F.lit("## "), value(x, heading)) if heading.startswith("$") else F.lit(heading)
            body = value(x, path)
            told.append(body if head is None else F.when(body.isNotNull(), F.concat_ws("\n", head, body)))
        return F.nullif(F.concat_ws("\n\n", *told), F.lit(""))

    return build


def listed_sections(x: Column) -> Column:
    """An opening, lists under headings, and a closing text."""
    lists = F.from_json(F.get_json_object(x, "$.lists"), "array<struct<text:string,content:string>>")
    return F.nullif(F.concat_ws("\n\n", value(x, "$.descriptionPlain"), F.array_join(F.transform(lists, lambda p: F.concat_ws("\n", p["text"], p["content"])), "\n\n"), value(x, "$.additionalPlain")), F.lit(""))


def address(*parts: str) -> Callable[[Column], Column]:
    """An address of texts, of paths of the item, and of the capture's token: '{token}', or '{token:0}' for its parts between colons."""

    def part(x: Column, p: str, known: dict[str, Column]) -> Column:
        if p.startswith("{token"):
            return F.split(F.col("token"), ":")[int(p[7:-1])] if ":" in p else F.col("token")
        return known.get(p, value(x, p)) if p.startswith("$") else F.lit(p)

    return lambda x, known=None: F.concat(*[part(x, p, known or {}) for p in parts])


def visible_pay(x: Column) -> Column:
    """The written range where it is shown and holds a figure; 'competitive' is no pay."""
    stated = F.coalesce(value(x, "$.compensation_minimum"), value(x, "$.compensation_maximum"))
    return F.when((F.get_json_object(x, "$.compensation_visible") == "true") & stated.isNotNull() & (stated != "0"), value(x, "$.compensation"))


def reversed_places(x: Column) -> Column:
    """'Country, Region, City' read back to front; undecided places are dropped."""
    turned = lambda t: F.array_join(F.reverse(F.filter(F.transform(F.split(t, ","), lambda p: F.trim(p)), lambda p: (p != "") & (p != "Multiple Locations"))), ", ")
    names = F.array_distinct(F.filter(F.transform(F.from_json(F.get_json_object(x, "$.locations"), "array<string>"), turned), lambda p: p != ""))
    standard = F.from_json(F.get_json_object(x, "$.standardizedLocations"), "array<string>")
    return F.nullif(F.coalesce(F.nullif(F.array_join(names, "; "), F.lit("")), F.array_join(standard, "; ")), F.lit(""))


def script_rows(payload: Column) -> Column:
    """The rows in a results page's own data block."""
    return F.get_json_object(F.regexp_extract(payload, r"(?s)AF_initDataCallback\(\{key: 'ds:1'.*?data:(.*?), sideChannel", 1), "$[0]")


def row_places(x: Column) -> Column:
    """The names of a row's places; only those of the token's country where the token is a country's two letters."""
    places = F.from_json(F.get_json_object(x, "$[9]"), "array<string>")
    own = F.filter(places, lambda p: (F.length("token") != 2) | (F.get_json_object(p, "$[5]") == F.upper("token")))
    return F.nullif(F.array_join(F.transform(own, lambda p: F.get_json_object(p, "$[0]")), "; "), F.lit(""))


def slug(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9 -]", ""), r"[\s-]+", "-"), F.lit("-"))


def countries_after(x: Column) -> Column:
    """'name, country' of each place."""
    places = F.from_json(F.get_json_object(x, "$.locations"), "array<struct<name:string,countryName:string>>")
    return F.nullif(F.array_join(F.transform(places, lambda p: F.concat_ws(", ", p["name"], p["countryName"])), "; "), F.lit(""))


def first_list(payload: Column) -> Column:
    """A bare list, or the first list among an object's values."""
    lists = F.filter(F.map_values(F.from_json(payload, "map<string,string>")), lambda v: v.startswith("["))
    return F.when(payload.rlike(r"^\s*\["), payload).otherwise(F.get(lists, F.lit(0)))


def own_page(x: Column) -> Column:
    """The company's own page of a posting, unless it is only the root of its careers site; then the board's page."""
    active, hosted = value(x, "$.careers_page_active_url"), F.coalesce(value(x, "$.careers_page_url"), value(x, "$.url_active_page"))
    path = F.lower(F.regexp_replace(F.regexp_extract(active, r"^[a-z]+://[^/?#]+([^?#]*)", 1), "/+$", ""))
    return F.coalesce(F.when(~path.isin("", "/careers", "/career", "/jobs"), active), hosted, active)


def several_places(x: Column) -> Column:
    more = F.from_json(F.get_json_object(x, "$.secondaryLocations"), "array<struct<Name:string>>")
    return F.nullif(F.array_join(F.array_distinct(F.array_compact(F.concat(F.array(value(x, "$.PrimaryLocation")), F.coalesce(F.transform(more, lambda p: p["Name"]), F.array().cast("array<string>"))))), "; "), F.lit(""))


def flagged_place(x: Column) -> Column:
    """remote, hybrid, or onsite where both are denied."""
    remote, hybrid = F.get_json_object(x, "$.location.remote"), F.get_json_object(x, "$.location.hybrid")
    return F.when(remote == "true", "remote").when(hybrid == "true", "hybrid").when((remote == "false") & (hybrid == "false"), "onsite")


def epoch(c: Column) -> Column:
    return F.timestamp_seconds(c.try_cast("long"))


def day_first(c: Column) -> Column:
    return dates.written(c).cast("timestamp")


# A seniority that one board writes as a kind of post; titles of a vendor's demo board.
STUDENT_POST = "משרת סטודנט"
DEMO_TITLES = ("IT Security Engineer", "Software Engineer", "Sales Development Representative", "Marketing Manager")
# Workplace codes of one board.
ORACLE_WORKPLACES = {"ora_on_site": "onsite", "ora_remote": "remote", "ora_hybrid": "hybrid"}

# Where each kind of board keeps its fields, and the addresses of their pages.
SPECS = {
    "greenhouse": Spec("$.jobs", ("$.id",), ("$.title",), ("$.location.name",), address("https://job-boards.greenhouse.io/embed/job_app?for=", "{token}", "&token=", "$.id"), ("$.updated_at",), ("$.departments[0].name",), ("$.content",)),
    "lever": Spec("", ("$.id",), ("$.text",), ("$.categories.location",), ("$.hostedUrl",), ("$.createdAt",), ("$.categories.team",), listed_sections, ("$.workplaceType",)),
    "ashby": Spec("$.jobs", ("$.id",), ("$.title",), ("$.location",), ("$.jobUrl",), ("$.publishedAt",), ("$.department",), ("$.descriptionPlain",), ("$.workplaceType",), salary=("$.compensation.scrapeableCompensationSalarySummary", "$.compensation.compensationTierSummary")),
    "workable": Spec("$.jobs", ("$.shortcode",), ("$.title",), joined("$.city", "$.country"), ("$.url",), ("$.published_on",), ("$.department",), ("$.description",)),
    "recruitee": Spec("$.offers", ("$.id",), ("$.title",), ("$.location",), ("$.careers_url",), ("$.published_at",), ("$.department",), ("$.description",), flags=(("$.remote", "remote"), ("$.hybrid", "hybrid"), ("$.on_site", "onsite"))),
    "smartrecruiters": Spec("$.content", ("$.id",), ("$.name",), joined("$.location.city", "$.location.country"), address("https://jobs.smartrecruiters.com/", "{token}", "/", "$.id"), ("$.releasedDate",), ("$.department.label",), workplace=flagged_place, level=("$.experienceLevel.id",), cap=100),
    "pinpoint": Spec("$.data", ("$.id",), ("$.title",), lambda x: F.coalesce(joined("$.location.city", "$.location.province")(x), value(x, "$.location.name")), ("$.url",), (), ("$.job.department.name",),
                     sections(*[(f"$.{n}", f"$.{n}_header") for n in ("description", "key_responsibilities", "skills_knowledge_expertise", "benefits")]), ("$.workplace_type",), salary=visible_pay),
    "bamboohr": Spec("$.result", ("$.id",), ("$.jobOpeningName",), joined("$.location.city", "$.location.state"), address("https://", "{token}", ".bamboohr.com/careers/", "$.id"), (), ("$.departmentLabel",), flags=(("$.isRemote", "remote"),), demo=DEMO_TITLES),
    "breezy": Spec("", ("$.id",), ("$.name",), joined("$.location.city", "$.location.state.name", "$.location.country.name"), ("$.url",), ("$.published_date",), ("$.department",)),
    "niloosoft": Spec("", ("$.jobId",), ("$.jobTitle",), in_israel("$.locationAddress", "$.area"), address("https://", "{token:0}", "/?jobId=", "$.jobId"), ("$.openDate",), (), joined("$.description", "$.requirements", by=" "), where="coalesce(get_json_object(x, '$.status'), '1') = '1'"),
    "ness": Spec("$.allOrderDetailsList", ("$.index",), ("$.title",), in_israel("$.posLocation"), address("https://", "{token}", "/careers/job/", "$.index"), ("$.lastUpdated",), ("$.profName",), ("$.posDescription",), date=day_first),
    "amazon": Spec("$.jobs", ("$.id_icims", "$.id"), ("$.title",), ("$.location",), address("https://www.amazon.jobs", "$.job_path"), ("$.posted_date",), ("$.job_category",), ("$.description",), date=day_first),
    "microsoft": Spec("$.data.positions", ("$.id",), ("$.name",), reversed_places, address("https://apply.careers.microsoft.com", "$.positionUrl"), ("$.postedTs",), ("$.department",), ("$.jobDescription",), ("$.workLocationOption",), date=epoch),
    "google": Spec(script_rows, ("$[0]",), ("$[1]",), row_places, lambda x: F.concat(F.lit("https://www.google.com/about/careers/applications/jobs/results/"), value(x, "$[0]"), F.lit("-"), slug(value(x, "$[1]"))), ("$[12][0]",), (), sections(("$[10][1]", None), ("$[3][1]", None), ("$[4][1]", None)), date=epoch),
    "apple": Spec("$.res.searchResults", ("$.positionId", "$.id"), ("$.postingTitle",), countries_after, lambda x: F.concat(F.lit("https://jobs.apple.com/en-il/details/"), F.coalesce(value(x, "$.positionId"), value(x, "$.id")), F.lit("/"), F.coalesce(value(x, "$.transformedPostingTitle"), F.lit(""))), ("$.postDateInGMT",), ("$.team.teamName",),
                  sections(("$.jobSummary", None), ("$.description", "Description"), ("$.responsibilities", "Responsibilities"), ("$.minimumQualifications", "Minimum qualifications"), ("$.preferredQualifications", "Preferred qualifications"))),
    "oracle": Spec("$.items[0].requisitionList", ("$.Id",), ("$.Title",), several_places, address("https://", "{token:0}", "/hcmUI/CandidateExperience/en/sites/", "{token:1}", "/job/", "$.Id"), ("$.PostedDate",), ("$.JobFamily",), ("$.ShortDescriptionStr",),
                   lambda x: F.coalesce(coded(value(x, "$.WorkplaceTypeCode"), ORACLE_WORKPLACES), coded(value(x, "$.WorkplaceType"), WORKPLACE_CODES)), cap=4000),
    "eightfold": Spec("$.positions", ("$.id",), ("$.name",), lambda x: F.coalesce(F.nullif(F.array_join(F.from_json(F.get_json_object(x, "$.locations"), "array<string>"), "; "), F.lit("")), value(x, "$.location")), ("$.canonicalPositionUrl",), ("$.t_create", "$.t_update"), ("$.department",), ("$.job_description",), ("$.work_location_option",), date=epoch, cap=2000),
    "redmatch": Spec(first_list, ("$.compPositionID",), ("$.jobTitleText",), in_israel("$.displayLocation", "$.location"), address("https://", "{token:0}", "/redmatch-apply/redmatch.apply.html?compPositionID=", "$.compPositionID"), ("$.activationDate",), ("$.fieldDesc",), ("$.description",), date=dates.local_to_utc, where="coalesce(get_json_object(x, '$.isActivePosition'), 'true') <> 'false'"),
    "wprest": Spec("", ("$.id",), ("$.title.rendered",), address("{token:2}"), ("$.link",), ("$.date",), (), ("$.content.rendered",)),
    "tycowp": Spec("", ("$.id",), ("$.tl",), in_israel("$.ct"), address("https://", "{token}", "/job/", "$.id"), (), ("$.jc",), ("$.dc",), level=lambda x: F.when(value(x, "$.tp") == STUDENT_POST, "intern")),
    "comeet": Spec("", ("$.uid", "$.position_uid"), ("$.name",), ("$.location.name",), own_page, ("$.time_updated",), ("$.department",), ("$.details[0].value",), ("$.workplace_type",), ("$.experience_level",)),
    "workday": Spec("$.jobPostings", ("$.bulletFields[0]", "$.externalPath"), ("$.title",), ("$.locationsText",), ("$.externalPath",), ("$.postedOn",), cap=3000),
    "teamtailor": Spec("$.items", lambda x: F.coalesce(F.nullif(F.regexp_extract(value(x, "$.url"), r"/jobs/(\d+)-", 1), F.lit("")), value(x, "$.url")), ("$.title",), (), ("$.url",), ("$.date_published",), (), ("$.content_html",)),
}


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures stored as JSON lines; a line that is no JSON is kept aside in _corrupt."""
    schema = "domain string, ats string, token string, payload string, complete boolean, captured_at timestamp, _corrupt string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def _first(item: Column, paths: Field) -> Column:
    if callable(paths):
        return paths(item)
    found = [value(item, p) for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def parse(captures: DataFrame, kind: str, as_of: Column | None = None) -> DataFrame:
    """The postings of captures of one kind of JSON board, with clean texts; lists at their cap count as incomplete.

    A board that shows nothing but its vendor's demo titles is a miss. Of an id that a board lists again the first posting counts.
    """
    spec = SPECS[kind]
    own = captures.where(F.col("ats") == kind)
    raw = spec.items(F.col("payload")) if callable(spec.items) else F.get_json_object("payload", spec.items) if spec.items else F.col("payload")
    listed = own.withColumn("_items", F.from_json(raw, "array<string>"))
    if spec.cap:
        listed = listed.withColumn("complete", F.col("complete") & (F.size("_items") < spec.cap))
    if spec.demo:
        titles = F.transform("_items", lambda x: _first(x, spec.title))
        listed = listed.where(F.size(F.array_except(titles, F.array(*map(F.lit, spec.demo)))) > 0)
    rows = listed.select("domain", "ats", "token", "complete", F.posexplode("_items").alias("_at", "x"))
    rows = rows.where(spec.where) if spec.where else rows
    x = F.col("x")
    board = kind == "greenhouse"
    posting = {"external_id": spec.id, "title": spec.title} | ({"location": spec.location, "posted_at": spec.posted, "_internal": ("$.internal_job_id",), "_published": ("$.first_published",)} if board else {})
    names = sorted({p[2:] for paths in posting.values() if not callable(paths) for p in paths if re.fullmatch(r"\$\.\w+", p)})
    if names:
        rows = rows.select("*", F.json_tuple("x", *names).alias(*[f"_of_{n}" for n in names]))
    read = lambda paths: paths(x) if callable(paths) else F.coalesce(*[F.nullif(F.trim(f"_of_{p[2:]}"), F.lit("")) if p[2:] in names else value(x, p) for p in paths])
    found = {n: F.col(f"_of_{paths[0][2:]}") if n.startswith("_") else read(paths) for n, paths in posting.items()}
    date = lambda text: (dates.relative(text, as_of if as_of is not None else F.lit(None).cast("timestamp")) if kind == "workday" else spec.date(text)).cast("timestamp")
    if board:
        found["posted_at"] = date(found["posted_at"])
    out = rows.select("domain", "ats", "token", *[c.alias(n) for n, c in found.items()], "complete", "_at", "x").where("title is not null")
    if board:
        one = distinct_postings(out)
    else:
        rest = [c for c in out.columns if c not in ("domain", "ats", "external_id")]
        one = out.groupBy("domain", "ats", "external_id").agg(F.min_by(F.struct(*rest), F.struct("token", "_at")).alias("_r")).select("domain", "ats", "external_id", "_r.*")
    place = spec.workplace(x) if callable(spec.workplace) else coded(_first(x, spec.workplace), WORKPLACE_CODES)
    for path, name in reversed(spec.flags):
        place = F.when(F.get_json_object(x, path) == "true", name).otherwise(place)
    level = spec.level(x) if callable(spec.level) else coded(_first(x, spec.level), LEVEL_CODES[kind]) if kind in LEVEL_CODES else F.lit(None).cast("string")
    # what does not decide which posting stays is read from those that do; a board's address is of its id
    url = spec.url(x, {spec.id[0]: F.col("external_id")}) if board else _first(x, spec.url)
    fields = {
        "location": _first(x, spec.location), "url": url, "posted_at": date(_first(x, spec.posted)),
        "department": _first(x, spec.department), "description": clean_text(_first(x, spec.description)) if spec.description else F.lit(None).cast("string"), "seniority": level, "workplace_type": place, "salary_text": _first(x, spec.salary),
    }
    more = [x.alias("_item")] if kind == "wprest" else []
    return one.select(*[fields[c].alias(c) if c in fields and c not in found else F.col(c) for c in POSTING], *more)


def distinct_postings(rows: DataFrame) -> DataFrame:
    """One posting for each internal job, title and location, and for each id of postings without one: the one published first, then the lowest id; of repeated ids the first title, then the first location."""
    job = F.when(F.col("_internal").isNotNull(), F.struct(F.col("_internal").alias("j"), F.col("title").alias("t"), F.col("location").alias("l"))).otherwise(F.struct(F.concat(F.lit("posting "), "external_id").alias("j"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("string").alias("l")))
    order = [F.coalesce("_published", F.lit("")), F.col("external_id").try_cast("long"), F.col("posted_at").isNull(), F.col("posted_at"), F.col("title"), F.coalesce("location", F.lit(""))]
    first = Window.partitionBy("domain", "ats", job).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def with_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of parse(captures, 'wprest') with place and department from the site's own terms (domain, taxonomy, term_id, name, kind).

    kind is `place` or `field`. A posting lists the ids of its terms under each taxonomy's name; they meet the terms in an
    equi-join, and the country of the token follows the places.
    """
    taxonomies = terms.select(F.col("domain").alias("_d"), "taxonomy").distinct()
    named = postings.join(taxonomies, F.col("domain") == F.col("_d")).select("domain", "external_id", "taxonomy", F.posexplode(F.from_json(F.call_function("get_json_object", F.col("_item"), F.concat(F.lit("$."), "taxonomy")), "array<bigint>")).alias("at", "term_id"))
    met = named.join(terms, ["domain", "taxonomy", "term_id"])
    texts = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("taxonomy", "at", "name")))), lambda x: x["name"]), "; ")
    of = met.groupBy("domain", "external_id").agg(F.nullif(texts("place"), F.lit("")).alias("_place"), F.nullif(texts("field"), F.lit("")).alias("_field"))
    both = postings.join(of, ["domain", "external_id"], "left")
    return both.withColumn("location", F.coalesce(F.concat("_place", F.lit(", "), "location"), "location")).withColumn("department", F.coalesce("_field", "department")).select(*POSTING)


def with_places(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """Postings of parse(captures, 'teamtailor') with the line that their site's list (domain, html) shows under each link.

    The line's parts, which mean different things on different sites, are joined to one location.
    """
    line = r'(?s)href="(https://[^"]+/jobs/\d+-[^"]*)"[^>]*>.*?</a>\s*<div[^>]*>(.*?)</div>'
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(line), F.lit(1)).alias("url"), F.regexp_extract_all("html", F.lit(line), F.lit(2)).alias("line"))
    found = pages.select(F.col("domain").alias("_d"), F.explode(pairs).alias("p")).select("_d", F.col("p.url").alias("_u"), unescaped(F.regexp_replace("p.line", "<[^>]+>", " ")).alias("line"))
    parts = F.filter(F.transform(F.split("line", "·"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    of = found.groupBy("_d", "_u").agg(F.first(F.array_join(parts, ", ")).alias("_line"))
    return postings.join(of, (F.col("domain") == F.col("_d")) & (F.col("url") == F.col("_u")), "left").withColumn("location", F.coalesce("_line", "location")).select(*POSTING)


#: What is read of an XML feed of positions; `broken` holds a payload that is no XML.
FEED = "position array<struct<id:string,name:string,office:string,additionalOffices:struct<office:array<string>>,createdAt:string,department:string>>, broken string"


def _feed(captures: DataFrame, kind: str) -> DataFrame:
    """Captures of a kind with x, their feed; namespaces of elements are ignored."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "true"}
    return captures.where(F.col("ats") == kind).withColumn("x", F.from_xml("payload", FEED, options))


def parse_xml(captures: DataFrame, kind: str = "personio") -> DataFrame:
    """Postings of an XML feed of <position> elements: the office and further offices are joined, the address follows the id, bodies are absent.

    A payload that is no XML gives no rows (see `broken_feeds`), and neither does one without positions.
    """
    rows = _feed(captures, kind).where("x.broken is null").select("domain", "ats", "token", "complete", F.explode("x.position").alias("p"))
    text = lambda name: F.nullif(F.trim(F.col(f"p.{name}")), F.lit(""))
    offices = F.concat(F.array(F.col("p.office")), F.coalesce(F.col("p.additionalOffices.office"), F.array().cast("array<string>")))
    offices = F.array_join(F.filter(F.transform(offices, lambda x: F.trim(x)), lambda x: x != ""), ", ")
    url = F.concat(F.lit("https://"), F.col("token"), F.lit(f".jobs.{kind}.de/job/"), text("id"))
    none = F.lit(None).cast("string")
    return rows.select("domain", "ats", "token", text("id").alias("external_id"), text("name").alias("title"), F.nullif(offices, F.lit("")).alias("location"), url.alias("url"), dates.normalized(text("createdAt")).alias("posted_at"), text("department").alias("department"), none.alias("description"), none.alias("seniority"), none.alias("workplace_type"), none.alias("salary_text"), "complete")


def broken_feeds(captures: DataFrame, kind: str = "personio") -> DataFrame:
    """Captures of a kind that are no XML, set aside: (domain, token, payload)."""
    return _feed(captures, kind).where("x.broken is not null or x is null").select("domain", "token", "payload")


def parse_cards(captures: DataFrame, kind: str, card: str, fields: dict[str, str], stated_total: str | None = None, miss: str | None = None) -> DataFrame:
    """Postings of an HTML list by patterns (a card, and a group for each field).

    Fewer cards than the page states is a miss, and so is a page with the pattern `miss`: a redirect, or a note that the board is
    no longer active.
    """
    cards = F.regexp_extract_all("payload", F.lit(card), F.lit(0))
    own = captures.where(F.col("ats") == kind).withColumn("_cards", cards)
    own = own.where(~F.col("payload").rlike(miss)) if miss else own
    if stated_total:
        own = own.where(F.size("_cards") >= F.coalesce(F.regexp_extract("payload", stated_total, 1).try_cast("int"), F.lit(0)))
    rows = own.select("domain", "ats", "token", "complete", F.explode("_cards").alias("x"))
    get = lambda n: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("x", fields[n], 1), r"<[^>]+>", "")), F.lit("")) if n in fields else F.lit(None).cast("string")
    return rows.select("domain", "ats", "token", *[get(n).alias(n) for n in ("external_id", "title", "location", "url")], dates.normalized(get("posted_at")).alias("posted_at"), *[get(n).alias(n) for n in ("department", "description", "seniority", "workplace_type", "salary_text")], "complete")


def parse_json_ld(captures: DataFrame, kind: str = "schema.org") -> DataFrame:
    """Postings of schema.org blocks in pages: single ones, lists, @graph and ItemList are laid flat."""
    blocks = F.regexp_extract_all("payload", F.lit(r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    rows = captures.where(F.col("ats") == kind).select("domain", "ats", "token", "complete", F.explode(blocks).alias("b"))
    graph = F.from_json(F.get_json_object("b", "$['@graph']"), "array<string>")
    items = F.transform(F.from_json(F.get_json_object("b", "$.itemListElement"), "array<string>"), lambda i: F.coalesce(F.get_json_object(i, "$.item"), i))
    bare = F.when(F.col("b").rlike(r"^\s*\["), F.from_json("b", "array<string>")).otherwise(F.array("b"))
    x = rows.select("domain", "ats", "token", "complete", F.explode(F.coalesce(graph, items, bare)).alias("x")).where(F.get_json_object("x", "$['@type']") == "JobPosting")
    get = lambda *p: _first(F.col("x"), p)
    none = F.lit(None).cast("string")
    return x.select(
        "domain", "ats", "token", get("$.identifier.value", "$.url").alias("external_id"), get("$.title").alias("title"), get("$.jobLocation.address.addressLocality", "$.jobLocation[0].address.addressLocality").alias("location"), get("$.url").alias("url"),
        dates.normalized(get("$.datePosted")).alias("posted_at"), get("$.industry").alias("department"), get("$.description").alias("description"), none.alias("seniority"), F.when(get("$.jobLocationType") == "TELECOMMUTE", "remote").alias("workplace_type"), none.alias("salary_text"), "complete",
    )


def tokens_in_urls(urls: DataFrame, pattern: str, url: str = "url") -> DataFrame:
    """(token, site, n): board tokens by a pattern of two groups, with the site that most of a token's urls name."""
    hit = urls.select(F.lower(F.regexp_extract(url, pattern, 1)).alias("token"), F.regexp_extract(url, pattern, 2).alias("site")).where("token <> ''")
    counts = hit.groupBy("token", "site").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("token").agg(F.max_by("site", F.struct("n", "site")).alias("site"), F.sum("n").alias("n"))


def fingerprint(postings: DataFrame, newest: int = 20) -> DataFrame:
    """Per board a hash of its size and newest ids, which tells an unchanged list without its details."""
    board = ["domain", "ats", "token"]
    at = F.row_number().over(Window.partitionBy(*board).orderBy(F.desc("posted_at"), F.desc("external_id")))
    top = postings.select(*board, "posted_at", "external_id", at.alias("_at")).where(F.col("_at") <= newest)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_at", "external_id"))), lambda x: x["external_id"])
    both = postings.groupBy(*board).agg(F.count(F.lit(1)).alias("_n")).join(top.groupBy(*board).agg(F.array_join(ids, ",").alias("_ids")), board)
    return both.select(*board, F.sha2(F.concat_ws("|", F.col("_n").cast("string"), "_ids").cast("binary"), 256).alias("content_hash"))


def resolve(pins: DataFrame, hints: DataFrame, guesses: DataFrame, scraped: DataFrame) -> DataFrame:
    """Per domain its board from the first tier that knows one: pins, hints, guesses, scraped pages; each has (domain, ats, token)."""
    tiers = [t.select("domain", F.struct(F.lit(i).alias("tier"), "ats", "token").alias("b")) for i, t in enumerate((pins, hints, guesses, scraped))]
    every = tiers[0]
    for t in tiers[1:]:
        every = every.unionByName(t)
    return every.groupBy("domain").agg(F.min("b").alias("b")).select("domain", "b.ats", "b.token", "b.tier")


def company_names(answers: DataFrame) -> DataFrame:
    """(domain, company_name): the name that most of a domain's answers give; ties to the first in order."""
    counts = answers.where("name <> ''").groupBy("domain", "name").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("domain").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("company_name"))


def logos(tiers: DataFrame) -> DataFrame:
    """(domain, logo_url, logo_source) of the first tier (board, site, favicon as 0, 1, 2) whose image was verified."""
    return tiers.where("verified").groupBy("domain").agg(F.min_by(F.struct("logo_url", "logo_source"), "tier").alias("l")).select("domain", "l.*")


def discovery_queue(pending: DataFrame, found: DataFrame, tracked: DataFrame, healthy: bool, size: int = 200) -> DataFrame:
    """Candidates (ats, token, local_jobs, jobs) to be merged next; nothing while the poll is unhealthy."""
    both = pending.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in ("ats", "token", "_new")]
    one = both.groupBy("ats", "token").agg(F.min_by(F.struct(*rest), "_new").alias("r")).select("ats", "token", "r.*")
    left = one.join(tracked.select("ats", "token"), ["ats", "token"], "left_anti").orderBy(F.desc("local_jobs"), F.desc("jobs"), "ats", "token")
    return left.limit(size if healthy else 0)


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    """(ats, domain, uid, token, jobs_seen) of files of pinned boards: under a kind's name a list of entries, a field a line.

    Every value is text, whatever it looks like; jobs_seen alone is a number, 0 where it is none. Quotes around a value go, comments
    too. Entries without a domain are left out; of a domain's entries of a kind in one file the last counts. A folder's files are read by many tasks.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    lines = files.where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    kind = F.nullif(F.regexp_extract("line", r"^([A-Za-z_][\w.-]*):\s*(#.*)?$", 1), F.lit(""))
    so_far = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    entry = r"^\s+(?:-\s+)?([\w.-]+):\s*(.*?)\s*$"
    rows = lines.select("file", "n", F.last(kind, True).over(so_far).alias("ats"), F.sum(F.col("line").rlike(r"^\s*-\s").cast("int")).over(so_far).alias("entry"), F.regexp_extract("line", entry, 1).alias("key"), F.regexp_extract("line", entry, 2).alias("raw")).where("key <> '' and entry > 0")
    quoted = r"""^(?:"([^"]*)"|'([^']*)').*$"""
    value = F.when(F.col("raw").rlike(quoted), F.concat(F.regexp_extract("raw", quoted, 1), F.regexp_extract("raw", quoted, 2))).otherwise(F.regexp_replace("raw", r"\s+#.*$", ""))
    fields = {f: F.max_by(F.when(F.col("key") == f, value), F.when(F.col("key") == f, F.col("n"))) for f in ("domain", "uid", "token", "jobs_seen")}
    each = rows.groupBy("file", "ats", "entry").agg(*[c.alias(f) for f, c in fields.items()]).where("domain <> ''")
    last = each.groupBy("file", "ats", "domain").agg(F.max_by(F.struct("uid", "token", "jobs_seen"), "entry").alias("e"))
    return last.select("ats", "domain", "e.uid", "e.token", F.when(F.col("e.jobs_seen").isNotNull(), F.coalesce(F.col("e.jobs_seen").try_cast("int"), F.lit(0))).alias("jobs_seen"))


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """(domain, ats, token) of JSON files of boards that were resolved before; entries without one of them, and files that are no JSON, are left out."""
    rows = spark.read.schema("domain string, ats string, token string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where("domain <> '' and ats <> '' and token <> ''")
