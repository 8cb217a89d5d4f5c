"""Saved questions: new matches since an alert's last answer, digests that are due, watched companies.

Alerts are a table of any length. `questions` reads their parameters with the rules of `predicates.compile_filters`, as columns, and puts
equal questions together; `matches` answers all of them in one scan of the listings. A question is looked up under its rarest kind of
condition, its anchor: listings carry a posting for each of their values, and meet the questions in an equi-join on
(attribute, value). All other conditions are checked on the pair: sets of values first, then words, then ranges. No expression of the plan
is an alert's own, so the plan is the same for two alerts and for a million. Listings carry postings of those attributes only that are some question's anchor; where
an attribute has at most `FEW` questions, they go to the listings, else both meet in a shuffle. Only the newest matches of a question are kept, before they are shuffled too,
and an alert takes from them what came after its last answer. Listings are asked from the newest on, in `SLICES`: a question that is full in the newer ones does not meet the older ones.
Watched companies keep no listings of a question, so they are all found, in a semi-join: a listing stops at the first question that it answers.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_between
from ..functions.places import names_israel
from ..functions.status import digest_due
from ..functions.text import MAX_TERMS
from .predicates import IN_FILTERS, MAX_CITIES, MAX_COUNTRIES, MAX_IDS, MAX_SKILLS, SEARCH_FIELDS, TRUE, compile_filters, fresh
from .versions import settled

MATCHES, WATCH_DAYS = 50, 14
#: Attributes with postings, those of fewer listings a value first; a question's anchor is the first that it has.
ANCHORS = ["id", "company_domain", "city", "location", "skills", "country", "category", "ats", "seniority", "workplace_type"]
#: The anchor of questions without any of them.
ANY = "any"
#: Questions of an attribute that may be broadcast; listings that are one slice; the parts of more that are asked first, the newest.
FEW, WHOLE, SLICES = 10_000, 200_000, [1 / 64, 1 / 8]


def _given(name: str) -> Column:
    return F.col("filter")[name]


def _listed(raw: Column) -> Column:
    """The values of a comma list, trimmed, without empty ones; empty for null."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def _flag(name: str) -> Column:
    return F.coalesce(F.lower(F.trim(_given(name))).isin(sorted(TRUE)), F.lit(False))


def _whole(name: str) -> Column:
    """An integer parameter; null for none."""
    return F.when(_given(name).rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(_given(name)).cast("int"))


def _pay(name: str) -> Column:
    n = F.when(_given(name).rlike(r"^\d{1,15}$"), _given(name).cast("long"))
    return F.when(n > 0, n)


def _terms(raw: Column) -> Column:
    """Quoted phrases whole, the rest by white space, the first MAX_TERMS of them, in lower case as patterns."""
    found = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r'("[^"]+"|\S+)'), F.lit(1))
    bare = F.filter(F.transform(found, lambda t: F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, r'^"([^"]+)"$', "$1")), r'^"+|"+$', ""))), lambda t: t != "")
    return F.transform(F.slice(bare, 1, MAX_TERMS), _pattern)


def _pattern(term: Column) -> Column:
    return F.concat(F.lit("%"), F.lower(term), F.lit("%"))


def questions(alerts: DataFrame) -> DataFrame:
    """alerts (alert_id, filter map<string,string>) with `question`, what a filter asks, and `error`, why it asks nothing.

    question: confidence, closed, outdated (whether they are wanted too), tech, israel; sets (attribute -> wanted values); q, terms, any_term, keywords as
    patterns; min_age, max_age in days; pay_from, pay_to, pay_known, pay_stated. Values that the rules refuse are dropped; a
    confidence that is none and an age that is no integer are errors, and such an alert matches nothing.
    """
    distinct = lambda c, most: F.slice(F.array_distinct(c), 1, most)
    sets = {column: F.array_distinct(_listed(_given(name))) for name, column in IN_FILTERS.items()}
    sets["id"] = F.slice(F.filter(_listed(_given("ids")), lambda x: x.rlike("^[0-9a-f]{8,64}$")), 1, MAX_IDS)
    sets["skills"] = distinct(F.transform(_listed(_given("skills")), lambda x: F.lower(x)), MAX_SKILLS)
    sets["country"] = distinct(F.filter(F.transform(_listed(_given("country")), lambda x: F.upper(x)), lambda x: x.rlike("^[A-Z]{2}$")), MAX_COUNTRIES)
    sets["city"] = distinct(F.filter(_listed(_given("city")), lambda x: x.rlike(r"^(?U)[\w .'\-]{1,60}$")), MAX_CITIES)
    entries = F.array(*[F.struct(F.lit(a).alias("key"), F.array_sort(sets[a]).alias("value")) for a in ANCHORS])
    confidence = F.coalesce(F.when(_given("confidence") != "", _given("confidence")), F.lit("verified"))
    q = F.trim(F.coalesce(_given("q"), F.lit("")))
    asked = {
        "confidence": confidence, "closed": _flag("include_closed"), "outdated": _flag("include_outdated"), "tech": F.coalesce(_given("roles") == "tech", F.lit(False)), "israel": _flag("israel_only"),
        "sets": F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0)), "q": F.when(q != "", _pattern(q)), "terms": _terms(_given("search")),
        "any_term": F.coalesce(_given("search_mode") == "any", F.lit(False)), "keywords": F.transform(F.filter(F.transform(F.split(F.coalesce(_given("keywords"), F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != ""), _pattern),
        "min_age": _whole("min_age_days"), "max_age": _whole("max_age_days"), "pay_from": _pay("salary_min"), "pay_to": _pay("salary_max"), "pay_known": _flag("salary_known"), "pay_stated": _flag("salary_disclosed"),
    }
    wrong = lambda name: F.coalesce((_given(name) != "") & _whole(name).isNull(), F.lit(False))
    error = F.when(~confidence.isin("verified", "best_effort", "all"), "confidence must be verified, best_effort or all").when(wrong("min_age_days"), "min_age_days must be an integer").when(wrong("max_age_days"), "max_age_days must be an integer")
    return alerts.withColumns({"question": F.struct(*[c.alias(n) for n, c in asked.items()]), "error": error})


def _pairs(attribute: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(attribute).alias("attribute"), v.alias("value")))


def _postings(attributes: list[str], dtypes: dict[str, str]) -> Column:
    """A listing's (attribute, value) pairs of some attributes; for ANY, the one of questions without an anchor."""
    none = F.array().cast("array<struct<attribute:string,value:string>>")
    values = {a: F.transform(F.col(a), lambda x: F.lower(x)) if a == "skills" else F.col(a) if dtypes[a].startswith("array") else F.array(F.col(a).cast("string")) for a in attributes if a in dtypes}
    each = [_pairs(a, F.filter(F.array_distinct(v), lambda x: x.isNotNull())) for a, v in values.items()]
    each = [F.coalesce(x, none) for x in each]
    return F.concat(none, *each, *[F.array(F.struct(F.lit(ANY).alias("attribute"), F.lit("").alias("value"))) for a in attributes if a == ANY])


def _holds(question: Column, columns: list[str], dtypes: dict[str, str], as_of: datetime) -> Column:
    """Whether a listing answers a question, all conditions at once."""
    field = lambda name: question[name]
    parts = [field("closed") | F.col("closed_at").isNull(), (field("confidence") == "all") | (F.col("confidence") == field("confidence")), field("outdated") | fresh(as_of)]
    tech = F.col("role_class") == "tech" if "role_class" in columns else F.lit(False)
    parts.append(~field("tech") | tech)
    for a in ANCHORS:
        wanted = field("sets")[a]
        if a not in columns:
            parts.append(wanted.isNull())
        elif dtypes[a].startswith("array"):
            parts.append(wanted.isNull() | F.arrays_overlap(F.transform(F.col(a), lambda x: F.lower(x)) if a == "skills" else F.col(a), wanted))
        else:
            parts.append(wanted.isNull() | F.array_contains(wanted, F.col(a).cast("string")))
    home = F.array_contains("country", "IL") if "country" in columns else names_israel(F.col("location"))
    parts.append(~field("israel") | home)
    texts = {c: F.lower(F.col(c)) for c in SEARCH_FIELDS if c in columns}
    like = lambda t, names: F.greatest(*[F.coalesce(F.like(texts[c], t), F.lit(False)) for c in names if c in texts], F.lit(False))
    parts.append(field("q").isNull() | like(field("q"), ["title", "company_domain", "location", "department"]))
    some, every = (f(field("terms"), lambda t: like(t, SEARCH_FIELDS)) for f in (F.exists, F.forall))
    parts.append((F.size(field("terms")) == 0) | F.when(field("any_term"), some).otherwise(every))
    parts.append(F.forall(field("keywords"), lambda t: like(t, ["title", "description"])))
    age = days_between(F.lit(as_of), F.col("posted_at"))
    parts += [field("min_age").isNull() | (F.col("posted_at").isNotNull() & (age >= field("min_age"))), field("max_age").isNull() | (F.col("posted_at").isNotNull() & (age <= field("max_age")))]
    if "salary_min_ils" in columns:
        low, high = F.col("salary_min_ils"), F.col("salary_max_ils")
        parts += [field("pay_from").isNull() | high.isNull() | (high >= field("pay_from")), field("pay_to").isNull() | low.isNull() | (low <= field("pay_to")), ~field("pay_known") | low.isNotNull()]
        parts.append(~field("pay_stated") | (F.col("salary_source") == "disclosed"))
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


SHOWN = ["id", "company_domain", "title", "first_seen"]


def matches(jobs: DataFrame, alerts: DataFrame, as_of: datetime, limit: int = MATCHES, since: datetime | None = None) -> DataFrame:
    """(alert_id, id, company_domain, title, first_seen): of each alert the newest listings first seen after its last answer.

    alerts: alert_id, filter (map<string,string>), last_notified_at (null: all are new); since stands for all of them where it is given. An inactive
    alert (a column active that is not true) has no answer. Of equal alert_ids each is answered by itself.
    """
    # the newest `limit` of a question's matches hold the newest of each of its alerts
    asked, anchored = _anchored(alerts, since)
    seen, micros = F.col("first_seen").cast("timestamp"), F.unix_micros(F.col("first_seen").cast("timestamp"))
    oldest = anchored.agg(F.unix_micros(F.min("_from"))).first()[0]
    rows = jobs.where(micros > (oldest or 0))
    n, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx(micros, [1 - x for x in SLICES], 1000)).first() if oldest is not None else (0, None)
    bounds = [None, *dict.fromkeys(cuts), None] if n > WHOLE else [None, None]
    found, left = None, anchored
    for k, (high, low) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        per = _per(left)
        part = rows if high is None else rows.where(micros < high)
        part = part if low is None else part.where(micros >= low)
        new = newest(_met(part, left, per, as_of), limit, "_key")
        if k == len(bounds) - 2:
            found = newest(found.unionByName(new), limit, "_key") if found is not None else new
            break
        new = settled(new, "matches")
        found = new if found is None else found.unionByName(new)
        full = found.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).select("_key")
        left = anchored.join(full, "_key", "left_anti")
    told = found.join(asked.select("alert_id", "after", "key"), F.col("_key") == F.col("key")).where(F.col("after").isNull() | (seen > F.col("after")))
    return told.select("alert_id", *SHOWN)


def _anchored(alerts: DataFrame, since: datetime | None) -> tuple[DataFrame, DataFrame]:
    """(alert_id, after, question, key) of active alerts without an error, and (_key, _q, _from, _a, _v) of their different questions, a row for each value of the anchor."""
    live = alerts.where("active") if "active" in alerts.columns else alerts
    after = F.lit(since).cast("timestamp") if since else F.col("last_notified_at").cast("timestamp")
    asked = questions(live).where("error is null").select("alert_id", after.alias("after"), "question", F.sha2(F.to_json("question").cast("binary"), 256).alias("key"))
    own = asked.groupBy("key").agg(F.any_value("question").alias("_q"), F.min(F.coalesce("after", F.timestamp_seconds(F.lit(-(1 << 38))))).alias("_from"))
    sets = F.col("_q.sets")
    anchors = [F.when(sets[a].isNotNull(), _pairs(a, sets[a])) for a in ANCHORS]
    first = F.coalesce(*anchors, F.array(F.struct(F.lit(ANY).alias("attribute"), F.lit("").alias("value"))))
    anchored = own.select(F.col("key").alias("_key"), "_q", "_from", F.explode(first).alias("_anchor")).select("_key", "_q", "_from", F.col("_anchor.attribute").alias("_a"), F.col("_anchor.value").alias("_v"))
    return asked, settled(anchored, "questions")


def _per(anchored: DataFrame) -> dict[str, int]:
    """Questions of each attribute."""
    return {r["_a"]: r["n"] for r in anchored.groupBy("_a").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each attribute


def _met(jobs: DataFrame, anchored: DataFrame, per: dict[str, int], as_of: datetime, pairs: bool = True) -> DataFrame:
    """(_key, SHOWN): listings that answer a question, met at its anchor; without pairs SHOWN of those that answer any. per: questions of each attribute."""
    dtypes, sets, out = dict(jobs.dtypes), F.col("_q.sets"), []
    # a listing with several of the anchor's values meets the question at each of them, and counts at the first
    once = F.lit(True)
    for a in ("skills", "country", "city"):
        if a in jobs.columns:
            own_values = F.transform(F.col(a), lambda x: F.lower(x)) if a == "skills" else F.col(a)
            once = F.when(F.col("_a") == a, F.array_min(F.array_intersect(own_values, sets[a])) == F.col("_v")).otherwise(once)
    for few in (True, False):
        own = [a for a in [*ANCHORS, ANY] if (per.get(a, 0) <= FEW) == few and a in per]
        if not own and (few and len(per) or not few):
            continue
        posted = jobs.withColumn("_p", F.explode(_postings(own, dtypes)))
        asking = anchored.where(F.col("_a").isin(own))
        asking = F.broadcast(asking) if few else asking.hint("merge")
        at_anchor = (F.col("_p.attribute") == F.col("_a")) & (F.col("_p.value") == F.col("_v"))
        new, answers = F.col("first_seen").cast("timestamp") > F.col("_from"), _holds(F.col("_q"), jobs.columns, dtypes, as_of)
        if pairs:
            out.append(posted.join(asking, at_anchor).where(new & once).where(answers).select("_key", *SHOWN))
        else:
            out.append(posted.join(asking, at_anchor & new & answers, "left_semi").select(*SHOWN))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def as_table(spark, alerts: list[dict]) -> DataFrame:
    """A few alerts as a table of them."""
    rows = [(a["alert_id"], {k: None if v is None else str(v) for k, v in (a.get("filter") or {}).items()}, a.get("last_notified_at")) for a in alerts]
    return spark.createDataFrame(rows, "alert_id string, filter map<string,string>, last_notified_at timestamp")


def new_matches(jobs: DataFrame, alerts: list[dict], as_of: datetime, limit: int = MATCHES) -> DataFrame:
    """`matches` of a user's few saved questions: {alert_id, filter, last_notified_at}; ValueError for a filter that is none."""
    for a in alerts:
        compile_filters(a.get("filter") or {}, as_of)
    return matches(jobs, as_table(jobs.sparkSession, alerts), as_of, limit)


def newest(rows: DataFrame, limit: int, key: str = "alert_id", at: str = "first_seen", tie: str = "id") -> DataFrame:
    """The newest rows of each alert; a task first keeps its own newest, so a question with many matches is not shuffled whole."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    return rows.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n").select(key, *[c for c in rows.columns if c != key])


def due_alerts(alerts: DataFrame, as_of: datetime) -> DataFrame:
    """Active alerts whose cadence lets an answer go out now."""
    return alerts.where("active").where(digest_due(F.col("cadence"), F.col("last_digest_at"), F.lit(as_of), F.col("digest_time"), F.col("digest_tz"), F.col("digest_day")))


def digest(matches: DataFrame) -> DataFrame:
    """Per alert the number of matches, of companies, and the newest one."""
    return matches.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("company_domain").alias("companies"), F.max_by("title", F.struct("first_seen", "id")).alias("newest_title"))


def watched_by(jobs: DataFrame, alerts: DataFrame, as_of: datetime) -> DataFrame:
    """Domains that a table of alerts names, or whose listings matched one in the last 14 days: all of them, however many listings match."""
    named = questions(alerts).where("error is null").select(F.explode(F.col("question.sets")["company_domain"]).alias("domain"))
    since = as_of - timedelta(days=WATCH_DAYS)
    anchored = _anchored(alerts, since)[1]
    recent = _met(jobs.where(F.col("first_seen").cast("timestamp") > F.lit(since).cast("timestamp")), anchored, _per(anchored), as_of, pairs=False).select(F.col("company_domain").alias("domain"))
    return recent.unionByName(named).distinct()


def watched(jobs: DataFrame, alerts: list[dict], as_of: datetime) -> DataFrame:
    """`watched_by` of a few alerts."""
    return watched_by(jobs, as_table(jobs.sparkSession, alerts), as_of)
