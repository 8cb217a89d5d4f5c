"""Pages of listings: projection, orders, scores, details."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between
from ..functions.taxonomy import category
from .predicates import compile_filters, integer, lowered, skills
from .search import relevance

SORTS = {"age", "company", "title", "location", "ats", "match", "relevance"}
DEFAULT_LIMIT, MAX_LIMIT, MAX_OFFSET, STORED_SKILLS = 100, 500, 10_000_000, 15
MATCH_DECAY, RELEVANCE_DECAY, DECAY_DAYS = 1, 5, 14


def match_score(wanted: list[str]) -> Column:
    """How many of the wanted labels a listing has, whatever their case."""
    return F.least(F.size(F.array_intersect(lowered(F.coalesce("skills", F.array().cast("array<string>"))), F.array(*[F.lit(w.lower()) for w in wanted]).cast("array<string>"))), F.lit(STORED_SKILLS))


def fortnights(as_of: datetime) -> Column:
    """Whole fortnights since the listing was posted; 0 for none and for dates ahead."""
    age = days_between(F.lit(as_of), F.col("posted_at"))
    return F.greatest(F.coalesce(F.floor(age / DECAY_DAYS), F.lit(0)), F.lit(0))


def order(params: dict, as_of: datetime) -> list[Column]:
    """The total order of a page: nulls last, id last of all. Without skills or terms, match and relevance fall back to age.

    `dir` is the direction of what is sorted by, so of the age itself: asc has the newest first. `order` is that of the date.
    """
    sort = params.get("sort") or "age"
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(sorted(SORTS))}")
    newest = [F.col("posted_at").desc_nulls_last(), F.col("id").desc()]
    wanted = skills(params)
    if sort == "match" and wanted:
        return [(match_score(wanted) - MATCH_DECAY * fortnights(as_of)).desc(), *newest]
    if sort == "relevance" and params.get("search"):
        return [(relevance(params["search"]) - RELEVANCE_DECAY * fortnights(as_of)).desc(), *newest]
    way = params.get("dir")
    up = params.get("order") == "asc" or way == "desc"
    if sort in ("age", "match", "relevance"):
        return [F.col("posted_at").asc_nulls_last() if up else newest[0], newest[1]]
    column = {"company": "company_domain"}.get(sort, sort)
    key = F.lower(F.trim(F.col(column)))
    down = "desc" in (params.get("order"), way)
    return [key.desc_nulls_last() if down else key.asc_nulls_last(), newest[1]]


def salary_source(jobs: DataFrame) -> Column:
    """The stored source; where the column is absent, null without pay, else `table` for estimates and `disclosed`."""
    if "salary_source" in jobs.columns:
        return F.col("salary_source")
    return F.when(F.col("salary_text").isNull(), None).when(F.col("salary_is_estimate"), "table").otherwise("disclosed")


def apply_url(kind: str = "comeet") -> Column:
    """The stored address; for one kind of board a link rebuilt from the company's token, if it has one."""
    rebuilt = F.concat(F.lit("https://www."), F.lit(kind), F.lit(".com/jobs/"), F.col("token"), F.lit("/"), F.col("external_id"))
    return F.when((F.col("ats") == kind) & F.col("token").isNotNull() & F.col("external_id").isNotNull(), rebuilt).otherwise(F.col("url"))


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """jobs with company_name, logo_url and token of at most one company row; null for an unknown company."""
    names = [c for c in ("company_name", "logo_url", "token") if c in companies.columns]
    one = companies.groupBy(F.col("domain").alias("_domain")).agg(*[F.max(c).alias(c) for c in names])
    return jobs.join(one, jobs["company_domain"] == F.col("_domain"), "left").drop("_domain")


def page(jobs: DataFrame, companies: DataFrame, params: dict, as_of: datetime) -> DataFrame:
    """One page of a question. The page's rows are chosen before companies are joined, so the join sees a page only."""
    limit = 0 if params.get("count") == "only" else integer(params, "limit", DEFAULT_LIMIT, 1, MAX_LIMIT)
    offset = integer(params, "offset", 0, 0, MAX_OFFSET)
    found = jobs.where(compile_filters(params, as_of)).orderBy(*order(params, as_of)).offset(offset).limit(limit)
    # a page is MAX_LIMIT rows at most, so its domains are handed out and companies are read by them, not summed up as a whole
    asked = F.broadcast(found.select(F.col("company_domain").alias("domain")).distinct())
    shown = with_company(found, companies.join(asked, "domain", "left_semi"))
    source, wanted = salary_source(jobs), skills(params)
    extra = {"category": F.coalesce(F.col("category"), category(F.col("department"), F.col("title"))) if "category" in jobs.columns else category(F.col("department"), F.col("title")), "salary_source": source}
    if "token" in shown.columns and "external_id" in shown.columns:
        extra["url"] = apply_url()
    if wanted:
        extra["match_score"] = match_score(wanted)
    return shown.withColumns(extra).drop("description").orderBy(*order(params, as_of))


def total(jobs: DataFrame, params: dict, as_of: datetime) -> int | None:
    """The number of rows of the question; None where count=skip. With count=only it is all there is: the page is empty."""
    return None if params.get("count") == "skip" else jobs.where(compile_filters(params, as_of)).count()


def detail(jobs: DataFrame, descriptions: DataFrame, job: str) -> DataFrame:
    """One listing, open or closed, with the text of its blob or else its own."""
    text = descriptions.where(F.col("job_id") == job).select(F.col("job_id").alias("id"), F.col("text").alias("_text"))
    row = jobs.where(F.col("id") == job).join(text, "id", "left")
    return row.withColumn("description", F.coalesce("_text", "description")).drop("_text")


def company_facts(jobs: DataFrame) -> DataFrame:
    """Per company: listings of all time, open ones, first sight, last close if none is open, cities and departments by frequency."""
    open_ = F.col("closed_at").isNull()
    facts = jobs.groupBy("company_domain").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("open"), F.min("first_seen").alias("first_seen"),
        F.when(F.count_if(open_) == 0, F.max("closed_at")).alias("last_close"),
    )
    for field in ("city", "department"):
        value = F.explode("city") if field == "city" else F.col(field)
        counts = jobs.where(open_).select("company_domain", value.alias("v")).where("v <> ''").groupBy("company_domain", "v").count()
        top = counts.groupBy("company_domain").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("v")))), lambda x: x["v"]).alias(f"by_{field}"))
        facts = facts.join(top, "company_domain", "left")
    return facts
