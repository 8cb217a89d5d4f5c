"""The explore mart and the builder of grouped questions over it."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_key, days_open, month_key, week_key

# What a builder question may filter and group by.
PICKS = {"company": "company_domain", "ats": "ats", "category": "category", "seniority": "seniority", "workplace": "workplace_type", "country": "country"}
TEXTS = {"title": "title", "location": "location"}
DATES = {"first_seen": "first_seen", "closed_at": "closed_at"}
GROUPS = {"none": None, **PICKS, "skill": "skill", "day": "day", "week": "week", "month": "month"}
TIME_GROUPS = {"day", "week", "month"}
METRICS = {"count", "avg_days_open", "share"}
DEFAULT_LIMIT, MAX_LIMIT = 25, 5000
MART_COLUMNS = ["id", "title", "company_domain", "ats", "location", "country", "category", "seniority", "workplace_type", "first_seen", "closed_at", "posted_at", "days_open", "salary_min_ils", "salary_max_ils", "salary_source", "url"]


def mart(jobs: DataFrame, companies: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    """The mart's five tables: jobs, job_skills, companies, facets, meta."""
    slim = jobs.withColumn("days_open", days_open(F.col("first_seen"), F.col("closed_at"), F.lit(as_of)))
    slim = slim.withColumn("country", F.element_at("country", 1) if dict(jobs.dtypes)["country"].startswith("array") else F.col("country"))
    out = {"jobs": slim.select(*[c for c in MART_COLUMNS if c in slim.columns])}
    copied = ["id", "company_domain", "ats", "category", "seniority", "workplace_type", "country", "first_seen", "closed_at", "days_open"]
    out["job_skills"] = slim.select(*[c for c in copied if c in slim.columns], F.explode(F.array_distinct(F.transform("skills", lambda x: F.lower(F.trim(x))))).alias("skill")).where("skill <> ''")
    open_ = slim.where("closed_at is null").groupBy(F.col("company_domain").alias("domain")).agg(F.count(F.lit(1)).alias("open_jobs"))
    out["companies"] = companies.select("domain", "company_name", "ats").join(open_, "domain", "left").withColumn("open_jobs", F.coalesce("open_jobs", F.lit(0).cast("long")))
    label = F.coalesce(F.nullif("company_name", F.lit("")), F.col("domain"))
    facets = [facet(out["jobs"], c, f) for f, c in PICKS.items() if c in out["jobs"].columns and f != "company"]
    facets.append(facet(out["job_skills"], "skill", "skill"))
    facets.append(out["companies"].where("open_jobs > 0").select(F.lit("company").alias("field"), F.col("domain").alias("value"), label.alias("label"), F.col("open_jobs").alias("n")))
    out["facets"] = reduce(DataFrame.unionByName, facets)
    out["meta"] = jobs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("jobs").alias("key"), F.col("n").cast("string").alias("value"))
    return out


def facet(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(field, value, label, n) of open rows."""
    return rows.where(F.col("closed_at").isNull() & (F.col(column) != "")).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("field"), "value", F.col("value").alias("label"), "n")


def clamp(limit) -> int:
    """25 for 0 and what is no number, else within 1 and 5000."""
    try:
        n = int(float(limit))
    except (TypeError, ValueError, OverflowError):
        return DEFAULT_LIMIT
    return DEFAULT_LIMIT if n == 0 else max(1, min(MAX_LIMIT, n))


def status(state: dict) -> Column:
    return {"open": F.col("closed_at").isNull(), "closed": F.col("closed_at").isNotNull()}.get(state.get("status", "open"), F.lit(True))


def clause(f: dict, skills: DataFrame | None = None) -> Column | None:
    """One filter as a Column; None for empty, blank and unknown ones. Skills are a join, not a clause."""
    field = f.get("field")
    if field in PICKS:
        values = [v for v in f.get("values") or [] if v not in (None, "")]
        return F.col(PICKS[field]).isin(values) if values else None
    if field in TEXTS and (f.get("text") or "").strip():
        return F.col(TEXTS[field]).ilike(f"%{f['text'].strip()}%")
    if field in DATES:
        parts = [F.col(DATES[field]) >= F.lit(f["from"]).cast("timestamp")] if f.get("from") else []
        parts += [F.col(DATES[field]) < F.date_add(F.lit(f["to"]).cast("date"), 1).cast("timestamp")] if f.get("to") else []
        return reduce(and_, parts) if parts else None
    return None


def build(state: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of a builder state {status, filters, group, metric, limit}: (value, metric columns), or listings without a group.

    A share is of all rows of the status, whatever the filters. Grouped by skill, a listing counts once for
    each skill; any other grouping counts it once. Times ascend, other groups descend by the metric.
    """
    jobs, skills = tables["jobs"], tables["job_skills"]
    group, metric, limit = state.get("group", "none"), state.get("metric", "count"), clamp(state.get("limit"))
    if group not in GROUPS or metric not in METRICS:
        raise ValueError("unknown group or metric")
    base = skills if group == "skill" else jobs
    rows = base.where(status(state))
    for f in state.get("filters") or []:
        values = [str(v).lower() for v in f.get("values") or [] if v]
        if f.get("field") == "skill" and values:
            rows = rows.join(skills.where(F.col("skill").isin(values)).select("id").distinct(), "id", "left_semi")
        elif (c := clause(f)) is not None and all(x in base.columns for x in [PICKS.get(f["field"]) or TEXTS.get(f["field"]) or DATES.get(f["field"])]):
            rows = rows.where(c)
    if group == "none":
        return rows.orderBy(F.col("first_seen").desc_nulls_last(), F.col("id").desc()).limit(limit)
    keys = {"day": day_key(F.col("first_seen")), "week": week_key(F.col("first_seen")), "month": month_key(F.col("first_seen"))}
    value = keys.get(group, F.col(GROUPS[group])) if group in keys else F.col(GROUPS[group])
    grouped = rows.groupBy(value.alias("value"))
    if metric == "avg_days_open":
        out = grouped.agg(F.round(F.avg("days_open"), 1).alias("metric"))
    elif metric == "share":
        whole = jobs.where(status(state)).agg(F.count(F.lit(1)).alias("_all"))
        out = grouped.agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(whole)).select("value", F.round(F.lit(100.0) * F.col("_n") / F.col("_all"), 1).alias("metric"))
    else:
        out = grouped.agg(F.count(F.lit(1)).alias("metric"))
    by = [F.col("value").asc_nulls_last()] if group in TIME_GROUPS else [F.col("metric").desc_nulls_last(), F.col("value").asc_nulls_last()]
    return out.orderBy(*by).limit(limit)


def distinct_listings(rows: DataFrame, copied: list[str], value: Column) -> DataFrame:
    """Counts by value of listings that skill rows repeat: the copied columns are made distinct first."""
    return rows.select(*copied).distinct().groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def having_share(rows: DataFrame, key: str, flag: Column, least: int) -> DataFrame:
    """Per key the rows, those with the flag, and their share, for keys with more than `least` rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("hits")).where(F.col("n") > least).withColumn("share", F.col("hits") / F.col("n")).orderBy(F.desc("share"), key)


def sql(spark: SparkSession, tables: dict[str, DataFrame], text: str, shown: int = 2000) -> DataFrame:
    """A user's SELECT over the mart's tables; at most `shown` rows are for the screen."""
    if not text.strip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT is answered")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text).limit(shown)


def chart(schema: list[tuple[str, str]], rows: int) -> tuple[str, str | None]:
    """(kind, value column) that suit a result's columns: line over times, bar over few values, else table."""
    numbers = [n for n, t in schema if t in ("int", "bigint", "double", "float", "long") or t.startswith("decimal")]
    labels = [n for n, _ in schema if n not in numbers]
    if len(schema) < 2 or not numbers or not labels:
        return "table", None
    if labels[0] in ("day", "week", "month", "date"):
        return "line", numbers[-1]
    return ("bar", numbers[-1]) if rows <= 50 else ("table", None)
