"""Statistics of the board; each takes its clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.dates import days_between
from . import exact
from .predicates import compile_filters, fresh

DORMANT_DAYS, SERIES_DAYS = 60, 14


def open_rows(jobs: DataFrame, as_of: datetime) -> DataFrame:
    """Open, verified, fresh."""
    return jobs.where(F.col("closed_at").isNull() & (F.col("confidence") == "verified") & fresh(as_of))


def age(as_of: datetime, column: str = "posted_at") -> Column:
    return days_between(F.lit(as_of), F.col(column))


def within(column: str, as_of: datetime, **span: float) -> Column:
    """At or after so long before the clock; false for null."""
    return F.coalesce(F.col(column) >= F.lit(as_of - timedelta(**span)), F.lit(False))


def scoped(rows: DataFrame, as_of: datetime) -> DataFrame:
    """One row: total, companies, median and greatest age, added and closed in a day and a week."""
    median = F.lit(exact.middle(rows, age(as_of))).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("company_domain").alias("companies"), F.first(median).alias("median_age"), F.max(age(as_of)).alias("oldest"),
        F.count_if(within("first_seen", as_of, hours=24)).alias("added_24h"), F.count_if(within("first_seen", as_of, days=7)).alias("added_7d"),
        F.count_if(within("closed_at", as_of, hours=24)).alias("closed_24h"), F.count_if(within("closed_at", as_of, days=7)).alias("closed_7d"),
    )


def throughput(jobs: DataFrame, as_of: datetime, added: str = "first_seen", closed: str = "closed_at") -> DataFrame:
    return jobs.agg(
        F.count_if(within(added, as_of, hours=24)).alias("added_24h"), F.count_if(within(added, as_of, days=7)).alias("added_7d"),
        F.count_if(within(closed, as_of, hours=24)).alias("closed_24h"), F.count_if(within(closed, as_of, days=7)).alias("closed_7d"),
    )


def top(rows: DataFrame, column: str, limit: int = 10) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(limit)


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("company_domain").alias("companies"))


def ages(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Mean, median and greatest age of rows with a date."""
    a = age(as_of)
    return rows.agg(F.avg(a).alias("mean"), F.first(F.lit(exact.middle(rows, a)).cast("double")).alias("median"), F.max(a).alias("oldest"))


def dormant(rows: DataFrame, as_of: datetime) -> DataFrame:
    """How many rows with a date are older than 60 days, of how many, and the share to four places."""
    n, old = F.count("posted_at"), F.count_if(age(as_of) > DORMANT_DAYS)
    return rows.agg(old.alias("dormant"), n.alias("sample"), F.round(old / n, 4).alias("share"))


def cross_tab(rows: DataFrame, first: str = "category", second: str = "seniority") -> DataFrame:
    return rows.where(F.col(first).isNotNull()).groupBy(first, F.coalesce(F.col(second), F.lit("unstated")).alias(second)).agg(F.count(F.lit(1)).alias("n"))


def rolled_up(tab: DataFrame, first: str = "category", limit: int = 20) -> DataFrame:
    return tab.groupBy(first).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), first).limit(limit)


def with_unstated(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("unstated")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def stated(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def skill_frequency(rows: DataFrame, skills: Column, limit: int = 30) -> DataFrame:
    """(skill, n) of single labels, trimmed and in lower case."""
    return rows.select(F.explode(F.transform(skills, lambda x: F.lower(F.trim(x)))).alias("skill")).where("skill <> ''").groupBy("skill").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "skill").limit(limit)


def skill_coverage(rows: DataFrame) -> DataFrame:
    some = F.count_if(F.size(F.coalesce("skills", F.array().cast("array<string>"))) > 0)
    return rows.agg(some.alias("covered"), F.count(F.lit(1)).alias("total"), (some / F.count(F.lit(1))).alias("share"))


def raw_locations(rows: DataFrame, israel: bool = False, limit: int = 40) -> DataFrame:
    rows = rows.where(F.array_contains("country", "IL")) if israel else rows
    return rows.where("trim(location) <> ''").groupBy("location").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "location").limit(limit)


def israel_split(rows: DataFrame) -> DataFrame:
    il, n = F.count_if(F.coalesce(F.array_contains("country", "IL"), F.lit(False))), F.count(F.lit(1))
    return rows.agg(il.alias("israel"), (n - il).alias("other"), n.alias("total"))


def movers(jobs: DataFrame, as_of: datetime, limit: int = 5) -> DataFrame:
    """Companies by verified fresh listings first seen within a week, closed ones included."""
    return top(jobs.where((F.col("confidence") == "verified") & fresh(as_of) & within("first_seen", as_of, days=7)), "company_domain", limit)


def pipeline_health(companies: DataFrame, as_of: datetime) -> DataFrame:
    """Companies with an error, and the minutes since the least recent and the latest check of resolved ones."""
    minutes = lambda c: F.timestamp_diff("MINUTE", c, F.lit(as_of))
    resolved = F.when(F.col("ats").isNotNull(), F.col("last_checked"))
    return companies.agg(F.count_if(F.col("error") != "").alias("errors"), minutes(F.min(resolved)).alias("oldest_minutes"), minutes(F.max("last_checked")).alias("freshness_minutes"))


def days(spark, last: datetime, n: int = SERIES_DAYS) -> DataFrame:
    """The n days that end with the clock's."""
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last.date()), n - 1), F.lit(last.date()))).alias("day"))


def daily_series(jobs: DataFrame, as_of: datetime, columns: dict[str, str], n: int = SERIES_DAYS) -> DataFrame:
    """Per day the number of rows with each column on it; days without any have 0."""
    out = days(jobs.sparkSession, as_of, n)
    for name, column in columns.items():
        counts = jobs.where(F.col(column).cast("date").between(F.lit((as_of - timedelta(days=n - 1)).date()), F.lit(as_of.date()))).groupBy(F.col(column).cast("date").alias("day")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, "day", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def open_history(jobs: DataFrame, as_of: datetime, first: str = "first_seen", closed: str = "closed_at", n: int = SERIES_DAYS) -> DataFrame:
    """Per day the lifecycles that cover it: first <= day and (no close or close > day).

    A lifecycle is +1 on its first day that counts and -1 on the first that does not; one running sum
    over the few days gives the history, whatever the number of lifecycles.
    """
    start = F.lit((as_of - timedelta(days=n - 1)).date())
    begin = F.greatest(F.when(F.col(first).cast("date").cast("timestamp_ntz") < F.col(first).cast("timestamp_ntz"), F.date_add(F.col(first).cast("date"), 1)).otherwise(F.col(first).cast("date")), start)
    end = F.when(F.col(closed).cast("date").cast("timestamp_ntz") < F.col(closed).cast("timestamp_ntz"), F.date_add(F.col(closed).cast("date"), 1)).otherwise(F.col(closed).cast("date"))
    end = F.when(end.isNotNull(), F.greatest(end, start))
    last = F.lit(as_of.date())
    steps = jobs.select(F.explode(F.array(F.struct(begin.alias("day"), F.lit(1).alias("d")), F.struct(F.greatest(begin, end).alias("day"), F.lit(-1).alias("d")))).alias("s"), end.alias("e"))
    steps = steps.where((F.col("s.d") == 1) | F.col("e").isNotNull()).select("s.day", "s.d").where(F.col("day") <= last).groupBy("day").agg(F.sum("d").alias("d"))
    running = F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days(jobs.sparkSession, as_of, n).join(steps, "day", "left").select("day", running.alias("open"))


def tech_share(rows: DataFrame, decided: Column, software: Column, key: str = "company_domain", least: int = 3, least_software: int = 2) -> DataFrame:
    """Software rows over decided ones, for companies with enough of both."""
    return rows.groupBy(key).agg(F.count_if(decided).alias("decided"), F.count_if(software).alias("software")).where((F.col("decided") >= least) & (F.col("software") >= least_software)).withColumn("share", F.col("software") / F.col("decided"))


def shared_timestamps(rows: DataFrame, column: str = "posted_at", least: int = 5, least_companies: int = 2, keep_midnight: bool = False) -> DataFrame:
    """Exact times that many rows of several companies share."""
    rows = rows if keep_midnight else rows.where(F.date_format(column, "HH:mm:ss") != "00:00:00")
    found = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("company_domain").alias("companies"))
    return found.where((F.col("n") >= least) & (F.col("companies") >= least_companies))


def health(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    a = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("closed_at").isNull()).alias("open"))
    b = companies.agg(F.count_if(F.col("ats").isNotNull()).alias("resolved"), F.max("last_checked").alias("last_checked"))
    return a.join(b)


def meta_counts(jobs: DataFrame) -> DataFrame:
    """Open rows by confidence as key and value."""
    return jobs.where("closed_at is null").groupBy(F.concat(F.lit("open_"), "confidence").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))


def name_coverage(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies and open listings, and how many of each have a name."""
    named = companies.select(F.col("domain").alias("company_domain"), (F.coalesce("company_name", F.lit("")) != "").alias("has"))
    both = rows.join(named, "company_domain", "left")
    has = F.coalesce("has", F.lit(False))
    return both.agg(F.count_distinct("company_domain").alias("companies"), F.count_distinct(F.when(has, F.col("company_domain"))).alias("named_companies"), F.count(F.lit(1)).alias("listings"), F.count_if(has).alias("named_listings"))


#: Companies of a scope's list; warnings that are stored, and that a health answer shows.
SCOPED_TOP, MOST_WARNINGS, SHOWN_WARNINGS = 10, 40, 20


def scoped_answer(jobs: DataFrame, params: dict, as_of: datetime, companies: DataFrame | None = None) -> DataFrame:
    """One row: the figures of a question's own rows, and what was added and closed in its scope.

    open_jobs, companies_hiring, median_open_days, oldest_open_days and top_companies (domain, n, logo_url) are of the rows that the question
    shows, so open_jobs is its total. new_* and closed_* lift what hides closed and outdated rows, and keep every filter that was asked for.
    One aggregate by company gives all counts; a null company counts its rows, not itself.
    """
    shown = compile_filters(params, as_of)
    wide = jobs.where(compile_filters(params | {"include_closed": "1", "include_outdated": "1"}, as_of)).withColumn("_shown", shown)
    flows = {"new_jobs_24h": ("first_seen", 1), "new_jobs_7d": ("first_seen", 7), "closed_jobs_24h": ("closed_at", 1), "closed_jobs_7d": ("closed_at", 7)}
    recent = [F.count_if(within(c, as_of, days=d)).alias(n) for n, (c, d) in flows.items()]
    per = wide.groupBy(F.col("company_domain").alias("domain")).agg(F.count_if(F.col("_shown")).alias("n"), F.max(F.when(F.col("_shown"), age(as_of))).alias("_oldest"), *recent).persist()
    listed = per.where("n > 0 and domain is not null").orderBy(F.desc("n"), "domain").limit(SCOPED_TOP)
    logo = F.lit(None).cast("string").alias("logo_url")
    if companies is not None:
        asked = companies.join(F.broadcast(listed.select("domain")), "domain", "left_semi").groupBy("domain").agg(F.max("logo_url").alias("logo_url"))
        listed, logo = listed.join(asked, "domain", "left"), F.col("logo_url")
    top10 = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "domain", "n", logo))), lambda x: F.struct(x["domain"].alias("domain"), x["n"].alias("n"), x["logo_url"].alias("logo_url"))).alias("top_companies"))
    median = exact.middle(jobs.where(shown), age(as_of))
    figures = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("open_jobs"), F.count_if((F.col("n") > 0) & F.col("domain").isNotNull()).alias("companies_hiring"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in flows],
        F.first(F.round(F.lit(median).cast("double"), 1)).alias("median_open_days"), F.round(F.max("_oldest"), 1).alias("oldest_open_days"),
    )
    return figures.join(top10)  # one row each


def warnings(jobs: DataFrame, keep_midnight: bool = False) -> DataFrame:
    """(posted_at, warning): exact times that open rows of several companies share, said as a line."""
    found = shared_timestamps(jobs.where("closed_at is null"), keep_midnight=keep_midnight)
    line = F.concat(F.col("posted_at").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" jobs across "), F.col("companies").cast("string"), F.lit(" different companies share this exact timestamp"))
    return found.select("posted_at", "n", line.alias("warning"))


def meta(jobs: DataFrame, companies: DataFrame, as_of: datetime, keep_midnight: bool = False) -> DataFrame:
    """(key, value): what a load notes for the health answer; of the warnings the MOST_WARNINGS with most rows, joined by '; ', and their number."""
    open_ = F.col("closed_at").isNull()
    of = lambda c: F.count_if(open_ & (F.col("confidence") == c))
    a = jobs.agg(F.count(F.lit(1)).alias("jobs_total"), F.count_if(open_).alias("jobs_open"), of("verified").alias("open_jobs_verified"), of("best_effort").alias("open_jobs_best_effort"))
    b = companies.agg(F.count(F.lit(1)).alias("companies_total"), F.count_if(F.col("ats").isNotNull()).alias("companies_resolved"))
    found = warnings(jobs, keep_midnight).persist()
    most = found.orderBy(F.desc("n"), "posted_at").limit(MOST_WARNINGS)
    c = most.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "posted_at", "warning"))), lambda x: x["warning"]), "; ").alias("timestamp_clustering_warnings"))
    d = found.agg(F.count(F.lit(1)).alias("timestamp_clustering_warning_count"))
    one = a.join(b).join(c).join(d).withColumn("last_loaded", F.date_format(F.lit(as_of), "yyyy-MM-dd'T'HH:mm:ss'Z'"))  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in one.columns])).alias("x")).select("x.key", "x.value")


def health_answer(stored: DataFrame, companies: DataFrame, as_of: datetime) -> DataFrame:
    """One row of the health answer from stored meta: counts, the minutes since the last check, the first SHOWN_WARNINGS warnings and how many there are."""
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    told = stored.agg(*[of(k).cast("long").alias(k) for k in ("jobs_total", "jobs_open", "companies_resolved")], of("timestamp_clustering_warnings").alias("w"), of("timestamp_clustering_warning_count").cast("long").alias("timestamp_clustering_warning_count"))
    checked = companies.agg(F.max("last_checked").alias("last_checked"))
    minutes = F.round((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_checked").cast("timestamp"))) / 60e6, 1)
    lines = F.slice(F.filter(F.split("w", "; "), lambda x: x != ""), 1, SHOWN_WARNINGS)
    return told.join(checked).select("jobs_total", "jobs_open", "companies_resolved", "last_checked", minutes.alias("minutes_since_check"), lines.alias("timestamp_clustering_warnings"), "timestamp_clustering_warning_count")
