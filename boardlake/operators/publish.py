"""Exports: archive, fragments, sitemap, feed, CSV, JSON-LD, precomputed answers."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import w3c
from ..functions.money import base_salary
from . import evaluate, facets, listing, ordered, stats
from .predicates import compile_filters
from .versions import settled

RETAIN_DAYS, SITEMAP_SIZE, FEED_SIZE, FRAGMENT_ROWS, ARCHIVE_PARTS = 30, 40_000, 100, 25, 8
FRAGMENT_BYTES = 12 << 20


def archived(jobs: DataFrame, as_of: datetime, days: int = RETAIN_DAYS) -> tuple[DataFrame, DataFrame]:
    """(rows closed longer ago than the days, with closed_month; the rest)."""
    old = F.coalesce(F.col("closed_at") < F.lit(as_of - timedelta(days=days)), F.lit(False))
    return jobs.where(old).withColumn("closed_month", F.date_format("closed_at", "yyyy-MM")), jobs.where(~old)


def write_archive(rows: DataFrame, path: str) -> None:
    """Compressed JSON lines by the month of the close; a month's rows are first brought to a few tasks, so it has few files and no task has it all."""
    part = F.pmod(F.xxhash64(rows.columns[0]), F.lit(ARCHIVE_PARTS))
    rows.repartition("closed_month", part).write.mode("append").partitionBy("closed_month").option("compression", "gzip").json(path)


def fragments(results: DataFrame, most: int = FRAGMENT_ROWS, most_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """Changed company results with rank and chunk: in the order of their keys, at most `most` and at most most_bytes of JSON lines in a chunk.

    Unchanged results are left out. Both bounds hold for every chunk; a result that is larger by itself is a chunk of its own.
    """
    changed = results.where(~F.coalesce("unchanged", F.lit(False)))
    line = F.octet_length(F.to_json(F.struct(*changed.columns))) + 1
    key = [c for c in changed.columns if c != "unchanged"][0]
    return ordered.chunks(changed, [key, F.xxhash64(*changed.columns)], line, most, most_bytes)


def write_fragments(results: DataFrame, path: str, most: int = FRAGMENT_ROWS, most_bytes: int = FRAGMENT_BYTES) -> None:
    """A file of JSON lines for each chunk of `fragments`, named and filled in the order of their keys: a task writes one."""
    cut = settled(fragments(results, most, most_bytes), "fragments")
    n = (cut.agg(F.max("chunk")).first()[0] or 0) + 1
    cut.repartitionById(n, F.col("chunk").cast("int")).sortWithinPartitions("rank").drop("rank", "chunk").write.mode("append").json(path)


def write_shards(rows: DataFrame, path: str, shard: Column) -> None:
    rows.withColumn("shard", shard).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def changed_descriptions(jobs: DataFrame, blobs: DataFrame) -> DataFrame:
    """(job_id, sha, text) of listings whose text is not yet stored under its hash."""
    now = jobs.where("description_sha is not null").select(F.col("id").alias("job_id"), F.col("description_sha").alias("sha"), F.col("description").alias("text"))
    return now.join(blobs.select("job_id", "sha"), ["job_id", "sha"], "left_anti")


def sitemap(jobs: DataFrame, base: str, size: int = SITEMAP_SIZE) -> DataFrame:
    """(shard, rank, id, modified, xml): an entry for each open listing, in the order of their ids, exactly `size` in a shard but the last."""
    seen = F.coalesce("last_seen", "first_seen")
    entry = F.concat(F.lit(f"<url><loc>{base}/job/"), "id", F.lit("</loc><lastmod>"), w3c(seen), F.lit("</lastmod></url>"))
    rows = ordered.ranked(jobs.where("closed_at is null").select("id", seen.alias("modified"), entry.alias("xml")), ["id", "xml"])
    return rows.select(F.floor(F.col("rank") / size).cast("long").alias("shard"), "rank", "id", "modified", "xml")


def sitemap_index(entries: DataFrame) -> DataFrame:
    """(shard, name, n, lastmod, first_id, last_id): what the index of the sitemap says of each shard's file."""
    name = F.concat(F.lit("sitemap-"), F.lpad(F.col("shard").cast("string"), 5, "0"), F.lit(".xml"))
    told = entries.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), w3c(F.max("modified")).alias("lastmod"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return told.select("shard", name.alias("name"), "n", "lastmod", "first_id", "last_id")


def company_sitemap(jobs: DataFrame) -> DataFrame:
    """(company_domain, lastmod) of companies with open listings: the newest first sight."""
    return jobs.where("closed_at is null").groupBy("company_domain").agg(w3c(F.max("first_seen")).alias("lastmod"))


def feed(jobs: DataFrame, size: int = FEED_SIZE) -> DataFrame:
    """The newest open listings, as a feed shows them."""
    return jobs.where("closed_at is null").orderBy(F.col("first_seen").desc_nulls_last(), F.desc("id")).limit(size).select("id", "title", "company_domain", w3c(F.col("first_seen")).alias("published"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, CRLF and empty nulls; a byte-order mark stands before the first column's name."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def json_ld() -> Column:
    """A listing as schema.org JobPosting, with its pay where it is disclosed."""
    place = F.struct(F.lit("Place").alias("@type"), F.col("location").alias("address"))
    pay = F.from_json(base_salary(F.col("salary_text"), F.col("salary_source")), "currency string, value struct<maxValue:double,minValue:double,unitText:string>")
    worth = F.struct(F.lit("QuantitativeValue").alias("@type"), *[pay["value"][c].alias(c) for c in ("minValue", "maxValue", "unitText")])
    salary = F.when(pay.isNotNull(), F.struct(F.lit("MonetaryAmount").alias("@type"), pay["currency"].alias("currency"), worth.alias("value")))
    return F.to_json(F.struct(
        F.lit("https://schema.org/").alias("@context"), F.lit("JobPosting").alias("@type"), F.col("title"), F.date_format("posted_at", "yyyy-MM-dd").alias("datePosted"),
        F.struct(F.lit("Organization").alias("@type"), F.col("company_domain").alias("name")).alias("hiringOrganization"), place.alias("jobLocation"), salary.alias("baseSalary"),
    ))


#: The questions whose answers are stored: confidence, roles, country.
VARIANTS = [{"confidence": c, **({"roles": "tech"} if r else {}), **({"israel_only": "1"} if i else {})} for c in ("verified", "all") for r in (False, True) for i in (False, True)]


def precomputed(jobs: DataFrame, as_of: datetime, variants: list[dict] | None = None) -> DataFrame:
    """(key, name, answer): each variant's facets and figures as JSON, under the key by which `facets.precomputed_key` finds them.

    The facets of all variants come from one scan (`facets.all_facets`). A facet is a short list by its own limit, so an answer is one row.
    """
    asked = {facets.precomputed_key(params): params for params in (VARIANTS if variants is None else variants)}
    found = facets.all_facets(jobs, asked, as_of)
    entry = F.when(F.col("name") == "places", F.to_json(F.struct(F.col("value").alias("country"), F.col("n").alias("country_n"), F.col("part").alias("city"), F.col("part_n").alias("n"))))
    entry = entry.when(F.col("name") == "pay", F.to_json(F.struct("low", "high", F.col("n").alias("known"), F.col("part").cast("double").alias("median")))).when(F.col("name") == "disclosed", F.to_json(F.struct("n"))).otherwise(F.to_json(F.struct("value", "n")))
    place = F.when(F.col("name") == "places", F.struct((-F.col("n")).alias("n"), "value", "rank")).otherwise(F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("value"), "rank"))
    lists = found.groupBy(F.col("variant").alias("key"), "name").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), entry.alias("e")))).alias("all"))
    out = [lists.select("key", "name", F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["e"]), ","), F.lit("]")).alias("answer"))]
    for key, params in asked.items():
        told = stats.scoped(jobs.where(compile_filters(params | {"include_closed": "1"}, as_of)), as_of)
        out.append(told.agg(F.to_json(F.collect_list(F.struct(*told.columns))).alias("answer")).select(F.lit(key).alias("key"), F.lit("stats").alias("name"), "answer"))
    return reduce(DataFrame.unionByName, out)


def first_page(jobs: DataFrame, companies: DataFrame, as_of: datetime, limit: int = 50) -> DataFrame:
    """(rank, listing): the opening page as JSON, a row for each listing, and the number of all under rank 0."""
    page = listing.page(jobs, companies, {"limit": str(limit)}, as_of)
    at = F.row_number().over(Window.orderBy(*listing.order({}, as_of)))  # a page's rows
    rows = page.select(at.alias("rank"), F.to_json(F.struct(*page.columns)).alias("listing"))
    total = jobs.where(compile_filters({}, as_of)).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total"))).alias("listing"))
    return total.select(F.lit(0).alias("rank"), "listing").unionByName(rows)


def salary_matrix(rows: DataFrame, levels: list[tuple[str, list[str]]], pay: str, least: int = evaluate.LEAST) -> DataFrame:
    """(level, key, cell): the learned pay cells as JSON, for answers without the listings themselves."""
    return evaluate.cells(rows, levels, pay, least).select("level", "key", F.to_json(F.struct("n", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))).alias("cell"))


def write_version(rows: DataFrame, path: str, version: int) -> str:
    """A new version of a table in a folder of its own; readers move on when they are told its name."""
    where = f"{path}/v={version}"
    rows.write.mode("errorifexists").parquet(where)
    return where


def known_companies(companies: DataFrame) -> DataFrame:
    return companies.where("ats is not null").select("domain", "ats", "token", "confidence")
