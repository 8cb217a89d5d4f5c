"""Stored answers, indexes and poll state."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boardlake.operators import facets, listing, predicates, publish, search, stats
from boardlake.streaming import poll_state

from test_operators import NOW, companies, ids, job, jobs  # noqa: F401  fixtures


def test_stored_answers(jobs, companies):  # noqa: F811
    params = {"confidence": "verified", "israel_only": "1"}
    got = {(r["key"], r["name"]): json.loads(r["answer"]) for r in publish.precomputed(jobs, NOW, [params]).collect()}
    key = facets.precomputed_key(params)
    assert {k for k, _ in got} == {key} and got[key, "stats"][0]["total"] == stats.scoped(jobs.where(predicates.compile_filters(params | {"include_closed": "1"}, NOW)), NOW).first()["total"]
    want = {r["value"]: r["n"] for r in facets.compute(jobs, params, NOW)["company"].collect()}
    assert {x["value"]: x["n"] for x in got[key, "company"]} == want and len(publish.VARIANTS) == 8
    page = publish.first_page(jobs, companies, NOW, 3).orderBy("rank").collect()
    assert json.loads(page[0]["listing"]) == {"total": listing.total(jobs, {}, NOW)}
    assert [json.loads(r["listing"])["id"] for r in page[1:]] == [r["id"] for r in listing.page(jobs, companies, {"limit": "3"}, NOW).collect()]
    assert listing.page(jobs, companies, {"count": "only"}, NOW).count() == 0


def test_salary_matrix(spark):
    rows = spark.createDataFrame([("x", 100.0 + i) for i in range(20)], "k string, pay double")
    (r,) = publish.salary_matrix(rows, [("k", ["k"])], "pay").collect()
    assert json.loads(r["cell"])["n"] == 20 and r["key"] == "x"


def test_stored_index(jobs, tmp_path):  # noqa: F811
    index = search.rebuilt(jobs, str(tmp_path), 1)
    assert ids(search.search(jobs, index, "data")) == [1, 2, 7] and search.complete(index, jobs)
    assert not search.complete(index.where("id <> '00000001'"), jobs)
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,data)]" in search.matches(index, "data")._jdf.queryExecution().toString()
    assert ids(search.search(jobs, None, "data")) == [1, 2, 7]
    with pytest.raises(Exception, match="exists"):
        search.rebuilt(jobs, str(tmp_path), 1)


def test_fragment_files_stay_small(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i:03d}", "x" * 1000, i % 10 == 0) for i in range(100)], "domain string, body string, unchanged boolean").coalesce(1)
    publish.write_fragments(rows, str(tmp_path / "f"), most_bytes=5000)
    sizes = [len(p.read_text().splitlines()) for p in (tmp_path / "f").glob("part*.json")]
    assert sum(sizes) == 90 and max(sizes) <= 4


def test_pay_in_json_ld(spark):
    row = spark.createDataFrame([("T", "X", "a.com", datetime(2024, 1, 2), "$100K – $150K", "disclosed"), ("U", "X", "a.com", None, "$100K", "table")], "title string, location string, company_domain string, posted_at timestamp, salary_text string, salary_source string")
    a, b = [json.loads(r["j"]) for r in row.select(publish.json_ld().alias("j")).collect()]
    assert a["baseSalary"] == {"@type": "MonetaryAmount", "currency": "USD", "value": {"@type": "QuantitativeValue", "minValue": 100_000.0, "maxValue": 150_000.0, "unitText": "YEAR"}} and "baseSalary" not in b


def test_streamed_polls_follow_watched_and_jitter(spark, tmp_path):
    polls = spark.createDataFrame([(f"d{i}", False, False, NOW + timedelta(hours=k), i == 0) for i in range(2) for k in range(9)], "domain string, changed boolean, failed boolean, polled_at timestamp, watched boolean")
    polls.coalesce(1).write.parquet(str(tmp_path / "p"))
    out = poll_state.streamed(spark.readStream.schema(polls.schema).parquet(str(tmp_path / "p")))
    query = out.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["domain"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["d0"]["interval_s"] == poll_state.WATCHED and got["d1"]["interval_s"] > poll_state.WATCHED
    want = polls.groupBy("domain").agg(F.max("polled_at").alias("at")).select("domain", F.timestamp_add("SECOND", poll_state.jittered(F.when(F.col("domain") == "d0", got["d0"]["interval_s"]).otherwise(got["d1"]["interval_s"]), F.col("domain")), F.col("at")).alias("due"))
    assert {r["domain"]: r["due"] for r in want.collect()} == {k: r["next_at"] for k, r in got.items()}
