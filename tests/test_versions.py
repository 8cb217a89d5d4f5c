"""A keyed table in buckets: what a batch rewrites, what comes late or twice, and two writers at once."""

import json
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boardlake.operators import versions
from boardlake.operators.merge import latest
from boardlake.operators.versions import Versions, put_if_absent
from boardlake.streaming import fragments

SCHEMA = "k long, at int, v string"
NOW = datetime(2024, 1, 31)


def newest_wins(stored, incoming):
    return latest(stored.unionByName(incoming), "k", ["at", "v"])


def table(spark, path):
    return Versions(spark, str(path), spark.createDataFrame([], SCHEMA).schema, "k")


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.newest() is None
    t.merge(spark.range(200).select(F.col("id").alias("k"), F.lit(0).alias("at"), F.lit("a").alias("v")), newest_wins, "s", 0, buckets=8)
    first = t.newest()["buckets"]
    assert len(first) == 8 and t.read().count() == 200
    t.merge(rows(spark, (7, 1, "b")), newest_wins, "s", 1)
    second = t.newest()["buckets"]
    assert [b for b in first if first[b] != second[b]] == [str(t._sent(rows(spark, (7, 1, "b")), 8)[0])]
    assert t.read().count() == 200 and t.read().where("k = 7").first()["v"] == "b"
    assert t.read(0).where("k = 7").first()["v"] == "a"
    parts = list((tmp_path / second["0"]).glob("*.parquet"))
    assert t.vacuum(keep=1) == sorted(set(first.values()) - set(second.values())) and t.read().count() == 200 and parts[0].exists()


def test_again_and_late(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, (1, 5, "five"), (2, 5, "five")), newest_wins, "s", 3, buckets=2)
    assert t.merge(rows(spark, (1, 9, "again")), newest_wins, "s", 3) == 0  # the batch is known by its number
    assert t.merge(rows(spark, (1, 4, "late"), (3, 1, "new")), newest_wins, "s", 4) == 1
    assert t.merge(rows(spark, (2, 6, "other source")), newest_wins, "t", 0) == 2
    assert sorted((r["k"], r["v"]) for r in t.read().collect()) == [(1, "five"), (2, "other source"), (3, "new")]


def test_a_name_is_given_once(spark, tmp_path):
    for path in (f"{tmp_path}/a", f"file://{tmp_path}/b"):
        assert put_if_absent(spark, path, "one") and not put_if_absent(spark, path, "two")
    assert (tmp_path / "a").read_text() == "one" and sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["a", "b"]


def test_the_loser_merges_again(spark, tmp_path):
    """Another writer publishes between a writer's read and its own publication: in the same bucket, and in another."""
    t, met = table(spark, tmp_path), []
    t.merge(rows(spark, *[(k, 0, "start") for k in range(40)]), newest_wins, buckets=4)
    here = t._sent(rows(spark, (1, 0, "")), 4)
    elsewhere = next(k for k in range(40) if t._sent(rows(spark, (k, 0, "")), 4) != here)
    for k in (1, elsewhere):
        def how(stored, incoming, k=k):
            met.append(k)
            if met.count(k) == 1:
                table(spark, tmp_path).merge(rows(spark, (k, 1, "winner"), (100 + k, 1, "winner")), newest_wins)
            return newest_wins(stored, incoming)

        t.merge(rows(spark, (1, 2, f"loser {k}"), (200 + k, 2, "loser")), how)
    got = {r["k"]: r["v"] for r in t.read().collect()}
    assert got[101] == got[100 + elsewhere] == "winner" and got[201] == got[200 + elsewhere] == "loser" and len(got) == 44 and got[1] == "loser 1"
    assert met.count(1) == 2


def test_two_writers_at_once(spark, tmp_path):
    table(spark, tmp_path).merge(rows(spark, (0, 0, "start")), newest_wins, buckets=3)
    failed = []

    def write(name, keys):
        try:
            for n, k in enumerate(keys):
                table(spark, tmp_path).merge(rows(spark, (k, 1, name), (1000, n, name)), newest_wins, name, n)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=("a", range(1, 4))), threading.Thread(target=write, args=("b", range(11, 14)))]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and {r["k"] for r in table(spark, tmp_path).read().collect()} == {0, 1, 2, 3, 11, 12, 13, 1000}
    assert table(spark, tmp_path).newest()["version"] == 6


def test_a_writer_gives_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "put_if_absent", lambda *a: False)
    with pytest.raises(versions.Conflict):
        table(spark, tmp_path).merge(rows(spark, (1, 1, "x")), newest_wins)


def test_a_stream_that_starts_again(spark, tmp_path):
    """Without new input the stored rows are read; new files are merged; a late one changes nothing."""
    (tmp_path / "in").mkdir()

    def put(name, *values):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(("k", "at", "v"), x, strict=True))) + "\n" for x in values))

    def run():
        stream = fragments.fragments(spark, str(tmp_path / "in"), SCHEMA).select("k", "at", "v")
        return sorted(tuple(r) for r in fragments.latest_by_key(stream, "t", "k", ["at", "v"], str(tmp_path / "state"), buckets=4).collect())

    put("1.json", (1, 1, "a"), (2, 1, "a"))
    assert run() == run() == [(1, 1, "a"), (2, 1, "a")]
    put("2.json", (2, 0, "late"), (3, 1, "a"))
    put("3.json", (1, 2, "b"))
    assert run() == run() == [(1, 2, "b"), (2, 1, "a"), (3, 1, "a")]


def test_a_log_of_postings(spark, tmp_path):
    """Rules of fields, boards that were read whole, and postings that come late."""
    kind = "id string, company_domain string, title string, ats string, posted_at timestamp, first_seen timestamp, last_seen timestamp, closed_at timestamp, seq long"
    stored = Versions(spark, str(tmp_path / "table"), spark.createDataFrame([], kind).schema, "company_domain")
    (tmp_path / "in").mkdir()

    def put(name, *values):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"id": i, "company_domain": c, "title": t, "ats": "lever", "seq": s, "_complete": w}) + "\n" for i, c, t, s, w in values))

    def run(day):
        stream = fragments.fragments(spark, str(tmp_path / "in"), "id string, company_domain string, title string, ats string, posted_at timestamp, seq long, _complete boolean")
        fragments.apply_log(stream, stored, datetime(2024, 1, day), str(tmp_path / "progress"))
        return {r["id"]: (r["title"], r["closed_at"] is not None) for r in stored.read().collect()}

    put("1.json", ("a", "x.com", "one", 1, True), ("b", "x.com", "two", 1, True), ("c", "y.com", "three", 1, False))
    assert run(1) == run(1) == {"a": ("one", False), "b": ("two", False), "c": ("three", False)}
    put("2.json", ("a", "x.com", "uno", 3, True))
    assert run(2) == {"a": ("uno", False), "b": ("two", True), "c": ("three", False)}
    put("3.json", ("a", "x.com", "late", 2, True), ("c", "y.com", "drei", 2, False))
    assert run(3) == {"a": ("uno", False), "b": ("two", True), "c": ("drei", False)}
    first = {r["id"]: r["first_seen"] for r in stored.read().collect()}
    assert set(first.values()) == {datetime(2024, 1, 1)}
