"""Ranks, chunks and postings against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from boardlake.operators import ordered, postings, publish


def greedy(sizes, most, most_size):
    out, n, total, chunk = [], 0, 0, -1
    for s in sizes:
        if chunk < 0 or n == most or total + s > most_size:
            chunk, n, total = chunk + 1, 0, 0
        n, total = n + 1, total + s
        out.append(chunk)
    return out


def test_ranks(spark):
    rows = [(i, i % 3 if i % 10 else None) for i in range(3000)]
    got = ordered.ranked(spark.createDataFrame(rows, "k int, v int").repartition(7), [F.col("v").asc_nulls_first(), "k"]).collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r["k"]: r["rank"] for r in got} == {k: n for n, (k, _) in enumerate(want)}


@pytest.mark.parametrize(("most", "most_size", "segment"), [(25, 1000, None), (4, 60, 10), (3, 10**9, 3), (7, 1, 7), (5, 50, 8), (100, 10**9, 10)])
def test_chunks_are_filled_in_order(spark, most, most_size, segment):
    rng = random.Random(most)
    sizes = [rng.choice([0, 1, 5, 20, 40, 70, 500]) for _ in range(331)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k int, size long").repartition(5)
    got = {r["k"]: (r["rank"], r["chunk"]) for r in ordered.chunks(df, ["k"], F.col("size"), most, most_size, segment=segment).collect()}
    assert got == {k: (k, c) for k, c in enumerate(greedy(sizes, most, most_size))}


def test_no_rows_and_one(spark):
    df = spark.createDataFrame([(1, 9)], "k int, size long")
    assert ordered.chunks(df, ["k"], F.col("size"), 3, 5).first()["chunk"] == 0
    assert ordered.chunks(df.limit(0), ["k"], F.col("size"), 3, 5).count() == ordered.ranked(df.limit(0), ["k"]).count() == 0


def test_fragments_keep_both_bounds(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i:03d}", "x" * (i % 40 * 10), i % 9 == 0) for i in range(200)], "domain string, text string, unchanged boolean")
    publish.write_fragments(rows, str(tmp_path / "f"), most=7, most_bytes=1500)
    files = sorted((tmp_path / "f").glob("part*.json"))
    lines = [f.read_text().splitlines() for f in files]
    keys = [re.search('"domain":"(c[0-9]+)"', x)[1] for f in lines for x in f]
    assert keys == [f"c{i:03d}" for i in range(200) if i % 9] and max(map(len, lines)) <= 7 and max(f.stat().st_size for f in files) <= 1500
    assert greedy([len(x) + 1 for f in lines for x in f], 7, 1500)[-1] == len(files) - 1


def test_sitemap_shards_are_full(spark):
    jobs = spark.createDataFrame([(f"{i:04d}", None if i % 5 else "2024-01-01", f"2024-01-{i % 28 + 1:02d}", None) for i in range(230)], "id string, closed_at string, last_seen string, first_seen string").withColumns({c: F.to_timestamp(c) for c in ("closed_at", "last_seen", "first_seen")})
    index = publish.sitemap_index(publish.sitemap(jobs, "https://x", 50)).orderBy("shard").collect()
    assert [r["n"] for r in index] == [50, 50, 50, 34] and [r["name"] for r in index][0] == "sitemap-00000.xml" and index[0]["first_id"] == "0001" and index[-1]["last_id"] == "0229" and index[0]["lastmod"].startswith("2024-01-28")


WORDS = "of the and of idiot café data engineer lead the of".split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(8)
    rows = [(i * 3 - 500, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12))), rng.choice(["the data", "Café, of THE", "", None])) for i in range(900)]
    rows += [(2**40 + i, "rare of the end", None) for i in range(3)] + [(None, "of the", "of the"), (5000, None, "of-the c++"), (5000, "again of", "the")]
    return rows


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    df = spark.createDataFrame(texts, "id long, body string, title string")
    return postings.write(postings.build(df, ["body", "title"]), str(tmp_path_factory.mktemp("index") / "i"))


def plain(text):
    return [t for t in re.split(r"[^a-z0-9]+", (text or "").lower().replace("é", "e")) if t]


@pytest.mark.parametrize("term", ["of the", "rare", "rare of the end", "the", "café", "data engineer lead", "of the of the", "none", "", "Idiot"])
@pytest.mark.parametrize("fields", [None, ["title"]])
def test_phrases(texts, index, term, fields):
    want, asked = set(), plain(term)
    for i, body, title in texts:
        for t in [title] if fields else [body, title]:
            w = plain(t)
            if i is not None and asked and any(w[k : k + len(asked)] == asked for k in range(len(w))):
                want.add(i)
    got = [r["number"] for r in postings.phrase(index, term, fields).collect()]
    assert set(got) - {5000} == want - {5000} and len(got) == len(set(got))


@pytest.mark.parametrize("term", ["of the", "rare of", "cafe idiot data", "none of", "", "of"])
def test_all_words(texts, index, term):
    have = {}
    for i, body, title in texts:
        if i is not None:
            have.setdefault(i, set()).update(plain(body), plain(title))
    got = [r["number"] for r in postings.every(index, term).collect()]
    assert sorted(got) == sorted(i for i, w in have.items() if plain(term) and w >= set(plain(term)))


def test_blocks_follow_frequency(spark, texts, monkeypatch, index):
    monkeypatch.setattr(postings, "BLOCK", 32)
    small = postings.build(spark.createDataFrame([(i, "hot" if i % 2 else "hot cold" if i % 500 == 0 else "hot warm") for i in range(4000)], "id long, body string"), ["body"])
    per = {r["token"]: r for r in small.groupBy("token").agg(F.count("*").alias("blocks"), F.max("n").alias("most"), F.sum("n").alias("n")).collect()}
    assert per["hot"]["blocks"] >= 100 and per["hot"]["most"] <= 64 and per["hot"]["n"] == 4000 and per["cold"]["blocks"] == 1
    assert [r["number"] for r in postings.every(small, "hot cold").orderBy("number").collect()] == list(range(0, 4000, 500))
    plan = postings.phrase(index, "of the")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,of)" in plan


def test_words_meet_text_by_text(spark, index):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan(postings.phrase(index, "of the")) and "array_contains" not in plan(postings.every(index, "of the"))


def test_occurrences_are_no_rows(spark, monkeypatch):
    plans, own = [], postings.settled
    monkeypatch.setattr(postings, "settled", lambda df, what: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df, what))
    built = postings.build(spark.createDataFrame([(i, "b a b") for i in range(5)], "id long, body string"), ["body"])
    assert len(plans) == 1 and "Aggregate" not in plans[0]
    assert {r["token"]: sorted(tuple(p) for p in r["places"]) for r in built.collect()} == {"a": [(1,)] * 5, "b": [(0, 2)] * 5}


def test_a_word_of_a_batch_is_one_row(spark, monkeypatch):
    """Stored postings have a row for each word of a batch, whatever the number of its texts, blocks are put together without a group for each, and repeated and unordered numbers count alike."""
    stored, own = [], postings.settled
    monkeypatch.setattr(postings, "settled", lambda df, what: stored.append(own(df, what)) or stored[-1])
    monkeypatch.setattr(postings, "BLOCK", 16)
    rows = [((i * 37) % 500, "b a b" if i % 2 else "a") for i in range(500)]
    built = postings.build(spark.createDataFrame(rows, "id long, body string").coalesce(1), ["body"])
    assert stored[0].count() == 2
    assert "collect_list" not in built._jdf.queryExecution().optimizedPlan().toString()
    for token in "ab":
        got = built.where(F.col("token") == token).orderBy("block").collect()
        texts = [r["least"] + o for r in got for o in r["offsets"]]
        assert texts == sorted(i for i, t in rows if token in t) and all(r["texts"] == len(texts) and r["n"] == len(r["offsets"]) and r["most"] == r["least"] + r["offsets"][-1] for r in got) and len(got) > 10
        place = {i: [k for k, w in enumerate(t.split()) if w == token] for i, t in rows}
        assert [p for r in got for p in r["places"]] == [place[i] for i in texts]
    again = postings.build(spark.createDataFrame([*rows, (3, "a")], "id long, body string"), ["body"])
    assert again.where("token = 'a'").agg(F.sum("n")).first()[0] == len(rows)


def test_only_frequent_words_are_looked_up(spark, monkeypatch, tmp_path):
    """Widths are stored of words of more than BLOCK texts, the others' rows are dealt once, by ranges, and written as they lie; both kinds are whole."""
    stored, own = [], postings.versions.settled
    monkeypatch.setattr(postings.versions, "settled", lambda df, what: stored.append(own(df, what)) or stored[-1])
    monkeypatch.setattr(postings, "BLOCK", 16)
    monkeypatch.setattr(postings, "BATCH", 2000)
    rows = [(i - 200, f"hot w{i // 16} only{i} hot") for i in range(400)]
    built = postings.build(spark.createDataFrame(rows, "id long, body string"), ["body"])
    assert [r["token"] for r in stored[0].collect()] == ["hot"]
    index = postings.write(built, str(tmp_path / "i")).collect()
    got = {}
    for r in index:
        assert r["least"] >> r["width"] == r["most"] >> r["width"] == r["block"] and r["n"] == len(r["offsets"]) == len(r["places"])
        got.setdefault(r["token"], []).extend((r["least"] + o, tuple(p)) for o, p in zip(r["offsets"], r["places"], strict=True))
    want = {}
    for i, text in rows:
        for w in dict.fromkeys(text.split()):
            want.setdefault(w, []).append((i, tuple(k for k, x in enumerate(text.split()) if x == w)))
    assert {w: sorted(x) for w, x in got.items()} == want and {r["texts"] for r in index if r["token"] == "w3"} == {16}


def test_letters_are_split_as_by_tokens(spark):
    """Every letter below U+0250 alike, and texts with others, which come by the other way."""
    import pyarrow as pa

    from boardlake.operators.search import tokens

    plain = [f"a{chr(c)}B {chr(c)}" for c in range(0x250) if c != 0x130] + ["", " ", "x", None, "Ünïted-ÀÉ  9²½ end", "".join(map(chr, range(0x130))), "y" * 300_000 + " Z"]
    found, row = postings._split(pa.array(plain))
    got = [[] for _ in plain]
    for t, r in zip(found.to_pylist(), row, strict=True):
        got[r].append(t)
    want = spark.createDataFrame(list(enumerate(plain)), "i long, t string").select("i", tokens(F.col("t")).alias("t")).orderBy("i").collect()
    assert got == [r["t"] or [] for r in want]
    texts = [(1, "İstanbul ΟΔΟΣ Σ é"), (2, "日本 data 😀x"), (3, "plain é"), (4, None)]
    built = postings.build(spark.createDataFrame(texts, "id long, body string"), ["body"])
    got = sorted((r["token"], r["least"] + o, tuple(p)) for r in built.collect() for o, p in zip(r["offsets"], r["places"], strict=True))
    want = spark.createDataFrame(texts, "id long, body string").select("id", F.posexplode(tokens(F.col("body"))).alias("p", "t")).collect()
    assert got == sorted((r["t"], r["id"], (r["p"],)) for r in want)


def test_broken_bytes_and_no_texts(spark):
    df = spark.createDataFrame([(1, bytearray(b"one \xff two")), (2, bytearray(b"\xc3 one")), (3, bytearray(b"one"))], "id long, b binary").select("id", F.expr("cast(b as string)").alias("body"))
    built = postings.build(df, ["body"])
    assert {r["token"]: r["n"] for r in built.groupBy("token").agg(F.sum("n").alias("n")).collect()} == {"one": 3, "two": 1}
    assert postings.build(df.where("id > 9"), ["body"]).count() == 0
