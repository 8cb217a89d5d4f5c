"""Nulls, empty tables, repeated rows, very long texts and clashing names for every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardlake.llm import chat_tools, embedding_dedup, language_id, minhash, packing, sentencepieces, sharding, topk, toxicity, url_filter

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Names that the operators use themselves.
CLASHING = ["rep", "component", "component_id", "kept", "shard", "k", "g", "s", "score", "ids", "rank", "key", "lo", "hi", "n", "_id", "_cell", "_all", "q", "mult", "dim", "host", "rule", "bucket", "piece", "level", "f1", "text_crc32", "y", "held_out"]


def clashing(df):
    """df with a column for each of those names that it does not have."""
    return df.withColumns({n: F.lit(1) for n in CLASHING if n not in df.columns})


WORDS = "the quick brown fox jumps over the lazy dog and runs away from it all day long"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [
        (1, WORDS, "en"), (2, WORDS, "en"), (3, WORDS.upper() + "\n", "en"), (3, WORDS.upper() + "\n", "en"), (4, None, "en"), (5, "", None), (6, "  \t", "de"), (7, "ein kurzer Text über Wälder und Flüsse", "de"),
        (8, long, "en"), (9, long + " end", "en"), (10, "x" * 300_000, None), (None, WORDS, "en"), (None, None, None), (11, "123 456", "en"), (12, WORDS + " stupid moron", "en"), (13, "日本語のテキスト", None), (14, "der die das und nicht ein eine Wald", "de"),
    ]
    return clashing(spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def labels(spark):
    return clashing(spark.createDataFrame([(1, 1, 0), (2, 1, 0), (12, 0, 1), (7, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int"))


def none_of(df):
    return df.limit(0)


def test_minhash_edges(docs):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[8]["component_id"] == by[9]["component_id"] == 8 and by[8]["n_shingles"] == 59_996
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == by[6]["n_shingles"] == 0 and by[5]["kept"]
    assert all(r["component_id"] is None and not r["kept"] for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(none_of(docs)).count() == 0


def test_first_of_each(docs):
    kept = [r["doc_id"] for r in minhash.first_of_each(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 13, 14]  # 12 is a near copy of 1
    assert kept.count(None) == 2
    assert minhash.first_of_each(docs).columns == docs.columns
    assert minhash.first_of_each(none_of(docs)).count() == 0


def test_language_edges(docs):
    got = language_id.language_id(docs)
    assert got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (4, 5, 6, 11))
    assert by[13]["lang_pred"] in ("en", "de") and 0 <= by[13]["score"] <= 1
    assert language_id.language_id(none_of(docs)).count() == 0
    assert {r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.known_language(docs).columns == docs.columns


def test_toxicity_edges(docs, labels):
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got.collect())
    assert toxicity.toxicity(none_of(docs), labels).count() == 0
    assert toxicity.toxicity(docs, none_of(labels)).where("predicted = 1").count() == 0
    assert toxicity.clean_documents(docs, labels).columns == docs.columns


def test_sharding_edges(docs):
    got = sharding.assign(docs, shards=4).collect()
    assert len(got) == docs.count()
    counts = [sum(r["shard"] == s for r in got) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert all((r["text_crc32"] is None) == (r["size"] == 16 and r["doc_id"] in (4, None)) for r in got if r["size"] == 16 and r["doc_id"] != 5)
    assert sharding.assign(none_of(docs), shards=4).count() == 0


def test_packing_edges(docs):
    got = packing.pack(docs)
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(r["n_tokens"] for r in by[8]) == 60_000 and len(by[8]) == 8
    assert [r["n_tokens"] for r in by[4] + by[5] + by[6]] == [0, 0, 0]
    assert all(r["padding"] >= 0 and r["n_tokens"] + r["padding"] == r["bucket_len"] for x in by.values() for r in x)
    assert packing.pack(none_of(docs)).count() == 0


def test_sentencepiece_edges(docs):
    pieces = sentencepieces.model_pieces(MODEL)
    got = sentencepieces.round_trip(docs, pieces).collect()
    assert len(got) == docs.count() and all(r["round_trip"] for r in got)
    assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (4, 5))
    assert sentencepieces.round_trip(none_of(docs), pieces).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((60, 8))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    near = [float(x) for x in v[3] + 0.05]
    rows += [(60, near), (61, rows[3][1]), (62, None), (63, []), (64, [0.0] * 8), (65, [float("nan")] + [1.0] * 7), (66, [float("inf")] + [1.0] * 7), (67, [None] + [1.0] * 7), (68, [1.0, 2.0]), (69, [2.0, 4.0]), (None, rows[3][1]), (5, rows[5][1])]
    return clashing(spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, label int"))


def test_embedding_edges(vectors):
    got = embedding_dedup.near_vectors(vectors, chunk=16).collect()
    assert len(got) == vectors.count()
    by = {r["vec_id"]: r for r in got}
    assert by[3]["component_id"] == by[60]["component_id"] == by[61]["component_id"] == 3 and by[3]["kept"]
    assert by[3]["n_links"] >= 2 and by[5]["n_links"] >= 1 and by[68]["component_id"] == by[69]["component_id"] == 68
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in range(62, 68)) and not by[None]["kept"]
    assert embedding_dedup.near_vectors(none_of(vectors)).count() == 0


def test_top_k_edges(vectors):
    got = topk.top_k(vectors, F.col("vec_id") % 10 == 0, k=5)
    ids = {r["query_id"] for r in got.collect()}
    assert ids == {0, 10, 20, 30, 40, 50, 60}
    assert not {r["vec_id"] for r in got.collect()} & {62, 63, 65, 66, 67, None}
    assert topk.top_k(none_of(vectors), F.col("vec_id") % 10 == 0).count() == 0
    few = topk.top_k(vectors.where("vec_id in (68, 69)"), F.lit(True), k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in few) == [(68, 1, 69), (69, 1, 68)]


def test_url_edges(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/x?y"), (5, "http://www.example.com/en/"), (6, "ftp://x.net/es/"), (7, "http://x.net/de/"), (8, "http://x.net"), (9, "http://com/"), (9, "http://com/"), (None, "http://notcom/"), (10, "http://[::1]:80#frag"), (11, "://"), (12, "http://y.net/fr?x")]
    pages = clashing(spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id long, url string, html string"))
    for segment in (1, 50_000):
        by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, segment=segment).collect()}
        assert by[1] == by[2] == by[3] == by[11] == ("", "", None, "allow")
        assert by[4] == ("a.example.com", "/en/x", "example.com/en/", "block") and by[5] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
        assert by[6] == ("x.net", "/es/", "net/es/", "block") and by[7] == ("x.net", "/de/", None, "block") and by[8] == ("x.net", "", None, "block")
        assert by[9] == ("com", "/", "com/", "allow") and by[10] == ("[::1]:80", "", None, "allow") and by[None][3] == "allow" and by[12] == ("y.net", "/fr", None, "allow")
    assert url_filter.judge(none_of(pages)).count() == 0


def test_chat_edges(spark):
    calls = clashing(spark.createDataFrame(
        [(1, "a", 1, "lookup", '{"query":"x","limit":3}', []), (1, "b", 2, "lookup", '{"limit": "3", "odd": 1}', ["a", "zz"]), (1, "c", 3, "summarise", "[1]", ["b"]), (1, "d", 4, "nope", None, ["e"]), (1, "e", 5, "lookup", '{"query":null}', ["d"]), (1, "a", 9, "lookup", "{}", None), (None, "a", 1, "lookup", "{}", []), (2, None, 1, "lookup", "{}", [])],
        "conv_id long, call_id string, position long, name string, arguments string, needs array<string>",
    ))
    results = clashing(spark.createDataFrame([(1, "a", 2, "one"), (1, "a", 3, "two"), (1, "zz", 4, None), (1, "c", 5, '"quoted"\n')], "conv_id long, call_id string, position long, content string"))
    by = {r["call_id"]: r for r in chat_tools.linked(calls, results).collect()}
    assert set(by) == {"a", "b", "c", "d", "e", "zz"}
    assert by["a"]["errors"] == ["repeated call", "repeated result"] and by["a"]["level"] == 0
    assert by["a"]["record"] == '{"arguments":{"limit":3,"query":"x"},"call_id":"a","errors":["repeated call","repeated result"],"level":0,"name":"lookup","needs":[],"result":"one"}'
    assert by["b"]["errors"] == ["limit is no integer", "missing query", "no result", "unexpected odd"] and by["b"]["level"] == 1
    assert by["c"]["errors"] == ["arguments are no object"] and by["c"]["level"] == 2 and '"result":"\\"quoted\\"\\n"' in by["c"]["record"]
    assert "circular needs" in by["d"]["errors"] and by["d"]["level"] is None and by["e"]["level"] is None and "unknown tool" in by["d"]["errors"]
    assert by["zz"]["errors"] == ["no call"] and by["zz"]["level"] is None
    assert chat_tools.linked(none_of(calls), none_of(results)).count() == 0
