"""What the operators owe beyond the rows that their first tests reach."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boardlake.llm import language_id, minhash
from boardlake.sources.tables import table

from test_llm_brute import shingles, smallest_reachable


def edited(rng, base, times):
    """base with so many words replaced, at least five words apart, so that each takes five shingles."""
    words = list(base)
    for i in range(times):
        words[5 + 10 * i] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [8, 20, 50, 75, 80, 85, 95, 100])
def test_minhash_misses_stay_rare_at_every_threshold(percent):
    bands, rows, least = minhash.plan(percent)
    j = percent / 100
    assert bands * rows <= minhash.COORDS
    assert (1 - j**rows) ** bands <= minhash.BAND_MISS
    assert sum(math.comb(minhash.COORDS, k) * j**k * (1 - j) ** (minhash.COORDS - k) for k in range(least)) <= minhash.ESTIMATE_MISS


def test_minhash_refuses_what_it_cannot_find(spark):
    for percent in (0, 5, 101):
        with pytest.raises(ValueError):
            minhash.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=percent)


@pytest.mark.parametrize("percent", [50, 75])
def test_minhash_at_other_thresholds(spark, percent):
    rng = random.Random(percent)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(10**9)}" for _ in range(304)]
        for k in range(4):
            rows.append((4 * g + k, edited(rng, base, rng.randrange(4, 21))))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert got == smallest_reachable(sets, links) and len(links) > 10


def test_pipeline_drops_near_copies_from_80_percent(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**9)}" for _ in range(304)]
    rows = [(1, " ".join(base)), (2, edited(rng, base, 6)), (3, edited(rng, [f"x{w}" for w in base], 0))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    after = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in after.collect()) == [1, 3]


@pytest.mark.parametrize("unseen", ["en", "de"])
def test_language_stage_rejects_what_it_never_learned(spark, unseen):
    """A language that nothing teaches and short texts in foreign scripts go; the other documents stay."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    foreign = [(-1, "日本語のテキスト", "xx"), (-2, "Καλημέρα κόσμε", "xx"), (-3, "שלום עולם", "xx")]
    both = docs.unionByName(spark.createDataFrame(foreign, docs.schema)).withColumn("truth", F.col("lang")).withColumn("lang", F.when(~F.col("lang").isin(unseen, "xx"), F.col("lang")))
    have = {r["truth"]: r["count"] for r in both.groupBy("truth").count().collect()}
    held = language_id.remainder("doc_id", 4) == 2
    clean = both.where(held & ~F.col("truth").isin(unseen, "xx") & (F.length("text") >= 64))
    stay = language_id.known_language(both).select("doc_id", "truth").collect()
    left = Counter(r["truth"] for r in stay)
    assert left["xx"] == 0 and left[unseen] <= 0.1 * have[unseen], left
    ids = {r["doc_id"] for r in stay}
    want = [r["doc_id"] for r in clean.select("doc_id").collect()]
    assert len(want) > 50 and sum(i in ids for i in want) >= 0.99 * len(want)
