"""Right results where a size, a count or a repetition is far from the usual, and plain versions of what is learned."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boardlake.llm import chat_tools, embedding_dedup, language_id, minhash, sentencepieces, sharding, shared, topk, toxicity, url_filter
from boardlake.sources.tables import table

SF = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_top_k_of_components_of_any_size(spark):
    """Exact ranks where scores leave 64 bits, beside small vectors of the same blocks."""
    rng = random.Random(1)
    sizes = [1.0, 1e3, 3e5, 1e9, 1e20, 3e38]
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * sizes[i % 6])) for _ in range(4)]) for i in range(60)]
    rows += [(100, rows[5][1]), (101, [0.0] * 4)]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    for q in [i for i in whole if i % 5 == 0]:
        scores = {i: sum(a * b for a, b in zip(whole[q], v, strict=True)) for i, v in whole.items() if i != q}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        assert got[q] == [(i, min(max(scores[i], topk.LEAST), topk.MOST)) for i in best]


def test_sortable_scores():
    rng = random.Random(2)
    x = [rng.choice([-1, 1]) * rng.randrange(2**63, 2 ** rng.randrange(65, 200)) for _ in range(200)]
    for some in ([v for v in x if v > 0], [v for v in x if v < 0]):
        assert sorted(some) == sorted(some, key=topk.sortable)


def test_url_filter_with_many_segments(spark):
    """As literals and as joined tables, the cascade tells listed hosts exactly."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 997, F.lit(".net/"), F.when(F.col("id") % 3 == 0, "es/").otherwise("x")).alias("url"))
    want = None
    for segment, literals in ((50_000, 20), (40, 20), (40, 0)):
        got = sorted((r["page_id"], r["verdict"]) for r in url_filter.judge(pages, segment=segment, literals=literals).collect())
        want = want or got
        assert got == want
    listed = {i % 997 for i in range(3000) if i % 3 == 0}
    assert want == [(i, "block" if i % 997 in listed else "allow") for i in range(3000)]


def test_sentencepieces_of_long_words_and_many_letters():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = sentencepieces.Encoder(sentencepieces.model_pieces(MODEL))
    every = "".join(chr(c) for c in range(32, 0x15000) if not 0xD800 <= c < 0xE000 and c != 0x2581)
    assert len(set(every)) > 65_536
    rng = random.Random(3)
    texts = [every, "x" * 100_000, "".join(rng.choice("abcdeé日") for _ in range(5000)), "ab " * 3000, "\0" * 500]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(t)


def plain_grams(text):
    """Counts of 1-, 2- and 3-grams, one character after the other."""
    classes = [0]
    for x in [int(language_id._CLASS[b]) for b in text.lower().encode()] + [0]:
        if x or classes[-1]:
            classes.append(x)
    n = language_id.CLASSES
    found = Counter(classes)
    found += Counter(n + a * n + b for a, b in itertools.pairwise(classes))
    found += Counter(n + n * n + int(language_id._TRIGRAM[(a * n + b) * n + c]) for a, b, c in zip(classes, classes[1:], classes[2:], strict=False))
    return {k: v for k, v in found.items() if k not in (0, n)}


def test_grams_of_each_text_alone(monkeypatch):
    texts = ["Hello wörld, x", "", None, "a", "  b c  ", "123", "the end.", "x y " * 200]
    for run in (16, 1 << 17):
        monkeypatch.setattr(language_id, "RUN", run)
        seen = {}
        for a, b, row, gram, count in language_id.grams(pa.array(texts, pa.string())):
            for r in range(b - a):
                seen[a + r] = dict(zip(gram[row == r].tolist(), count[row == r].tolist(), strict=True))
        assert [seen[i] for i in range(len(texts))] == [plain_grams(t or "") for t in texts]


def test_predictions_by_hand(spark):
    """Each text's language is that of the centroid with the highest cosine, by sums over plain counts."""
    docs = table(spark, SF, "documents")
    model = language_id.train(docs.where(language_id.remainder("doc_id", 4) != 2))
    texts = [r["text"] for r in docs.limit(60).collect()]
    lang, score, _ = model.predict(pa.array(texts, pa.string()))
    for t, x, s in zip(texts, lang, score, strict=True):
        w = {k: math.log1p(v) * float(model.idf[k]) for k, v in plain_grams(t or "").items()}
        length = math.sqrt(sum(v * v for v in w.values())) or 1.0
        cos = [sum(v * float(c[k]) for k, v in w.items()) / length for c in model.centroids]
        if w:
            assert x == model.langs[int(np.argmax(cos))] and abs(s - max(cos)) < 1e-5


def test_no_language_goes_unlearned(spark):
    docs = spark.createDataFrame([(i, "some text of a language", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.train(docs, languages=4)
    assert len(set(language_id.train(docs, languages=5).langs)) == 5


def test_toxicity_counts_an_id_once(spark):
    """A labelled id that documents repeats does not outweigh the others."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=20)) + (" vile vile" if i % 2 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame(rows + [rows[1]] * 3000, "doc_id long, text string")
    a, b = (toxicity.train(d, labels.unionByName(labels)) for d in (once, often))
    assert (a.features == b.features).all() and np.allclose(a.weights, b.weights)


def test_identity_terms_keep_their_score(spark, monkeypatch):
    """Where labelled insults name one group more often, swapping the group changes a neutral sentence's score less with the penalty."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(600):
        text = " ".join(rng.choices(words, k=15))
        if i % 2:
            text += rng.choice([" vile", " awful", ""]) + (" women here." if rng.random() < 0.9 else " men here.")
        elif rng.random() < 0.1:
            text += " women here."
        rows.append((i, text))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    change = []
    for fairness in (0.0, 20.0):
        monkeypatch.setattr(toxicity, "FAIRNESS", fairness)
        model = local_model(docs, labels)
        a, b = model.scores(pa.array(["the women sing", "the men sing"]))
        change.append(abs(a - b))
        insult, plain = model.scores(pa.array(["w1 vile w2", "w1 w2"]))
        assert insult > plain
    assert change[1] < 0.5 * change[0]


def local_model(docs, labels):
    """The fit of toxicity.train in this process, so that a changed penalty counts."""
    rows = docs.join(labels, "doc_id").select("text", "toxic").collect()
    named = np.concatenate(toxicity.features_of(list(toxicity.SWAPS)))
    vocabulary = np.unique(np.concatenate([*toxicity.features_of([r["text"] for r in rows]), named]))
    batch = pa.RecordBatch.from_arrays([pa.array([r["text"] for r in rows]), pa.array([r["toxic"] for r in rows], pa.int32())], ["text", "y"])
    (got,) = toxicity._indexed(vocabulary)([batch])
    y, x, taken, brought = (got.column(c) for c in ("y", "x", "taken", "brought"))
    w, b = toxicity.fit(y.to_numpy().astype(float), toxicity.Sparse(x), toxicity.Sparse(brought.flatten(), taken.flatten()), len(vocabulary))
    return toxicity.Model(vocabulary, w, b, vocabulary)


def test_shards_cut_fewer_edges_than_a_random_deal(spark):
    rng = random.Random(6)
    texts = [f"copy {i % 60}" for i in range(300)] + ["hot"] * 500 + [f"single {i}" for i in range(1200)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dealt = shared.stored(sharding.assign(docs, shards=20).select("doc_id", "shard").join(docs, "doc_id"), "dealt")
    random_deal = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(20)))
    r, w = sharding.cut_edges(dealt, ["text"]).first(), sharding.cut_edges(random_deal, ["text"]).first()
    by = Counter((x["text"], x["shard"]) for x in dealt.collect())
    assert r["edges"] == w["edges"] == sum(c * (c - 1) // 2 for c in Counter(texts).values())
    assert r["cut"] == r["edges"] - sum(c * (c - 1) // 2 for c in by.values())
    copies = [sharding.cut_edges(x.where("text <> 'hot'"), ["text"]).first()["cut"] for x in (dealt, random_deal)]
    assert copies[0] < 0.2 * copies[1] and sum(k[0] == "hot" for k in by) <= 14
    assert sharding.cut_edges(docs.limit(0).withColumn("shard", F.lit(0)), ["text"]).first() == (0, 0)


def test_shards_of_one_repeated_id(spark):
    docs = spark.createDataFrame([(7, "same")] * 800 + [(None, "same")] * 400 + [(i, f"t{i}") for i in range(300)], "doc_id long, text string")
    rows = sharding.assign(docs, shards=6).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 1500 and max(counts.values()) - min(counts.values()) <= 1
    for s in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_minhash_with_a_hot_id_and_ids_of_two_texts(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["other"])
    rows = [(1, " ".join(base))] * 500 + [(2, near)] + [(3, "another text of more than five words"), (3, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert got[1, 1] == 500 and got[2, 1] == 1
    kept = sorted((r["doc_id"], r["text"]) for r in minhash.first_of_each(docs).collect())
    assert kept == [(1, " ".join(base)), (3, "another text of more than five words")]


KINDS = {"call": 1, "result": 1, "turn": 5, "repeated call": 1, "repeated result": 1}


def test_every_turn_is_carried(spark):
    turns = [(1, 0, "system", 'say "yes"'), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, None, "c"), (1, 4, "tool", None), (None, 5, "user", "d"), (1, None, "user", "e"), (1, 1, "user", "other"), (1, 2, "assistant", "z"), (1, 2, "assistant", "b"), (2, 9, "assistant", "alone")]
    docs = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1))
    got = chat_tools.formatted(docs)
    assert dict(Counter(r["kind"] for r in got.collect())) == KINDS
    told = " ".join(r["record"] for r in got.collect())
    for text in ['"say \\"yes\\""', '"a"', '"b"', '"c"', '"content":null,"role":"tool"', '"d"', '"e"', '"other"', '"z"', '"alone"']:
        assert text in told, text
    assert chat_tools.formatted(docs.limit(0)).count() == 0


def test_shared_folder_must_be_named_off_local_mode(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.shared_dir(Elsewhere)


def test_pipeline_stages_at_the_edges(spark):
    """Nulls in every column, repeated rows, clashing names and empty tables, stage by stage."""
    sf = "/root/testdata/sf0.01"
    known = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(None, None, None, None, None), (-1, None, "en", "s", 0), (-2, "", None, None, None), (-3, " \t", "de", None, 3), (-4, "123 456", "en", "s", 7), (None, "the only words of a row without an id are these here", None, None, None)]
    docs = known.unionByName(spark.createDataFrame(odd, known.schema)).unionByName(known.where("doc_id < 20"))
    docs = docs.withColumns({c: F.lit(1) for c in ("kept", "component_id", "score", "bucket", "judged_id", "_id", "t")})
    counts = {}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = shared.stored(stage(spark, kept, sf), "edge")
        assert kept.columns == docs.columns
        counts[name] = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert all(counts["toxicity"][i] == 1 for i in (-1, -2, -3, -4)) and counts["toxicity"][None] == 2
    assert not any(counts["language_id"][i] for i in (-1, -2, -3, -4)) and counts["language_id"][None] <= 1
    assert max(v for k, v in counts["minhash_near_dedup"].items() if k is not None) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, kept, sf).count() >= kept.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_a_hot_bucket_is_compared_with_its_first(spark, monkeypatch):
    """Near copies of one text, and texts that only some of them are near: the groups are those of all pairs, and rows grow with the bucket."""
    monkeypatch.setattr(minhash, "BUCKET_CHUNK", 16)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]

    def edited(words, n):
        out = list(words)
        for _ in range(n):
            out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
        return out

    far = edited(base, 9)
    texts = [edited(base, rng.randrange(4)) for _ in range(150)] + [edited(far, rng.randrange(9)) for _ in range(60)] + [[f"x{rng.randrange(10**6)}" for _ in range(60)] for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {i: find(i) for i in range(len(sets))}


def test_rows_of_a_hot_bucket_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_CHUNK", 10)
    size = []
    for n in (200, 400):
        led = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("rep"), F.lit(0).cast("long").alias("lead"), F.lit(n).cast("long").alias("c"), (F.col("id") >= 6).alias("near"))
        size.append(minhash._odd_ones(led).count())
    assert size[1] <= 2.1 * size[0]


def test_a_pair_at_the_edge_of_a_block_is_met():
    """Pairs whose distance lies in one block alone, at its budget: the box test may not lose them to rounding."""
    rng, d, least = np.random.default_rng(3), 64, 0.9
    r = embedding_dedup.rotation(d)
    for _ in range(40):
        x = embedding_dedup.unit(rng.standard_normal((3, d)))
        y = x @ r
        turn = 0.9999 * np.arccos(least)
        z = y.copy()
        a = rng.standard_normal((3, 16))
        for k in range(3):  # turned towards a direction of the first block
            e = np.zeros(d)
            e[:16] = a[k]
            e -= (e @ y[k]) * y[k]
            z[k] = np.cos(turn) * y[k] + np.sin(turn) * e / np.linalg.norm(e)
        found = {(int(p), int(q)) for ps, qs in embedding_dedup.linked_pairs(x, z @ r.T, least, 4) for p, q in zip(ps, qs, strict=True)}
        assert {(0, 0), (1, 1), (2, 2)} <= found


def test_token_ids_in_batches(spark):
    """The tokens of every text come back from the batches, whole and in order; copies come as often as they are."""
    from boardlake.llm import packing

    pieces = sentencepieces.model_pieces("/opt/tokenizers/piece_bpe_32k.model")
    texts = [(1, "a text of some words"), (1, "a text of some words"), (1, "the same id with another text"), (2, None), (None, "no id at all"), (3, "word " * 90), (4, "")]
    tokens = sentencepieces.encoded(spark.createDataFrame(texts, "doc_id long, text string"), pieces)
    rows = packing.token_batches(tokens, context=16, buckets=3, budget=64).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["piece"])):
        assert len(r["ids"]) + r["padding"] == r["bucket_len"]
        by[r["doc_id"]].append(r["ids"])
    want = [(r["doc_id"], r["ids"]) for r in tokens.collect()]
    assert sum(by[3], []) == next(i for d, i in want if d == 3) and len(by[3]) > 5 and by[2] == [[]] and by[4] == [[]]
    assert sorted(by[1]) == sorted(i for d, i in want if d == 1) and by[None] == [i for d, i in want if d is None]
    assert max(Counter((r["bucket"], r["batch"]) for r in rows).values()) <= 64
