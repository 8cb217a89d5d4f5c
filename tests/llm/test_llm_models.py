"""Language-model scores, dimension-sharded clusters and the prefix trie: against plain versions, and at their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardlake.llm import conversation_trie, interpolation, lloyd
from boardlake.sources.tables import table

SF = "/root/testdata/sf0.001"
CLASHING = ["run", "part", "o", "c", "d", "b", "n", "held", "chunk", "block", "x", "slice", "cluster", "cell", "rank", "base", "h", "given", "length", "depth", "ka", "kb", "size", "top", "before", "own", "ids", "parts", "ends"]


def clashing(df):
    return df.withColumns({n: F.lit(1) for n in CLASHING if n not in df.columns})


def remainder(i, by):
    return None if i is None else zlib.crc32(str(i).encode()) % by


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def plain_scores(rows, order, weights):
    """Scores by dictionaries, with the given weights."""
    seen, texts = [Counter() for _ in range(order)], 0
    for i, t in rows:
        if i is not None and remainder(i, 7) != 2:
            w, texts = [0] * (order - 1) + words(t), texts + 1
            for k in range(order - 1, len(w)):
                for o in range(order):
                    seen[o][tuple(w[k - o : k + 1])] += 1
    n, v = sum(seen[0].values()), len(seen[0])
    out = []
    for i, t in rows:
        w, score, base, known = [0] * (order - 1) + words(t), 0.0, 0.0, 0
        for k in range(order - 1, len(w)):
            c = [seen[o][tuple(w[k - o : k + 1])] for o in range(order)]
            ctx = [texts if k == order - 1 else seen[o - 1][tuple(w[k - o : k])] for o in range(1, order)]
            share = [1 / (v + 1), c[0] / max(n, 1)] + [a / max(b, 1) for a, b in zip(c[1:], ctx, strict=True)]
            mine = weights[ctx[-1].bit_length() if ctx else 0]
            score += math.log10(sum(x * y for x, y in zip(mine, share, strict=True)))
            base += math.log10((c[0] + 1) / (n + v + 1))
            known += c[0] > 0
        out.append((i, remainder(i, 7) == 2, len(w) - order + 1, known, n, base, score))
    return out


TEXTS = [(None, "a b c"), (None, None), (1, ""), (1, ""), (2, " \t\n"), (3, "Mixed CASE mixed case"), (3, "Mixed CASE mixed case"), (4, "x" * 100_000), (5, "word " * 5000), (6, "日本語 ÄÖ äö"), (7, None)]


@pytest.mark.parametrize(("order", "run"), [(1, 1 << 22), (2, 1 << 22), (3, 3000)])
def test_scores_equal_dictionaries(spark, order, run, monkeypatch):
    monkeypatch.setattr(interpolation, "RUN", run)
    rows = [(r["doc_id"] + 100, r["text"]) for r in table(spark, SF, "documents").collect()] + TEXTS
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    weights = interpolation.model(docs, order, "doc_id", "text", 2, 7)[1]
    got = sorted((tuple(r) for r in interpolation.score(docs, order).collect()), key=str)
    want = sorted(plain_scores(rows, order, weights.tolist()), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want] and len(got) == len(rows)
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)


def test_weights_by_expectation_maximisation(spark):
    """The weights of one bucket are those that plain EM finds, also with an estimate that is always 0; empty buckets take their neighbour's."""
    rng = np.random.default_rng(1)
    p1, p2 = rng.uniform(0, 0.1, 300), rng.uniform(0, 1, 300) * (rng.uniform(size=300) < 0.5)
    rows = [(2, float(a), float(b), 3) for a, b in zip(p1, p2, strict=True)] + [(0, 0.05, 0.0, 40)]
    got = interpolation.learned(spark.createDataFrame(rows, "b int, p1 double, p2 double, n long"), 2, 0.001)
    w = np.full(3, 1 / 3)
    for _ in range(interpolation.ROUNDS):
        x = np.stack([np.full(300, 0.001), p1, p2], 1) * w
        w = ((3 * x / x.sum(1, keepdims=True)).sum(0) + 1) / 903
    assert np.allclose(got[2], w, atol=1e-3) and np.allclose(got.sum(1), 1)
    assert got[0][2] < 0.05 and (got[1] == got[0]).all() and (got[50] == got[2]).all()


def test_scores_beat_single_tokens_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    x = interpolation.score(table(spark, sf, "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert x[0] > 0.9 * x[1]


def test_scores_of_little(spark):
    schema = "doc_id long, text string"
    assert interpolation.score(spark.createDataFrame([], schema)).count() == 0
    ids = [i for i in range(100) if remainder(i, 7) == 2][:3]
    for r in interpolation.score(spark.createDataFrame([(i, "nothing learned") for i in ids], schema)).collect():
        assert r["held_out"] and r["n_tokens"] == 3 and r["n_known"] == r["train_tokens"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"])


def plain_clusters(rows, k, rounds, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seed = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=seed)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(by[j]) for x in zip(*by[j], strict=True)] if by[j] else c for j, c in enumerate(centres)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = Counter()
    for _, j, d in found:
        own[j] += d
    most = lambda x: min(x, 2**63 - 1)
    return sorted(((i, j, most(d), most(own[j]), most(sum(own.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def odd_vectors():
    rng = random.Random(7)
    near = lambda c: [c + rng.uniform(-1, 1) for _ in range(20)]
    rows = [(i, near(i % 5)) for i in range(90)] + [(200 + i, [0.25] * 20) for i in range(40)] + [(300, [0.25] * 20)] * 3
    return rows + [(400, None), (401, []), (402, [0.0] * 20), (403, [float("nan")] + [1.0] * 19), (404, [float("inf")] + [1.0] * 19), (405, [None] + [1.0] * 19), (406, [1.0] * 19), (None, near(2)), (None, near(3))]


@pytest.mark.parametrize(("k", "extra"), [(6, []), (6, [(500, [1e30] * 20), (501, [-3e37] + [0.5] * 19)]), (500, [])])
def test_clusters_equal_a_plain_version(spark, k, extra):
    """Ties, repeated rows, vectors that are not kept, components beyond 64 bits, more centroids than vectors."""
    rows = odd_vectors() + extra
    df = clashing(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")).repartition(3)
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted((tuple(r) for r in lloyd.clusters(df, k=k, rounds=4, dims=20).collect()), key=str)
    assert got == plain_clusters(exact, k, 4, 20)
    assert len({r[1] for r in got}) > 3


def test_no_vector_no_cluster(spark):
    assert lloyd.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert lloyd.clusters(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_empty_clusters_keep_their_centroid(spark):
    """Equal vectors all go to the first of two equal centroids; the other stays."""
    rows = [(i, [1.0] * 4) for i in range(5)]
    got = lloyd.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2, rounds=2, dims=4).collect()
    assert {(r["cluster"], r["distance"]) for r in got} == {(0, 0)}


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    taken = {c: remainder(c, 6) for c in own}
    again = {c: own.get(c - int(math.fmod(c, 100)), [])[: taken[c]] + v[taken[c] :] for c, v in own.items()}
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in again.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = sum(saved[k] for k in below[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves[p], saved[p], digest))
    return sorted(out, key=str)


def odd_conversations():
    """Copies, a very long conversation, absent and short bases, nulls, negative ids, a hot first turn, distinct turns of one text."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"turn {t} {rng.randrange(3)}") for c in range(100, 260) for t in range(rng.randrange(1, 9))]
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(120) for t in range(9)]
    rows += [(5000, t, "user", f"long {t}") for t in range(700)] + [(300, 0, "user", "only")] + [(c, t, "user", "common" if t == 0 else f"{c} {t}") for c in range(300, 360) for t in range(7)]
    rows += [(-250, 1, "user", "below zero"), (-200, 1, "a", "base below zero"), (None, 1, "user", "nobody's"), (7, None, None, None), (7, 2, "user", None), (8, 1, None, "é日☃"), (9, 1, "", "é日☃"), (10, 5, "us", "er"), (11, 5, "u", "ser"), (12, 1, "user", "x" * 200_000)]
    seen, out = set(), []
    for r in rows:  # (conv_id, turn) is unique, as ties go by hashes
        if r[:2] not in seen:
            seen.add(r[:2])
            out.append(r)
    return out


@pytest.mark.parametrize("bounds", [{}, {"limit": 60, "ratio": 4, "most": 30}, {"limit": 1, "ratio": 40, "most": 5}])
def test_trie_equals_a_plain_version(spark, bounds):
    """In one shard, and in several levels of shards whose queues spill."""
    rows = odd_conversations()
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(5)
    got = sorted((tuple(r) for r in conversation_trie.prefixes(conversation_trie.rebuilt(df), **bounds).collect()), key=str)
    assert got == plain_trie(rows)


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie.prefixes(conversation_trie.rebuilt(spark.createDataFrame([], schema))).count() == 0
    turnless = next(c for c in range(101, 200) if remainder(c, 6) > 0)
    got = conversation_trie.prefixes(conversation_trie.rebuilt(spark.createDataFrame([(turnless, 1, "user", "gone")], schema))).collect()
    assert [tuple(r)[:7] for r in got] == [(turnless, 0, None, 1, 0, 1, 0)] and got[0]["ends_sha256"] == hashlib.sha256(str(turnless).encode()).hexdigest()


def test_turns_of_one_number_are_turns_of_their_own(spark):
    rows = [(100, 1, "user", "a"), (100, 1, "user", "a"), (100, 1, "user", "b")]
    got = conversation_trie.prefixes(conversation_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted(r["depth"] for r in got) == [0, 1, 2, 3]


def test_queue_spills_and_keeps_the_order():
    queue, rng = conversation_trie.Queue(50), random.Random(5)
    sent = [((rng.randrange(-40, 0), rng.randrange(9)), n) for n in range(5000)]
    got = []
    for m in sent:
        queue.push(m)
    for receiver in sorted({m[0] for m in sent}):
        got += [m for m in queue.of(receiver)]
    assert queue.spilled > 60 and [m[0] for m in got] == sorted(m[0] for m in sent) and sorted(got) == sorted(sent)


def test_digests_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 64)
    ids = list(range(-500, 1500, 3))
    ends = spark.createDataFrame([(1, 5, 6, i) for i in reversed(ids)] + [(1, 5, 7, 9)], "depth long, ka long, kb long, conv_id long")
    got = {r["kb"]: r["ends_sha256"] for r in conversation_trie.digests(ends).collect()}
    assert got == {6: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 7: hashlib.sha256(b"9").hexdigest()}
