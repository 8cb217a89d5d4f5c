"""Language-model scores by deleted interpolation.

A token's probability is a mixture of the maximum-likelihood estimates of its n-grams up to `order`, and of the even
distribution over the vocabulary. How much each counts follows from how often the context was seen: contexts fall in
buckets by the binary logarithm of their frequency, and each bucket has weights of its own. The weights are learned by
expectation-maximisation on held-out counts: one in `DELETED` learning documents is taken out of the counts, its tokens are
predicted by what the others say, and the weights become each estimate's mean share in that.

1. `_read` cuts texts into runs of about `RUN` bytes: a run holds its different words' hashes and each token's place among them.
2. `_asked` hands each run's different n-grams, with their learning and held-out counts, to the part that their hash names;
   `_answered` adds a part's counts up over the corpus and gives every run those of its own n-grams, in its order.
3. `_told` puts the counts beside the run's tokens. Weights are learned from the held-out tokens by ordinary aggregates,
   then `_scored` sums up each text.

No table of words or n-grams is ever handed out whole: it lies in parts whose number follows the number of tokens, and a
frequent n-gram is one entry of a run however often it occurs there. Words are known by 64-bit hashes, so among n different
ones a pair is taken for one with probability n * n / 2**65. A task holds some 60 bytes for each byte of a run; a
text longer than a run is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored, tidied
from .text import LOWER, SPACE, Hashed, mixed, pieces, words

#: n-grams of up to so many words; in five tokens of natural prose three trigrams are new, which costs shuffle and gains little.
ORDER = 2
#: One in so many learning documents is held out for the weights.
DELETED = 16
#: Bytes of text in a run; tokens whose n-grams a part counts, on average.
RUN, PART = 1 << 22, 2_000_000
#: Rounds of expectation-maximisation, and the gain of mean log10 probability under which they end.
ROUNDS, GAIN = 30, 1e-6
#: Contexts' frequencies have so many binary logarithms, and 0.
BUCKETS = 65

_END, _BEGIN = mixed(np.arange(1, 3, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
#: What a text is to the model: one whose score is a test, one of unknown id, one that is counted, one counted that weights are learned from.
HELD_OUT, NOT_LEARNED, LEARNED, HELD = -1, 0, 1, 2


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, else 1 + floor(log2) of its frequency."""
    return np.frexp(context.astype(np.float64))[1]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed bytes: first the lowest byte of each, then the next, so that what they have in common lies together."""
    planes = np.ascontiguousarray(x.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def _blobs(arrays: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if x is None else packed(x) for x in arrays], pa.binary())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of texts of one kind."""
    task, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for kind in np.unique(kinds):
            own = batch.filter(pa.array(kinds == kind))
            for i, j, offsets, data in pieces(own.column("text"), size=RUN):
                low = LOWER[data]
                begin, end, row = words(~SPACE[low], offsets)
                ends = np.cumsum(np.bincount(row, minlength=j - i) + 1)
                tokens = np.full(ends[-1], _END, np.uint64)
                if len(begin):
                    tokens[np.arange(len(begin)) + row] = Hashed(low).of(begin, end)
                keys, at = np.unique(tokens, return_inverse=True)
                ids = pa.array([own.column("doc_id").slice(i, j - i).to_pylist()], pa.list_(pa.int64()))
                sizes = [pa.array([x]) for x in (j - i, int(ends[-1]))]
                blobs = [_blobs([x]) for x in (ends, np.diff(keys.view(np.int64), prepend=0), at)]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) | seq]), pa.array([kind], pa.int32()), *sizes, ids, *blobs], ["run", "kind", "n_texts", "n_tokens", "ids", "ends", "words", "places"])
                seq += 1


RUNS = "run long, kind int, n_texts long, n_tokens long, ids array<long>, ends binary, words binary, places binary"


def _values(rows: pa.RecordBatch | pa.Table, name: str, r: int = 0) -> np.ndarray:
    return unpacked(rows.column(name)[r].as_py())


def grams(rows: pa.RecordBatch | pa.Table, r: int, order: int) -> Iterator[np.ndarray]:
    """The hash of the n-gram that ends at each token of a run, for n from 1 to order; before a text stands a mark."""
    first = np.cumsum(_values(rows, "words", r)).view(np.uint64)[_values(rows, "places", r)]
    begins = np.append(0, _values(rows, "ends", r)[:-1])
    gram = first
    yield gram
    for _ in range(1, order):
        before = np.roll(gram, 1)
        before[begins] = _BEGIN
        gram = mixed(mixed(before) ^ first)
        yield gram


def _asked(order: int, parts: int):
    """The different n-grams of each run with their number there, by the part that their hash names."""
    cuts = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                name, kind = batch.column("run")[r].as_py(), batch.column("kind")[r].as_py()
                for o, gram in enumerate(grams(batch, r, order), 1):
                    keys, _, n = np.unique(gram, return_index=True, return_counts=True)  # with the index it sorts, which is faster
                    edges = np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)]))
                    full = np.flatnonzero(edges[1:] > edges[:-1])
                    own = [slice(edges[p], edges[p + 1]) for p in full]
                    blobs = [_blobs([np.diff(keys[x].view(np.int64), prepend=0) for x in own]), _blobs([n[x] if kind >= LEARNED else None for x in own])]
                    same = [pa.array(np.full(len(full), x), t) for x, t in ((name, pa.int64()), (kind, pa.int32()), (o, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *same, *blobs], ["part", "run", "kind", "o", "keys", "n"])

    return run


ASKED = "part int, run long, kind int, o int, keys binary, n binary"


def _answered(rows: pa.Table) -> pa.Table:
    """For each row of a part the corpus' counts of its n-grams, and the held-out ones if it is held out itself; known, once: how many different ones were learned."""
    out = []
    for o in np.unique(rows.column("o").to_numpy()):
        own = rows.filter(pa.array(rows.column("o").to_numpy() == o))
        kinds = own.column("kind").to_numpy()
        keys = [np.cumsum(unpacked(x)) for x in own.column("keys").to_pylist()]
        n = [unpacked(x) if x else np.zeros(len(k), np.int64) for x, k in zip(own.column("n").to_pylist(), keys, strict=True)]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total, held = (np.bincount(at, np.concatenate(x), len(found)).astype(np.int64) for x in (n, [a * (k == HELD) for a, k in zip(n, kinds, strict=True)]))
        c = np.split(total[at], cuts)
        d = [x if k == HELD else None for x, k in zip(np.split(held[at], cuts), kinds, strict=True)]
        known = [int((total > 0).sum())] + [0] * (len(keys) - 1)
        out.append(pa.table([own.column("run"), own.column("part"), own.column("o"), _blobs(c), _blobs(d), pa.array(known)], names=["run", "part", "o", "c", "d", "known"]))
    return pa.concat_tables(out)


ANSWERS = "run long, part int, o int, c binary, d binary, known long"


def _told(order: int):
    """The run's texts with the counts of each token's n-grams, an entry for each n; held-out ones without what is held out in `left` too."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        c, left = [], []
        for o, gram in enumerate(grams(own, 0, order), 1):
            mine = answers.filter(pa.array(answers.column("o").to_numpy() == o)).sort_by("part")
            at = np.unique(gram, return_inverse=True)[1]
            counts = np.concatenate([unpacked(x) for x in mine.column("c").to_pylist()])
            c.append(packed(counts[at]))
            if own.column("kind")[0].as_py() == HELD:
                left.append(packed((counts - np.concatenate([unpacked(x) for x in mine.column("d").to_pylist()]))[at]))
        return pa.table([*[own.column(x).combine_chunks() for x in ("kind", "ids", "ends")], *[pa.array([x], pa.list_(pa.binary())) for x in (c, left)]], names=["kind", "ids", "ends", "c", "left"])

    return run


TOLD = "kind int, ids array<long>, ends binary, c array<binary>, left array<binary>"


def _contexts(counts: list[np.ndarray], ends: np.ndarray, texts: int) -> list[np.ndarray]:
    """How often the context of each token's n-gram was seen, for n from 2; the mark before a text is seen once for each text."""
    out = []
    for c in counts[:-1]:
        before = np.roll(c, 1)
        before[np.append(0, ends[:-1])] = texts
        out.append(before)
    return out


def _lists(batch: pa.RecordBatch, name: str, r: int) -> list[np.ndarray]:
    return [unpacked(x) for x in batch.column(name)[r].as_py()]


def _shares(counts: list[np.ndarray], contexts: list[np.ndarray], tokens: int) -> list[np.ndarray]:
    """The maximum-likelihood estimates, for n from 1."""
    return [counts[0] / max(tokens, 1)] + [c / np.maximum(x, 1) for c, x in zip(counts[1:], contexts, strict=True)]


def _deleted(order: int, tokens: int, texts: int):
    """(bucket, estimates, number) of the held-out tokens as the other documents see them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                left = _lists(batch, "left", r)
                contexts = _contexts(left, _values(batch, "ends", r), texts)
                seen = contexts[-1] if contexts else np.zeros(len(left[0]), np.int64)
                own, n = np.unique(np.stack([bucket(seen), *_shares(left, contexts, tokens)], 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0].astype(np.int32)), *[pa.array(np.ascontiguousarray(own[:, k])) for k in range(1, order + 1)], pa.array(n)], ["b", *[f"p{k}" for k in range(1, order + 1)], "n"])

    return run


def learned(held: DataFrame, order: int, even: float) -> np.ndarray:
    """weights[bucket, k]: of the even distribution (k = 0) and of the k-grams, from held (b, p1 .. p<order>, n).

    Every estimate starts with, and keeps, one token's share in each bucket, so none ever gets weight 0. A bucket without
    held-out tokens takes the weights of the next smaller one that has some; without any, all estimates weigh the same.
    """
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    before = None
    estimates = [F.lit(even)] + [F.col(f"p{k}") for k in range(1, order + 1)]
    for _ in range(ROUNDS):
        parts = [F.element_at(F.lit(weights[:, k].tolist()), F.col("b") + 1) * p for k, p in enumerate(estimates)]
        whole = sum(parts[1:], parts[0])
        found = held.groupBy("b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log10(whole)).alias("fit"), *[F.sum(F.col("n") * x / whole).alias(f"s{k}") for k, x in enumerate(parts)]).orderBy("b").collect()
        if not found:
            break
        for r in found:
            weights[r["b"]] = [(r[f"s{k}"] + 1) / (r["n"] + order + 1) for k in range(order + 1)]
        fit = sum(r["fit"] for r in found) / sum(r["n"] for r in found)
        if before is not None and fit - before < GAIN:
            break
        before = fit
    have = {r["b"] for r in found}
    for b in range(1, BUCKETS):
        if have and b not in have and b > min(have):
            weights[b] = weights[b - 1]
    return weights


def _scored(weights: np.ndarray, tokens: int, kinds: int, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ends, counts = _values(batch, "ends", r), _lists(batch, "c", r)
                begins = np.append(0, ends[:-1])
                contexts = _contexts(counts, ends, texts)
                mine = weights[bucket(contexts[-1] if contexts else np.zeros(len(counts[0]), np.int64))]
                p = mine[:, 0] / (kinds + 1) + sum(mine[:, k] * x for k, x in enumerate(_shares(counts, contexts, tokens), 1))
                base = np.log10((counts[0] + 1) / (tokens + kinds + 1))
                sums = [np.add.reduceat(x, begins) for x in ((counts[0] > 0).astype(np.int64), base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[r].values, pa.array(np.full(len(ends), batch.column("kind")[r].as_py() == HELD_OUT)), pa.array(np.diff(ends, prepend=0)), pa.array(sums[0]), pa.array(np.full(len(ends), tokens)), pa.array(sums[1]), pa.array(sums[2])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", remainder: int = 2, by: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Tokens are the words between blanks with A-Z in lower case, and one end for each text. Counts and weights are learned from
    rows whose crc32(doc_id as text) modulo `by` is not `remainder`; the others are held out. score is the log10
    probability of the text under the model, base_score that of single tokens with one added to every count.

    A null text counts as empty, which is one token, the end. Rows without an id are scored like others; they are neither
    held out nor learned from. Repeated rows are learned from as often as they come. If nothing was learned, every token has
    the even distribution's share. An empty table gives an empty result. Further columns are not read.
    """
    told, weights, tokens, kinds, texts = model(docs, order, id_col, text_col, remainder, by)
    return told.mapInArrow(_scored(weights, tokens, kinds, texts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def model(docs: DataFrame, order: int, id_col: str, text_col: str, remainder: int, by: int) -> tuple[DataFrame, np.ndarray, int, int, int]:
    """The stored runs with their counts, the weights, and the numbers of learned tokens, of different ones, and of texts."""
    spark = docs.sparkSession
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    kind = F.when(crc.isNull(), NOT_LEARNED).when(crc % by == remainder, HELD_OUT).when(F.pmod(F.xxhash64(crc), F.lit(DELETED)) == 0, HELD).otherwise(LEARNED)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), kind.alias("kind"))
    with tidied(spark):
        runs = stored(own.mapInArrow(_read, RUNS), "runs")
        sizes = {r["kind"]: (r["tokens"], r["texts"]) for r in runs.groupBy("kind").agg(F.sum("n_tokens").alias("tokens"), F.sum("n_texts").alias("texts")).collect()}
        (tokens, texts), (held_tokens, held_texts) = (tuple(map(sum, zip((0, 0), *[sizes[k] for k in some if k in sizes], strict=True))) for some in ((LEARNED, HELD), (HELD,)))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(n for n, _ in sizes.values()) // PART))
        answers = stored(runs.mapInArrow(_asked(order, parts), ASKED).groupBy("part").applyInArrow(_answered, ANSWERS), "answers")
        kinds = answers.where("o = 1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
        counted = stored(runs.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_told(order), TOLD), "counted")
        forget(runs)
        forget(answers)
        held = stored(counted.where(F.col("kind") == HELD).mapInArrow(_deleted(order, tokens - held_tokens, texts - held_texts), ", ".join(["b int", *[f"p{k} double" for k in range(1, order + 1)], "n long"])), "held")
        weights = learned(held, order, 1 / (kinds + 1))
        forget(held)
    return counted, weights, tokens, kinds, texts
