"""Toxicity: a counterfactual-regularised classifier of whole texts.

Logistic regression on words and word beginnings: whether a text has them, has them twice, and three times. Beside the loss on labelled
documents, each labelled sentence that names an identity group is taken again with the term
swapped for another of its kind, and the squared change of the score is penalised: weight on the
mention of a group is not worth its price, so neutral mentions don't raise a score.

The fit sees a bounded sample (`SAMPLE` rows of each label, chosen by a hash of doc_id);
scoring reads every text in full, in one narrow pass with a model of at most `VOCABULARY` weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored, text_batches
from .text import Hashed, in_words, mixed, pieces, runs, words

#: Labelled rows of each class that a fit sees at most; features that a model keeps at most.
SAMPLE, VOCABULARY = 5000, 4000
#: Documents with a feature, at least; the least root of twice its log-likelihood ratio.
LEAST_DOCS, LEAST_Z = 5, 4.0
#: Times that a word or beginning counts: once, twice, three times.
LEVELS = 3
RIDGE, FAIRNESS = 3e-5, 1.0
#: The score at which a fit, in which both classes weigh the same, takes either for as likely.
MEETS = 0.7

# Identity terms by kind; a term is swapped for the next of its kind and language.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["muslims", "christians", "jews", "hindus"],
    ["muslim", "christian", "jewish", "hindu"], ["black", "white", "asian", "latino"], ["gay", "straight"],
    ["immigrants", "natives"], ["transgender", "cisgender"], ["disabled", "abled"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["noirs", "blancs"],
    ["frauen", "männer"], ["muslime", "christen", "juden"], ["schwarze", "weiße"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["negros", "blancos"],
]
SWAPS = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, t in enumerate(kind)}
_TERMS = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, SWAPS), key=len, reverse=True)) + r")(?!\w)")
_SENTENCE = re.compile(r"[^.!?\n]+")
_SALTS = mixed(np.arange(1, 4, dtype=np.uint64))


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def word_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, feature of each occurrence, its row from 0) of runs of texts.

    A word gives itself and its beginnings of four and five bytes.
    """
    for i, j, offsets, data in pieces(column, lower=True):
        begin, end, row = words(in_words(data), offsets) if len(data) else (np.zeros(0, np.int64),) * 3
        h = Hashed(data)
        parts, rows = [h.of(begin, end) ^ _SALTS[0]], [row]
        for k in (4, 5):
            long = np.flatnonzero(end - begin >= k)
            parts.append(h.of(begin[long], begin[long] + k) ^ _SALTS[k - 3])
            rows.append(row[long])
        yield i, j, np.concatenate(parts), np.concatenate(rows)


def level(f: np.ndarray, k: int) -> np.ndarray:
    """The feature that f occurs k times at least; f itself for once."""
    return f if k == 1 else mixed(f + np.uint64(k) * _SALTS[1])


def occurring(f: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, what it is a level of, row), each once, from occurrences: a text that has a word three times has three features of it."""
    order = np.lexsort((r, f))
    f, r = f[order], r[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(f)))
    some = [at[n >= k] for k in range(1, LEVELS + 1)]
    return np.concatenate([level(f[x], k) for k, x in enumerate(some, 1)]), np.concatenate([f[x] for x in some]), np.concatenate([r[x] for x in some])


def features_of(texts: list[str]) -> list[np.ndarray]:
    """The distinct features of each text."""
    out: list[np.ndarray] = []
    for i, j, f, r in word_features(pa.array(texts, pa.string())):
        f, _, r = occurring(f, r)
        out += [np.unique(f[r == k]) for k in range(j - i)]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, what it is a level of, documents labelled 1, documents labelled 0) of the task's batches, a row for each batch and feature."""
    for batch in batches:
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j, f, r in word_features(batch.column(0)):
            f, base, r = occurring(f, r)
            if not len(f):
                continue
            order = np.argsort(f, kind="stable")
            own, at, n = np.unique(f[order], return_index=True, return_counts=True)
            pos = np.add.reduceat(y[i + r[order]], at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(base[order][at].view(np.int64)), pa.array(pos), pa.array(n - pos)], ["f", "base", "pos", "neg"])


def _indexed(vocabulary: np.ndarray):
    """(label, features, [features taken and brought by a swap]) by their places in the sorted vocabulary."""

    def places(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
        return np.unique(at[vocabulary[at] == x]) if len(x) and len(vocabulary) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.utf8_lower(batch.column(0)).to_pylist()
            xs = []
            for i, j, f, r in word_features(batch.column(0)):
                f, _, r = occurring(f, r)
                order = np.argsort(r, kind="stable")
                cut = np.searchsorted(r[order], np.arange(j - i + 1))
                xs += [places(f[order[cut[k] : cut[k + 1]]]).tolist() for k in range(j - i)]
            taken, brought = [], []
            for t in texts:
                pairs = [(s, _TERMS.sub(lambda m: SWAPS[m[0]], s)) for s in _SENTENCE.findall(t or "") if _TERMS.search(s)]
                both = features_of([x for p in pairs for x in p])
                taken.append([places(np.setdiff1d(a, b)).tolist() for a, b in zip(both[::2], both[1::2], strict=True)])
                brought.append([places(np.setdiff1d(b, a)).tolist() for a, b in zip(both[::2], both[1::2], strict=True)])
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(xs, pa.list_(pa.int32())), pa.array(taken, lists), pa.array(brought, lists)], ["y", "x", "taken", "brought"]
            )

    return run


class Sparse:
    """Rows of signed features as one matrix: products with a vector, and of a row vector with it."""

    def __init__(self, plus: list | pa.ListArray, minus: list | pa.ListArray | None = None) -> None:
        """Lists of features with sign 1, and others of the same rows with sign -1."""
        lists = [x if isinstance(x, pa.ListArray) else pa.array(x, pa.list_(pa.int32())) for x in (plus, minus) if x is not None]
        sizes = [np.diff(np.asarray(x.offsets)) for x in lists]
        cols = [x.flatten().to_numpy().astype(np.int64) for x in lists]
        self.n = len(plus)
        self.row = np.concatenate([np.repeat(np.arange(self.n), z) for z in sizes])
        self.col = np.concatenate(cols)
        self.sign = np.repeat([1.0, -1.0][: len(cols)], [len(c) for c in cols])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * w[self.col], self.n) if self.n else np.zeros(0)

    def back(self, v: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, self.sign * v[self.row], width) if self.n else np.zeros(width)


def fit(y: np.ndarray, x: Sparse, swaps: Sparse, width: int, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss + RIDGE |w|^2 + FAIRNESS mean (score change of a swap)^2.

    Accelerated gradient steps, the same for the same rows in any order up to rounding.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    # a bound of the curvature along each weight: rows weigh by how many features they hold
    rowsize = np.bincount(x.row, minlength=x.n)
    curve = np.bincount(x.col, (share * rowsize / 4)[x.row], width) + 2 * RIDGE
    if swaps.n:
        curve += 2 * FAIRNESS / swaps.n * np.bincount(swaps.col, np.bincount(swaps.row, minlength=swaps.n)[swaps.row].astype(float), width)
    w, b = np.zeros(width), 0.0
    seen_w, seen_b, t = w, b, 1.0
    step = 1.0 / np.maximum(curve, 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(seen_w) + seen_b, -40, 40)))
        g = (p - y) * share
        change = swaps.times(seen_w)
        down = x.back(g, width) + 2 * RIDGE * seen_w + 2 * FAIRNESS / max(1, swaps.n) * swaps.back(change, width)
        new_w, new_b = seen_w - step * down, seen_b - 0.5 * g.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if down @ (new_w - w) > 0:  # uphill: forget the momentum
            nt = 1.0
            seen_w, seen_b = new_w, new_b
        else:
            seen_w, seen_b = new_w + (t - 1) / nt * (new_w - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new_w, new_b, nt
    return w, float(b)


class Model:
    """Sorted features, their weights, the intercept, and the sorted words and beginnings that features are levels of."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float, bases: np.ndarray) -> None:
        self.features, self.weights, self.intercept, self.bases = features, weights, intercept, bases

    def scores(self, column: pa.Array) -> np.ndarray:
        """The score of each text; null and empty texts get that of no words."""
        out = np.full(len(column), self.intercept)
        if len(self.features):
            sieve = np.zeros(1 << 20, bool)
            mask = np.uint64((1 << 20) - 1)
            sieve[(self.bases & mask).astype(np.int64)] = True
            for i, j, f, r in word_features(column):  # a run holds whole texts
                some = sieve[(f & mask).astype(np.int64)]
                f, r = f[some], r[some]
                at = np.minimum(np.searchsorted(self.bases, f), len(self.bases) - 1)
                hit = self.bases[at] == f
                f, _, r = occurring(f[hit], r[hit])
                at = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
                hit = self.features[at] == f
                out[i:j] += np.bincount(r[hit], self.weights[at[hit]], j - i)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the labelled documents; rows of labels to be held out are left out by the caller.

    Without labelled rows of both classes the model has no features and scores 0.5 at most. An id that is labelled both
    ways counts as 1, and an id with several texts teaches the first of them in order, so that no id counts twice.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y in (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    turn = F.xxhash64("_id", F.lit("toxicity"))
    picked = reduce(DataFrame.unionByName, [known.where(F.col("y") == k).orderBy(turn, "_id").limit(sample) for k in (0, 1)])
    # at most 2 * sample ids: a proven bound, so a broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))
    rows = stored(rows.select("text", "y"), "labelled")  # the corpus is read once for the sample, however often the sample is
    total = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in total}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0 if not pos else 0.0, np.zeros(0, np.uint64))
    counts = rows.mapInArrow(_counted, "f long, base long, pos long, neg long").groupBy("f").agg(F.min("base").alias("base"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # the root of twice the log-likelihood ratio of the four cells, which holds where a cell is empty too
    all_, both = F.lit(pos + neg), F.col("pos") + F.col("neg")
    cells = [(F.col("pos"), both, pos), (F.col("neg"), both, neg), (pos - F.col("pos"), all_ - both, pos), (neg - F.col("neg"), all_ - both, neg)]
    terms = [F.when(n > 0, n * F.log(n * all_ / (row * column))).otherwise(0.0) for n, row, column in cells]
    z = F.sqrt(F.greatest(2 * sum(terms[1:], terms[0]), F.lit(0.0)))
    chosen = counts.where(F.col("pos") + F.col("neg") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(VOCABULARY)
    named = np.concatenate(features_of(list(SWAPS)))
    found = np.array(chosen.select("f", "base").collect(), np.int64).reshape(-1, 2).view(np.uint64)
    vocabulary = np.unique(np.concatenate([found[:, 0], named]))
    bases = np.unique(np.concatenate([found[:, 1], named]))
    width = len(vocabulary)

    def fitted(batch: pa.Table) -> pa.Table:
        y = batch.column("y").to_numpy().astype(float)
        x, taken, brought = (batch.column(c).combine_chunks() for c in ("x", "taken", "brought"))
        w, b = fit(y, Sparse(x), Sparse(brought.flatten(), taken.flatten()), width)
        return pa.table({"w": pa.array([w.tolist()], pa.list_(pa.float64())), "b": pa.array([b])})

    # at most 2 * sample rows of at most VOCABULARY small integers
    indexed = rows.mapInArrow(_indexed(vocabulary), "y int, x array<int>, taken array<array<int>>, brought array<array<int>>")
    got = indexed.groupBy(F.lit(1).alias("all")).applyInArrow(fitted, "w array<double>, b double").first()
    forget(rows)
    w = np.array(got["w"])
    used = np.abs(w) > 1e-6
    return Model(vocabulary[used], w[used], got["b"] + np.log(MEETS / (1 - MEETS)), bases)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """(id, score) for each row; one narrow pass, whatever the length of the texts."""

    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)))], ["doc_id", name])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {name} double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Labels of rows whose crc32(doc_id as text) mod 3 is 1 are held out; only the text is scored.
    Null and empty texts get the score of no words. Rows without an id are scored and not held out.
    Repeated rows get equal scores. Null labels, labels other than 0 and 1, and labels
    without a document teach nothing. Further columns of either table are not read.
    """
    model = train(docs, labels.where(remainder("doc_id", 3) != 1))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay as they are.

    Null and empty texts have no toxic word and stay; long texts are judged whole; rows without an id are judged like others. An empty
    table stays empty.
    """
    model = train(docs, labels.where(remainder("doc_id", 3) != 1))
    return kept_by(docs, lambda column: model.scores(column) < threshold)


#: Bytes of text that kept_by judges and hands on at a time.
HANDED = 4 << 20


def kept_by(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """docs where keep(Arrow text column) is true, in one narrow pass; keep gets texts as they are, null and empty ones too."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in runs(batch.column(batch.schema.get_field_index(text_col)), HANDED):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(keep(part.column(batch.schema.get_field_index(text_col)))))

    return docs.mapInArrow(run, docs.schema)
