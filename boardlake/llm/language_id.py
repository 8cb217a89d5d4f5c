"""Language ID by nearest centroid.

A text is a normalised TF-IDF vector of its letter 1-, 2- and 3-grams (letters folded to 64
classes, 3-grams hashed). Each language has several centroids, found by spherical k-means over a
bounded sample of its documents. A text goes to the language of the centroid with the highest
cosine; it is rejected if it is farther from that centroid than the language's own documents of
so many letters are. Those distances are learned across halves of the sample: centroids of one half judge
the documents of the other, and pieces of them, cut to each of `BANDS` numbers of letters, stand for short texts.

The fit sees at most `SAMPLE` documents of a language, chosen by a hash of doc_id; prediction
reads every text in full in one narrow pass, with a model of 12,352 numbers a centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, stored, text_batches
from .text import mixed, pieces
from .toxicity import kept_by, remainder

#: Documents of a language that a fit sees at most; centroids of a language; languages of a model (more are refused).
SAMPLE, CENTROIDS, LANGUAGES = 1000, 3, 2000
#: Bytes whose grams are counted at a time.
RUN = 1 << 17
#: A text is rejected under this share of the least cosine of its band of letters: of documents, and of pieces, which
#: are more alike than short documents are (a short one may be a license line and little else).
SLACK, PIECE_SLACK = 0.7, 0.5
#: Letters from which each band runs. The last holds whole documents, of which all but one in a hundred reach its
#: least cosine; the others hold pieces, of which all but one in twenty do (pieces of repeated words are far from all).
BANDS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
#: Documents of a language that are cut to pieces at most; letters of a document that centroids are fitted to.
CUT, LEAST_LETTERS = 250, 60
UNKNOWN = "und"

CLASSES, HASHED = 64, 8192
WIDTH = CLASSES + CLASSES * CLASSES + HASHED
#: Class 0 is all that is no letter; a-z are 1 to 26; bytes of other letters share the rest.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37
_TRIGRAM = (mixed(np.arange(CLASSES**3, dtype=np.uint64) + np.uint64(1)) >> np.uint64(51)).astype(np.int32)


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row from 0, gram, count) of runs of texts: each gram of a text once.

    A text longer than a run is counted slice by slice, so a byte of it takes one more byte and no more.
    """
    for i, j, offsets, data in pieces(column, lower=True, size=RUN):
        n = j - i
        # a gap stands before, between and after the texts
        c = np.zeros(len(data) + n + 1, np.uint8)
        owner = None
        if n == 1:
            c[1:-1] = _CLASS[data]
        else:
            row = np.repeat(np.arange(n), np.diff(offsets))
            at = np.arange(len(data)) + row + 1
            c[at] = _CLASS[data]
            owner = np.zeros(len(c), np.int64)
            owner[at] = row
            owner = np.maximum.accumulate(owner)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] > 0) | (c[:-1] > 0)  # runs of gaps count once
        c = c[keep]
        if owner is None:
            total = np.zeros(WIDTH, np.int64)
            for s in range(0, len(c), RUN):
                total += np.bincount(np.concatenate(_ending(c, s, min(len(c), s + RUN))), minlength=WIDTH)
            total[[0, CLASSES]] = 0  # gaps alone say nothing
            gram = np.flatnonzero(total)
            yield i, j, np.zeros(len(gram), np.int64), gram, total[gram]
            continue
        owner = owner[keep]
        one, two, three = _ending(c, 0, len(c))
        within = owner[:-2] == owner[2:]  # a gap between two texts is in the middle of no gram
        within |= c[1:-1] > 0
        whose = np.concatenate((owner, owner[1:], owner[1:-1][within]))
        gram = np.concatenate((one, two, three[within]))
        says = (gram != 0) & (gram != CLASSES)
        key, count = np.unique(whose[says] * WIDTH + gram[says], return_counts=True)
        yield i, j, key // WIDTH, key % WIDTH, count


def _ending(c: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 1-, 2- and 3-grams that end at the places from start to end of the classes."""
    before = min(start, 2)
    w = c[start - before : end].astype(np.int64)
    two = w[:-1] * CLASSES + w[1:]
    three = two[:-1] * CLASSES + w[2:]
    return w[before:], CLASSES + two[max(before - 1, 0) :], CLASSES + CLASSES * CLASSES + _TRIGRAM[three]


def tf_idf(row: np.ndarray, gram: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    """The weight of each gram in its row, of n rows of unit length (or without any)."""
    w = np.log1p(count) * idf[gram]
    length = np.sqrt(np.bincount(row, w * w, n))
    return w / np.maximum(length, 1e-12)[row]


def letters(column: pa.Array) -> np.ndarray:
    """The number of letters of each text."""
    out = np.zeros(len(column), np.int64)
    for a in range(0, len(column), 256):
        part = pc.replace_substring_regex(column.slice(a, 256).cast(pa.large_string()).fill_null(""), r"\P{L}+", "")
        out[a : a + 256] = pc.utf8_length(part).to_numpy(zero_copy_only=False)
    return out


def cut_to(text: str, n: int) -> str | None:
    """The beginning of a text with n letters, or None if it has fewer."""
    for at, ch in enumerate(text):
        n -= ch.isalpha()
        if not n:
            return text[: at + 1]
    return None


def vectors(column: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Dense rows, for a bounded sample."""
    out = np.zeros((len(column), WIDTH), np.float32)
    for a, b, row, gram, count in grams(column):
        out[a + row, gram] = tf_idf(row, gram, count, b - a, idf)
    return out


def least_cosines(v: np.ndarray, texts: list[str], n: np.ndarray, centroids: int, idf: np.ndarray) -> np.ndarray:
    """The cosine under which a text is rejected, for each band; v are the vectors of the texts, n their letters.

    A band without an own text asks for nothing, and none asks for more than the last.
    """
    found: list[list[np.ndarray]] = [[] for _ in BANDS]
    for own, other in ((slice(0, None, 2), slice(1, None, 2)), (slice(1, None, 2), slice(0, None, 2))):
        if not len(v[own]) or not len(v[other]):
            continue
        c = clusters(v[own], centroids).T
        found[-1].append((v[other][n[other] >= BANDS[-1]] @ c).max(1))
        for k, letters_ in enumerate(BANDS[:-1]):
            parts = [p for p in (cut_to(t, letters_) for t in texts[other][: CUT // 2]) if p]
            if parts:
                found[k].append((vectors(pa.array(parts, pa.string()), idf) @ c).max(1))
    last = len(BANDS) - 1
    least = np.zeros(len(BANDS))
    for k, x in enumerate(found):
        if sum(map(len, x)):
            least[k] = (SLACK if k == last else PIECE_SLACK) * np.quantile(np.concatenate(x), 0.01 if k == last else 0.05)
    least[last] = least[last] or least.max()
    return np.minimum(least, least[last])


def clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; the first is nearest the mean, each next farther from those before than 95 % are.

    A centroid that stands for less than a fiftieth of the rows goes, so that a few documents under a wrong label, or of
    another language, never make it one of this language's.
    """
    mean = v.mean(0)
    picked = [int(np.argmax(v @ mean))]
    near = v @ v[picked[0]]
    while len(picked) < min(k, len(v)):
        picked.append(int(np.argsort(near, kind="stable")[len(near) // 20]))
        near = np.maximum(near, v @ v[picked[-1]])
    c = v[picked]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, 1)
        sums = (own[None, :] == np.arange(len(c))[:, None]).astype(np.float32) @ v
        sums = np.where(np.bincount(own, minlength=len(c))[:, None] > 0, sums, c)
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    share = np.bincount(np.argmax(v @ c.T, 1), minlength=len(c))
    return c[share * 50 >= len(v)]


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each gram, summed over a task."""
    df, n = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for a, b, _, gram, _ in grams(batch.column(0)):
            df += np.bincount(gram, minlength=WIDTH)
            n += b - a
    yield pa.RecordBatch.from_arrays([pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["df", "n"])


class Model:
    """Centroids (a row each), their languages, idf, and each language's least cosine by band of letters."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, least: dict[str, np.ndarray]) -> None:
        self.langs, self.centroids, self.idf, self.least = langs, centroids.astype(np.float32), idf.astype(np.float32), least

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        lang, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        n = letters(column)
        if self.langs:
            names = np.array(self.langs, object)
            for a, b, row, gram, count in grams(column):
                w = tf_idf(row, gram, count, b - a, self.idf)
                best, most = np.zeros(b - a, np.int64), np.full(b - a, -1.0)
                for k, c in enumerate(self.centroids):
                    cos = np.bincount(row, w * c[gram], b - a)
                    best[cos > most] = k
                    most = np.maximum(most, cos)
                lang[a:b], score[a:b] = names[best], np.clip(most, 0, 1)
        lang[n == 0], score[n == 0] = UNKNOWN, 0.0
        band = np.maximum(np.searchsorted(BANDS, n, "right") - 1, 0)
        far = np.array([x == UNKNOWN or s < self.least[x][k] for x, s, k in zip(lang, score, band, strict=True)], bool)
        return lang, score, far


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES) -> Model:
    """A model from the documents with a language; rows to be held out are left out by the caller.

    Refused (ValueError) where the table names more than `languages` of them, as none may go unlearned and the model is
    held by every task.
    """
    known = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and _id is not null")
    langs = known.groupBy("lang").count().limit(languages + 1).collect()
    if len(langs) > languages:
        raise ValueError(f"more than {languages} languages: clean the labels, or raise `languages`")
    if not langs:
        return Model([], np.zeros((0, WIDTH)), np.ones(WIDTH), {})
    # one in so many is drawn by a hash, so that what is ranked is about 1.5 samples a language
    turn = F.pmod(F.xxhash64("_id", F.lit("language")), F.lit(1 << 30))
    under = F.create_map(*[x for r in langs for x in (F.lit(r["lang"]), F.lit(int(min(1.0, (1.5 * sample + 50) / r["count"]) * (1 << 30))))])
    drawn = known.withColumn("_turn", turn).where(F.col("_turn") < under[F.col("lang")])
    at = F.row_number().over(Window.partitionBy("lang").orderBy("_turn", "_id"))
    rows = drawn.withColumn("_at", at).where(F.col("_at") <= sample).select("text", "lang")
    rows = stored(rows, "labelled")  # the corpus is read once for the sample, however often the sample is
    seen = rows.repartition(8, "text").mapInArrow(_seen, "df array<long>, n long").collect()
    n = sum(r["n"] for r in seen)
    idf = np.log((1 + n) / (1 + np.sum([r["df"] for r in seen], 0))) + 1

    def fitted(group: pa.Table) -> pa.Table:
        own = group.column("text").combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        n = letters(own)
        some = np.flatnonzero(n >= LEAST_LETTERS if (n >= LEAST_LETTERS).any() else n > 0 if (n > 0).any() else n == 0)
        own, n = own.take(pa.array(some)), n[some]
        v = vectors(own, idf.astype(np.float32))
        c = clusters(v, centroids)
        least = least_cosines(v, own.to_pylist(), n, centroids, idf.astype(np.float32))
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(c), "c": pa.array(c.tolist(), pa.list_(pa.float32())), "least": pa.array([least.tolist()] * len(c), pa.list_(pa.float64()))})

    # at most `sample` documents of a language
    found = rows.groupBy("lang").applyInArrow(fitted, "lang string, c array<float>, least array<double>").collect()
    forget(rows)
    found.sort(key=lambda r: (r["lang"], r["c"]))
    return Model([r["lang"] for r in found], np.array([r["c"] for r in found]), idf, {r["lang"]: np.array(r["least"]) for r in found})


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs.

    It learns from rows with lang and text whose crc32(doc_id as text) mod 4 is not 2; the
    prediction sees the text alone. lang_pred is `und` with score 0 for null text and text without a
    letter (and for every text where nothing was learned), else a learned language; score is the
    cosine with its nearest centroid, from 0 to 1. rejected is true for `und` and for texts
    beyond the language's distance. Rows without an id are predicted, not held out, and teach nothing.
    Repeated rows get equal results. Further columns are not read.
    """
    model = train(docs.where(remainder("doc_id", 4) != 2), sample=sample)
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, far = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = own.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def known_language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that language ID rejects; all columns stay as they are.

    Null texts and texts without a letter go; long texts are judged whole; rows without an id are judged like others. An empty table
    stays empty.
    """
    model = train(docs.where(remainder("doc_id", 4) != 2), sample=sample)
    return kept_by(docs, lambda column: ~model.predict(column)[2])
